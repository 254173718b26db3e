"""Further lexical channels: identifiers and entities, ranked by the scope's own statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions.entities import entities
from recallspark.functions.text import normalize_identifiers
from recallspark.operators.retrieval import count_terms


def channel(rows: DataFrame, terms: list[str], prefix: bool = False, key: str = "id", k: int = 50) -> DataFrame:
    """(id, matched, bm25): the k best keys of rows (key, text) with all terms; where none has all, with any.

    A key counts by its best row.
    """
    c = count_terms(rows, terms, {"text": 1.0}, prefix=prefix, key=key)
    scored = c.hits.select("id", c.bm25.alias("bm25"), c.matched.alias("matched"))
    if c.most == c.terms:
        scored = scored.where(F.col("matched") == c.terms)
    best = F.max(F.struct("matched", "bm25")).alias("b")
    return scored.groupBy("id").agg(best).select("id", "b.matched", "b.bm25").orderBy(F.desc("bm25"), "id").limit(k)


def identifier_search(memories: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """The k best by normalised identifiers of the content."""
    return channel(memories.select("id", normalize_identifiers(F.col("content")).alias("text")), terms, k=k)


def entity_rows(memories: DataFrame) -> DataFrame:
    """(memory_id, entity_text, entity_type, created_at) of every entity."""
    return memories.select(F.col("id").alias("memory_id"), "created_at", F.explode(entities(F.col("content"))).alias("e")).select("memory_id", "e.entity_text", "e.entity_type", "created_at")


def entity_search(named: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """The k best memories by prefixes of their entities' identifiers; a memory counts by its best entity."""
    rows = named.select("memory_id", normalize_identifiers(F.col("entity_text")).alias("text"))
    return channel(rows, terms, prefix=True, key="memory_id", k=k)


def entity_lookup(named: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Memories that name exactly this entity but for ASCII case, newest first."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = named.where(fold(F.col("entity_text")) == fold(F.lit(name))).groupBy("memory_id").agg(F.max("created_at").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), "memory_id").limit(k)
