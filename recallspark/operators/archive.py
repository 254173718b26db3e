"""Shareable archives: what may leave, with home paths and foreign roots redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Home folders of three systems, and the hash's start and factor.
HOME_PATHS = (r"""/Users/[^/\s"'`]+""", r"""/home/[^/\s"'`]+""", r"""[A-Za-z]:\\?Users\\?[^\\\s"'`]+""")
FNV_START, FNV_FACTOR = 2166136261, 16777619


def scrub_homes(text: Column) -> Column:
    for pattern in HOME_PATHS:
        text = F.regexp_replace(text, pattern, "~")
    return text


def short_hash(text: Column) -> Column:
    """32-bit FNV-1a over code points below 2**16, as eight hexadecimal digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_FACTOR) % (1 << 32)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.lower(F.lpad(F.hex(F.aggregate(chars, F.lit(FNV_START).cast("long"), step)), 8, "0"))


def redact_namespace(namespace: Column, home: str) -> Column:
    """Paths below home start with ~, other roots become their leaf and a hash; scopes after // stay."""
    at = F.instr(namespace, "//")
    base = F.when(at > 0, F.substring(namespace, F.lit(1), at - 1)).otherwise(namespace)
    scope = F.when(at > 0, F.substring(namespace, at, F.length(namespace))).otherwise("")
    below = F.regexp_replace(F.substring(base, len(home) + 1, 1 << 20), "^/+", "")
    leaf = F.coalesce(F.try_element_at(F.filter(F.split(base, "/"), lambda p: p != ""), F.lit(-1)), F.lit("root"))
    inside = (base == home) | base.startswith(home if home.endswith("/") else home + "/")
    named = F.when(inside, F.when(below == "", "~").otherwise(F.concat(F.lit("~/"), below))).when(base.startswith("/"), F.concat(F.lit("ext/"), leaf, F.lit("-"), short_hash(base))).otherwise(base)
    return F.when(namespace == "", namespace).otherwise(F.concat(named, scope))


def export(rows: DataFrame, links: DataFrame, layers: list[str], home: str = "/home/user") -> tuple[DataFrame, DataFrame]:
    """(rows, links) of an archive: shareable, current rows of the layers, and the links among them."""
    from recallspark.operators.visibility import current

    out = current(rows, links).where(F.col("shareable") & F.col("type").isin(*layers))
    text = {c for c, t in out.dtypes if t == "string"} - {"namespace"}
    kept = out.select(*[redact_namespace(F.col(c), home).alias(c) if c == "namespace" else scrub_homes(F.col(c)).alias(c) if c in text else F.col(c) for c in out.columns])
    ids = out.select("id")
    inner = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, inner


def snapshot(rows: DataFrame, links: DataFrame, entities: DataFrame, vectors: DataFrame, sessions: DataFrame, layers: list[str], home: str = "/home/user") -> dict[str, DataFrame]:
    """All tables of an archive: its rows, the links among them, their entities and vectors, and their sessions,
    with home folders scrubbed from entities and summaries."""
    kept, inner = export(rows, links, layers, home)
    ids = kept.select("id")
    own = entities.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").withColumn("entity_text", scrub_homes(F.col("entity_text")))
    used = sessions.join(kept.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    return {"memories": kept, "links": inner, "entities": own, "embeddings": vectors.join(ids, "id", "left_semi"), "sessions": used}


def manifest(tables: dict[str, DataFrame], schema: int, model: str, dim: int, at: int) -> dict:
    """What describes an archive: versions, and how many rows each table has."""
    return {"schema": schema, "model": model, "dim": dim, "created_at": at, "rows": {name: df.count() for name, df in tables.items()}}


def importable(manifest: dict, schema: int, model: str, dim: int) -> list[str]:
    """Why an archive can't be read here; empty if it can."""
    faults = [] if manifest.get("schema", 0) <= schema else [f"schema {manifest['schema']} is newer than {schema}"]
    return faults + [f"{k} {manifest.get(k)!r} is not {v!r}" for k, v in (("model", model), ("dim", dim)) if manifest.get(k) != v]
