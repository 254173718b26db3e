"""Queries of the vector cache on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallspark.operators.vector_cache import STEP_MS, VectorCache
from recallspark.plans.registry import query
from recallspark.plans.scratch import Scratch
from recallspark.sources.tables import table

CAPACITY = 120

_USED = f"""WITH d AS (SELECT doc_id, text, sha256('m' || chr(0) || text) AS key FROM documents WHERE text IS NOT NULL), p AS (SELECT * FROM d JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0),
u AS (SELECT key, 0 AS moment FROM p WHERE doc_id % 4 = 0 UNION ALL SELECT key, {STEP_MS} FROM p WHERE doc_id % 4 = 2 AND key NOT IN (SELECT key FROM p WHERE doc_id % 4 = 0)
UNION ALL SELECT key, {2 * STEP_MS} FROM d WHERE doc_id % 16 < 2 AND key IN (SELECT key FROM p)), l AS (SELECT key, max(moment) AS used_at FROM u GROUP BY 1)"""


def _filled(spark, d) -> tuple[VectorCache, object]:
    cache = VectorCache(spark, f"{Scratch.of(spark).root}/vectors-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("doc_id", "text")
    vectors = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    cache.put(vectors.where("doc_id % 4 = 0"), "m", 0)
    cache.put(vectors.where("doc_id % 4 = 2"), "m", STEP_MS)
    return cache, docs


@query("cache_lookups", f"{_USED} SELECT DISTINCT key, key IN (SELECT key FROM p) AS hit FROM d WHERE doc_id % 16 < 2")
def cache_lookups(spark, d):
    cache, docs = _filled(spark, d)
    got = cache.get(docs.where("doc_id % 16 < 2"), "m", 2 * STEP_MS)
    return got.select(F.sha2(F.concat(F.lit("m\0"), "text").cast("binary"), 256).alias("key"), F.col("embedding").isNotNull().alias("hit"))


@query("cache_after_eviction", f"{_USED} SELECT key, used_at FROM l ORDER BY l.used_at DESC, key LIMIT {CAPACITY}")
def cache_after_eviction(spark, d):
    cache, docs = _filled(spark, d)
    cache.get(docs.where("doc_id % 16 < 2"), "m", 2 * STEP_MS)
    cache.compact(CAPACITY)
    return cache.last_uses()
