"""Versions of memories: revisions, state heads, deletes with everything that hangs on them, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Similarity from which a new row is a near duplicate.
NEAR_DUPLICATE = 0.95


def _supersedes(rows: DataFrame, newer: str, older: str, at: str, revision: str = "revision") -> DataFrame:
    """Edges of rows whose newer memory takes the older one's place, with full confidence."""
    one = F.lit(1.0)
    return rows.select(F.col(newer).alias("source_id"), F.col(older).alias("target_id"), F.lit("supersedes").alias("link_type"), one.alias("similarity"), one.alias("confidence"), F.col(at).alias("created_at"), F.col(at).alias("judged_at"), F.col(revision).alias("revision"))


def revised(memories: DataFrame, links: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and links after edits (id, new_id, content, at), one of each memory at most.

    The new row copies all but content and times; the old one's window closes, if it was open; the
    edge counts the revision up from the old row's own.
    """
    e = edits.select(F.col("id"), F.col("new_id").alias("_new"), F.col("content").alias("_content"), F.col("at").alias("_at"))
    both = memories.join(e, "id")
    fresh = {"id": F.col("_new"), "content": F.col("_content"), "created_at": F.col("_at"), "valid_from": F.col("_at"), "valid_until": F.lit(None).cast("long"), "access_count": F.lit(0), "last_accessed": F.lit(None).cast("long")}
    added = both.select(*[fresh[c].cast(t).alias(c) if c in fresh else F.col(c) for c, t in memories.dtypes])
    kept = memories.join(e.select("id", "_at"), "id", "left").withColumn("valid_until", F.coalesce("valid_until", "_at")).select(*memories.columns)
    before = links.where("link_type = 'supersedes'").groupBy(F.col("source_id").alias("id")).agg(F.max("revision").alias("r"))
    counted = e.join(memories.select("id"), "id").join(before, "id", "left").withColumn("revision", F.coalesce("r", F.lit(0)) + 1)
    return kept.unionByName(added), _supersedes(counted, "_new", "id", "_at")


def advanced(memories: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closings (id, valid_until) and edges when writes (id, namespace, state_key, at) advance their slots.

    The newest open value of the slot, but for the written row, is closed and superseded; ties go to
    the smaller id.
    """
    slot = ["namespace", "state_key"]
    w = writes.select(*slot, F.col("id").alias("new_id"), "at")
    live = memories.where(F.col("valid_until").isNull() & F.col("archived_at").isNull()).join(w, slot).where(F.col("id") != F.col("new_id"))
    head = live.withColumn("n", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("valid_from"), "id"))).where("n = 1")
    head = head.withColumn("revision", F.lit(0))
    return head.select("id", F.col("at").alias("valid_until")), _supersedes(head, "new_id", "id", "at")


def deleted(ids: DataFrame, memories: DataFrame, links: DataFrame, entities: DataFrame, citations: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """All tables without the memories ``ids`` and what refers to them, and an audit that keeps hashes only.

    Clusters (id, member_ids) lose the members, and go with fewer than two.
    """
    gone = ids.select("id").distinct()

    def without(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)

    members = clusters.select("id", F.posexplode("member_ids").alias("_n", "_m"))
    left = without(members, "_m").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_m"))), lambda x: x["_m"]).alias("member_ids"))
    left = left.where(F.size("member_ids") >= 2)
    audit = memories.join(gone, "id", "left_semi").select(F.col("id").alias("memory_id"), F.lit("deleted").alias("event"), F.sha2("content", 256).alias("content_hash"))
    return {"memories": without(memories, "id"), "links": without(without(links, "source_id"), "target_id"), "entities": without(entities, "memory_id"), "citations": without(citations, "memory_id"), "clusters": left, "audit": audit}


def merged(memories: DataFrame) -> DataFrame:
    """One row for each (namespace, type, content): the oldest, with the best importance, all tags and the
    first state key of its copies; pinned rows are never merged away.

    ``memories`` has tags (array).
    """
    same = Window.partitionBy("namespace", "type", F.sha2("content", 256))
    order = same.orderBy("created_at", "id")
    keyed = F.first("state_key", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = memories.select("*", F.row_number().over(order).alias("_n"), F.max("importance").over(same).alias("_i"), keyed.alias("_k"))
    tags = parts.select("namespace", "type", F.sha2("content", 256).alias("_h"), F.explode("tags").alias("t")).groupBy("namespace", "type", "_h").agg(F.array_sort(F.collect_set("t")).alias("_t"))
    heads = parts.where("_n = 1 OR pinned").withColumn("_h", F.sha2("content", 256)).join(tags, ["namespace", "type", "_h"], "left")
    first = F.col("_n") == 1
    changed = {"importance": F.when(first, F.col("_i")).otherwise(F.col("importance")), "state_key": F.when(first, F.coalesce("state_key", "_k")).otherwise(F.col("state_key")), "tags": F.when(first, F.coalesce("_t", "tags")).otherwise(F.col("tags"))}
    return heads.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in memories.columns])


def duplicate_claims(near: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges duplicate_of from new rows to their nearest older one in namespace and type, where cosine is
    high enough; pinned rows claim nothing. ``near``: (query_id, id, distance)."""
    a = memories.where(~F.col("pinned")).select(F.col("id").alias("query_id"), "namespace", "type", F.col("created_at").alias("_at"))
    b = memories.select("id", "namespace", "type", F.col("created_at").alias("_was"))
    cosine = F.greatest(1 - F.col("distance") * F.col("distance") / 2, F.lit(0.0))
    rows = near.withColumn("similarity", cosine).where(F.col("similarity") >= NEAR_DUPLICATE).join(a, "query_id").join(b, ["id", "namespace", "type"]).where("_was <= _at")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("duplicate_of").alias("link_type"), "similarity")


def consolidation_order(nodes: DataFrame) -> DataFrame:
    """Paths with their turn in a consolidation: deepest first, so that children come before parents."""
    return nodes.select("path", "depth", F.dense_rank().over(Window.orderBy(F.desc("depth"))).alias("round"))  # rows of the scope tree


def embeddings_due(rows: DataFrame, limit: int, at: int) -> DataFrame:
    """Rows that a worker claims for embedding: stale ones, oldest first, now pending since ``at``."""
    due = rows.where("embed_state = 'stale'").orderBy("created_at", "id").limit(limit)
    return due.withColumn("embed_state", F.lit("pending")).withColumn("claimed_at", F.lit(at))


def embedded(rows: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Pending rows after their vectors (id, embedding) came: fresh, or error where one is missing or of
    another dimension; all others as they were."""
    v = vectors.select("id", (F.size("embedding") == dimension).alias("_ok"))
    state = F.when(F.col("embed_state") != "pending", F.col("embed_state")).when(F.coalesce("_ok", F.lit(False)), "fresh").otherwise("error")
    return rows.join(v, "id", "left").withColumn("embed_state", state).select(*rows.columns)
