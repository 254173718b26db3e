"""Write-path and upkeep operators: ingest, duplicates, state slots, digests and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import normalize_identifiers

def new_items(batch: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Items not stored yet, one for each identity: the first of the batch by ``position``."""
    w = Window.partitionBy(*identity).orderBy("position")
    first = batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return first.join(stored.select(*identity).distinct(), identity, "left_anti")


def ingest_results(batch: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """(position, status, id): one result for each item of a batch, in order.

    An item without external id or content is rejected; one that is stored, or that came earlier in the
    batch, is a duplicate and gets that row's id; all others are ingested under their own.
    """
    bad = (F.coalesce("external_id", F.lit("")) == "") | (F.coalesce("content", F.lit("")) == "")
    rows = batch.withColumn("_bad", bad)
    w = Window.partitionBy(*identity, "_bad").orderBy("position")
    rows = rows.withColumn("_first", F.first("id").over(w)).withColumn("_n", F.row_number().over(w))
    known = stored.groupBy(*identity).agg(F.min("id").alias("_was"))
    rows = rows.join(known, identity, "left")
    status = F.when(F.col("_bad"), "rejected").when(F.col("_was").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("ingested")
    return rows.select("position", status.alias("status"), F.when(~F.col("_bad"), F.coalesce("_was", "_first")).alias("id"))


def listed(memories: DataFrame, limit: int = 20, tags: list[str] | None = None) -> DataFrame:
    """Newest rows first; tags, compared without case, are looked at after the limit."""
    top = memories.orderBy(F.desc("created_at"), "id").limit(limit)
    if not tags:
        return top
    return top.where(F.exists("tags", lambda t: F.lower(t).isin(*[x.lower() for x in tags])))


def roster(memories: DataFrame, now: int, k: int = 20, chars: int = 160) -> DataFrame:
    """The k rows that a session starts from, with previews: pinned procedures first, then by importance and
    whether they are of the last 30 days, then newest."""
    recent = F.when(F.col("created_at") >= now - 30 * 86_400_000, 0.5).otherwise(0.0)
    rank = 0.5 * F.col("importance") + recent
    preview = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("…"))).otherwise(F.col("content"))
    rows = memories.select("id", "type", "created_at", F.coalesce("pinned", F.lit(False)).alias("pinned"), rank.alias("rank"), preview.alias("preview"))
    return rows.orderBy(F.desc(F.col("pinned") & (F.col("type") == "procedure")), F.desc("rank"), F.desc("created_at"), F.desc("id")).limit(k)


def backfilled(rows: DataFrame) -> DataFrame:
    """Old rows with what they lack: a namespace from their project, and the text of their identifiers."""
    return rows.withColumn("namespace", F.coalesce("namespace", "project_path")).withColumn("ident_text", F.coalesce("ident_text", normalize_identifiers(F.col("content"))))


def cross_owner_reads(reads: DataFrame, memories: DataFrame) -> DataFrame:
    """Audit rows of reads (reader, id, at) that served a row of another owner."""
    rows = reads.join(memories.select("id", "namespace", "owner"), "id")
    return rows.where(~F.col("owner").eqNullSafe(F.col("reader"))).select("reader", "owner", "namespace", "id", "at")


def resolved_credentials(tokens: DataFrame, stored: DataFrame, grants: DataFrame, now: int) -> DataFrame:
    """(token, principal, prefixes): what tokens may read, by their digests; revoked and expired ones resolve
    to nobody. ``stored``: principal, token_hash, revoked_at, expires_at. ``grants``: principal, prefix, verb."""
    live = stored.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    who = tokens.withColumn("token_hash", F.sha2("token", 256)).join(live.select("principal", "token_hash"), "token_hash", "left")
    can = grants.where("verb = 'read'").groupBy("principal").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    return who.join(can, "principal", "left").select("token", "principal", F.coalesce("prefixes", F.array().cast("array<string>")).alias("prefixes"))


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """Per repeated (namespace, type, content): the keeper (oldest, then least id), copies and best importance."""
    return (
        memories.groupBy("namespace", "type", F.sha2("content", 256).alias("digest"))
        .agg(F.min(F.struct("created_at", "id")).alias("k"), F.count(F.lit(1)).alias("copies"), F.max("importance").alias("importance"))
        .where("copies > 1")
        .select(F.col("k.id").alias("keeper"), "copies", "importance")
    )


def burst_families(memories: DataFrame, now: int, days: int = 7, prefix: int = 48, least: int = 5, hidden: DataFrame | None = None) -> DataFrame:
    """Recent rows of a namespace and type that share a beginning, where there are too many; superseded
    rows (``hidden``: id) don't count."""
    recent = memories.where(F.col("created_at") >= now - days * 86_400_000)
    if hidden is not None:
        recent = recent.join(hidden, "id", "left_anti")
    return (
        recent.groupBy("namespace", "type", F.substring("content", 1, prefix).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("family"), F.max_by("id", F.struct("importance", F.negative("id"))).alias("keeper"))
        .where(F.col("family") >= least)
        .select("namespace", "type", "family", "keeper")
    )


def state_history(memories: DataFrame) -> DataFrame:
    """Every value of a slot with the time its successor closed it, and whether it is the head."""
    w = Window.partitionBy("namespace", "state_key").orderBy("valid_from", "id")
    keyed = memories.where(F.col("state_key").isNotNull())
    return keyed.select("id", "namespace", "state_key", "valid_from", F.lead("valid_from").over(w).alias("closed_at")).withColumn("is_head", F.col("closed_at").isNull())


def state_at(memories: DataFrame, when: int) -> DataFrame:
    """The latest value of each slot that is valid at a time."""
    ok = memories.where(F.col("state_key").isNotNull() & (F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") >= when)))
    return ok.groupBy("namespace", "state_key").agg(F.max_by("id", F.struct("valid_from", "created_at", "id")).alias("id"))


def promotion(memories: DataFrame, least: int = 8, chars: int = 160, nodes: DataFrame | None = None) -> DataFrame:
    """For scopes with enough rows, an extract of the first three of their ten most important ones, and the
    ids of those ten, which the pattern is promoted from. With ``nodes`` only synthetic leaf scopes count."""
    if nodes is not None:
        leaves = nodes.where("is_synthetic AND child_count = 0").select(F.col("path").alias("namespace"))
        memories = memories.join(leaves, "namespace", "left_semi")
    w = Window.partitionBy("namespace").orderBy(F.desc("importance"), "id")
    top = memories.withColumn("n", F.row_number().over(w)).where("n <= 10")
    lines = top.groupBy("namespace").agg(F.sort_array(F.collect_list(F.struct("n", "id", F.substring("content", 1, chars).alias("c")))).alias("l"))
    many = memories.groupBy("namespace").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    extract = F.concat_ws(" | ", F.transform(F.slice("l", 1, 3), lambda x: x["c"]))
    return many.join(lines, "namespace").select("namespace", "rows", extract.alias("extract"), F.transform("l", lambda x: x["id"]).alias("promoted_from"))


def roll_up(memories: DataFrame) -> DataFrame:
    """Rows, never-accessed rows and last activity of every scope and all above it."""
    from recallspark.functions.text import ancestors

    per = memories.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("access_count") == 0).alias("never"), F.max("created_at").alias("last"))
    return per.select(F.explode(ancestors(F.col("namespace"))).alias("path"), "n", "never", "last").groupBy("path").agg(F.sum("n").alias("rows"), F.sum("never").alias("never_accessed"), F.max("last").alias("last_activity"))


def idle_sessions(memories: DataFrame, now: int, hours: int = 12) -> DataFrame:
    return memories.groupBy("session_id").agg(F.max("created_at").alias("last")).where(F.col("last") < now - hours * 3_600_000)
