"""Episodes: immutable evidence turns, who may read them, how they are found, cited, swept and served.

Columns: id, namespace, session_id, source, external_id, role, content, turn_index, occurred_at,
retention, expires_at, source_state, visibility, owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators import allocation, retrieval, visibility
from recallspark.plans.scratch import Scratch

#: What stands for the importance and the uses of an episode, and its content's weight.
IMPORTANCE, ACCESS_COUNT = 0.5, 0
#: A turn without index comes after all that have one.
LAST_TURN = 2_147_483_647


def readable(episodes: DataFrame, scope: str | None, caller: str | None, now: int, subtree: bool = True, exclude: str | None = None, include_expired: bool = False, include_history: bool = False) -> DataFrame:
    """Episodes in scope that the caller may see, of current sources, not expired (at ``now`` means expired)."""
    own = visibility.visible_to(caller, F.col("visibility"), F.col("owner"))
    if scope is not None:
        own = own & visibility.in_scope(F.col("namespace"), scope, subtree)
    if exclude is not None:
        own = own & ~visibility.in_scope(F.col("namespace"), exclude)
    if not include_history:
        own = own & (F.col("source_state") == "current")
    if not include_expired:
        own = own & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return episodes.where(own)


def selected(episodes: DataFrame, sessions: DataFrame, now: int, scope: str | None = None, source: str | None = None, external_ids: list[str] | None = None, before: int | None = None, expired: bool = False, session_ended: bool = False) -> DataFrame:
    """Episodes that a delete names. An empty list of ids names nothing; undated ones are never before a
    time; expired and of a closed session are alternatives. Naming nothing at all is refused."""
    if scope is None and source is None and external_ids is None and before is None and not expired and not session_ended:
        raise ValueError("a delete must name a scope, a source, ids, a time or an expiry")
    out = episodes
    if scope is not None:
        out = out.where(visibility.in_scope(F.col("namespace"), scope))
    if source is not None:
        out = out.where(F.col("source") == source)
    if external_ids is not None:
        out = out.where(F.col("external_id").isin(external_ids) if external_ids else F.lit(False))
    if before is not None:
        out = out.where(F.col("occurred_at").isNotNull() & (F.col("occurred_at") < before))
    ended: Column = F.lit(False)
    if expired:
        ended = ended | (F.col("expires_at").isNotNull() & (F.col("expires_at") <= now))
    if session_ended:
        closed = sessions.where(F.col("ended_at").isNotNull()).select(F.col("id").alias("session_id"), F.lit(True).alias("_closed")).distinct()
        out = out.join(closed, "session_id", "left")
        ended = ended | ((F.col("retention") == "session") & F.coalesce("_closed", F.lit(False)))
    if expired or session_ended:
        out = out.where(ended)
    return out.select(*episodes.columns)


def swept(episodes: DataFrame, sessions: DataFrame, citations: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of episodes and citations when expired ones and those of closed sessions go, and counts
    (table, deleted) of what went."""
    gone = Scratch.of(episodes.sparkSession).save(selected(episodes, sessions, now, expired=True, session_ended=True).select("id"))
    lost = citations.join(gone.select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    counts = gone.agg(F.lit("episodes").alias("table"), F.count(F.lit(1)).alias("deleted")).union(lost.agg(F.lit("memory_episodes").alias("table"), F.count(F.lit(1)).alias("deleted")))
    return episodes.join(gone, "id", "left_anti"), citations.join(gone.select(F.col("id").alias("episode_id")), "episode_id", "left_anti"), counts


def session_turns(episodes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Turns with ``position`` in their session (from 0) and ``started``, the session's first known time."""
    if sessions is not None:
        episodes = episodes.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    w = Window.partitionBy("session_id")
    order = w.orderBy(F.coalesce("turn_index", F.lit(LAST_TURN)), F.asc_nulls_first("occurred_at"), "id")
    return episodes.select("*", (F.row_number().over(order) - 1).alias("position"), F.min("occurred_at").over(w).alias("started"))


def cited(citations: DataFrame, episodes: DataFrame, memory_id: int | None = None) -> DataFrame:
    """Evidence of memories, with ``place`` from the oldest episode on."""
    if memory_id is not None:
        citations = citations.where(F.col("memory_id") == memory_id)
    rows = citations.join(episodes.select(F.col("id").alias("episode_id"), "source", "external_id", "session_id", "occurred_at"), "episode_id")
    w = Window.partitionBy("memory_id").orderBy(F.asc_nulls_first("occurred_at"), "episode_id", F.asc_nulls_first("span_start"))
    return rows.withColumn("place", F.row_number().over(w))


def _new_citations(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose memory, episode and span start are not stored yet, each once."""
    key = ["memory_id", "episode_id", "_start"]
    start = F.coalesce("span_start", F.lit(-1)).alias("_start")
    fresh = rows.select("*", start).dropDuplicates(key)
    return fresh.join(stored.select("memory_id", "episode_id", start), key, "left_anti").drop("_start")


def inherited(citations: DataFrame, derived: DataFrame, episodes: DataFrame) -> DataFrame:
    """Citations that derived memories (memory_id, from_id) take over from those they were made of, spans
    included, of current episodes only, without those that they have."""
    live = episodes.where("source_state = 'current'").select(F.col("id").alias("episode_id"))
    source = citations.select(F.col("memory_id").alias("from_id"), "episode_id", "span_start", "span_end")
    rows = derived.where(F.col("memory_id") != F.col("from_id")).join(source, "from_id").join(live, "episode_id", "left_semi")
    return _new_citations(rows.select("memory_id", "episode_id", "span_start", "span_end"), citations)


def linked_by_task(tasks: DataFrame, episodes: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations of a task's summary memory (task_id, memory_id): all current episodes of the task, whole."""
    rows = tasks.join(episodes.where("source_state = 'current'").select("task_id", F.col("id").alias("episode_id")), "task_id")
    none = F.lit(None).cast("int")
    return _new_citations(rows.select("memory_id", "episode_id", none.alias("span_start"), none.alias("span_end")), citations)


def search(episodes: DataFrame, terms: list[str], now: int, k: int = 10, kind: str = "semantic", vector: DataFrame | None = None) -> DataFrame:
    """The k best episodes of a scope: lexical matches (the shortest, where they are too many) and vectors
    fused as for memories, with constant importance and uses; undated episodes count as of now."""
    window = max(5 * k, 50)
    lexical = retrieval.lexical_search(episodes, terms, window=window)
    rows = episodes.select("id", F.coalesce("occurred_at", F.lit(now)).alias("created_at"), F.lit(None).cast("long").alias("last_accessed"), F.lit(IMPORTANCE).alias("importance"), F.lit(ACCESS_COUNT).alias("access_count"))
    return retrieval.fuse(rows, {"fts": lexical}, vector, now, k, kind)


def dated(at: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(at), "yyyy-MM-dd HH:mm 'utc'"), F.lit("undated"))


def context(hits: DataFrame, turns: DataFrame, budget: int, ingest: int = 1, render: int = 1, policy: str = "rank-greedy", reserve: int = 0) -> DataFrame:
    """Blocks (query_id, session_id, block, text) of the turns that a query's budget buys, oldest first.

    ``hits``: (query_id, id, rank from 0). Each hit covers the turns beside it; a turn keeps its best
    rank. ``turns`` come from ``session_turns``. A block is a date line and its turns in order.
    """
    at = turns.select("id", "session_id", "position")
    near = hits.join(at, "id").select("query_id", "session_id", "rank", F.explode(F.sequence(F.greatest(F.col("position") - render, F.lit(0)), F.col("position") + ingest - 1 + render)).alias("position"))
    best = near.groupBy("query_id", "session_id", "position").agg(F.min("rank").alias("rank"))
    units = best.join(turns.select("session_id", "position", "role", "content", "started", F.length("content").alias("chars")), ["session_id", "position"])
    header = len("[2025-01-01 00:00 utc]")
    ordered = allocation.ordered(units.drop("content", "started"), policy, reserve)
    kept = allocation.bought(ordered, budget, header).select("query_id", "session_id", "position")
    lines = kept.join(units, ["query_id", "session_id", "position"])
    blocks = lines.groupBy("query_id", "session_id").agg(F.min("started").alias("started"), F.sort_array(F.collect_list(F.struct("position", "content"))).alias("l"))  # bounded by the budget
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("started"), "session_id")
    text = F.concat_ws("\n", F.concat(F.lit("["), dated(F.col("started")), F.lit("]")), F.transform("l", lambda x: x["content"]))
    return blocks.select("query_id", "session_id", F.row_number().over(w).alias("block"), text.alias("text"))

