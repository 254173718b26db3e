"""Turn memories assembled into one dated context: intervals of turns around hits, united and bought within one budget.

A hit holds some turns and brings its neighbours. Intervals of a session unite: a turn counts once, with the
best rank that reached it. Sessions are bought in the order of their best hits, or statements of users across
all sessions before any reply; what was bought is shown oldest session first, turns in order.

A query's turns are bounded by its hits and their windows, so they are folded in one row; hits and turns of
all queries are joined as tables.

Defined results: hits outside their session's turns or of unknown sessions bring nothing; a turn without role is
its text alone; null texts are empty; sessions without date are shown last, as undated; queries that buy nothing give no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.episodes import dated


def covered_turns(hits: DataFrame, turns: DataFrame, ingest: int = 1, render: int = 1) -> DataFrame:
    """(query_id, session_id, turn, rank): the turns that hits (query_id, session_id, turn, rank) hold or touch, each with its best rank.

    ``turns``: session_id, turn from 0. A hit holds ``ingest`` turns from its own on; ``render`` more come from either side.
    """
    ends = turns.groupBy("session_id").agg(F.max("turn").alias("end"))
    inside = hits.join(ends, "session_id").where((F.col("turn") >= 0) & (F.col("turn") <= F.col("end")))
    low = F.greatest(F.lit(0), F.col("turn") - render)
    high = F.least(F.col("end"), F.col("turn") + ingest - 1 + render)
    spans = inside.where(high >= low).select("query_id", "session_id", "rank", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("turn"))
    return spans.groupBy("query_id", "session_id", "turn").agg(F.min("rank").alias("rank"))


def _by_session(items: Column, budget: int) -> Column:
    """Indices bought session by session; a session's header is paid with its first line that fits."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("groups"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("lines"), F.array().cast("array<int>").alias("kept"))

    def buy(acc: Column, x: Column) -> Column:
        new = ~x["key"].eqNullSafe(acc["key"])
        closing = new & (acc["lines"] > 0)
        groups = acc["groups"] + F.when(closing, 1).otherwise(0)
        used = acc["used"] + F.when(closing, acc["length"] + F.when(groups > 1, 2).otherwise(0)).otherwise(0)
        length, lines = F.when(new, x["header"]).otherwise(acc["length"]), F.when(new, 0).otherwise(acc["lines"])
        longer = length + 1 + x["chars"]
        fits = used + longer + F.when(groups > 0, 2).otherwise(0) <= budget
        return F.struct(
            used.cast("long").alias("used"), groups.alias("groups"), x["key"].alias("key"), F.when(fits, longer).otherwise(length).cast("long").alias("length"),
            (lines + fits.cast("int")).alias("lines"), F.when(fits, F.concat(acc["kept"], F.array(x["i"]))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(items, start, buy)["kept"]


def _statements_first(items: Column, budget: int) -> Column:
    """Indices bought one by one; a session's first line pays its header, and two characters after other sessions."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("kept"))

    def buy(acc: Column, x: Column) -> Column:
        first = ~F.array_contains(acc["open"], x["key"])
        cost = x["chars"] + 1 + F.when(first, x["header"] + F.when(F.size(acc["open"]) > 0, 2).otherwise(0)).otherwise(0)
        taken = F.struct((acc["used"] + cost).cast("long").alias("used"), F.when(first, F.concat(acc["open"], F.array(x["key"]))).otherwise(acc["open"]).alias("open"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))
        return F.when(acc["used"] + cost <= budget, taken).otherwise(acc)

    return F.aggregate(items, start, buy)["kept"]


def assembled_turns(hits: DataFrame, turns: DataFrame, budget: int, ingest: int = 1, render: int = 1, statements_first: bool = False, reserve: int = 0) -> DataFrame:
    """(query_id, session_id, turn, rank, line, header, created_at): the turns that each query's budget buys.

    ``turns``: session_id, turn, role, text, created_at (of the session). The first ``reserve`` ranks go ahead of statements.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = F.when(role == "", text).otherwise(F.concat(role, F.lit(": "), text)).alias("line")
    header = F.concat(F.lit("["), dated(F.col("created_at")), F.lit("]")).alias("header")
    told = turns.select("session_id", F.col("turn").cast("long").alias("turn"), (role == "user").alias("statement"), line, header, "created_at")
    rows = covered_turns(hits, turns, ingest, render).join(told, ["session_id", "turn"])
    if statements_first:
        order = [F.when(F.col("rank") < reserve, 0).otherwise(1), F.when(F.col("statement"), 0).otherwise(1), "rank", "session_id", "turn"]
    else:
        rows = rows.withColumn("best", F.min("rank").over(Window.partitionBy("query_id", "session_id")))
        order = ["best", F.asc_nulls_last("created_at"), "session_id", "turn"]
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    item = F.struct("i", F.col("session_id").cast("string").alias("key"), F.length("header").cast("long").alias("header"), F.length("line").cast("long").alias("chars"))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # a query's hits and their windows
    pick = _statements_first if statements_first else _by_session
    kept = lists.select("query_id", F.explode(pick(F.col("items"), budget)).alias("i"))
    return rows.join(kept, ["query_id", "i"]).select("query_id", "session_id", "turn", "rank", "line", "header", "created_at")


def blocks(kept: DataFrame) -> DataFrame:
    """(query_id, session_id, block, text): a query's context, one block a session, oldest first."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])  # bounded by the budget
    each = kept.groupBy("query_id", "session_id").agg(F.first("created_at").alias("created_at"), F.first("header").alias("header"), lines.alias("lines"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("created_at"), "session_id")
    return each.select("query_id", "session_id", F.row_number().over(w).alias("block"), F.concat(F.col("header"), F.lit("\n"), F.array_join("lines", "\n")).alias("text"))


def summary(hits: DataFrame, turns: DataFrame, kept: DataFrame, ingest: int = 1, render: int = 1) -> DataFrame:
    """(query_id, used_chars, sessions_served, turns_served, skipped_sessions) of every query that covers turns."""
    own = covered_turns(hits, turns, ingest, render).groupBy("query_id").agg(F.count_distinct("session_id").alias("sessions"))
    text = blocks(kept).groupBy("query_id").agg(F.count(F.lit(1)).alias("served"), F.sum(F.length("text") + 2).alias("chars"))
    n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = own.join(text, "query_id", "left").join(n, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", F.greatest(zero("chars") - 2, F.lit(0)).alias("used_chars"), zero("served").alias("sessions_served"), zero("n").alias("turns_served"), (F.col("sessions") - zero("served")).alias("skipped_sessions"))
