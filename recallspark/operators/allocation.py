"""Which turns of which sessions a query's evidence budget buys, and in which order.

Rows are units: (group, session_id, position, rank, role, chars); a group is one query, whose units are
bounded by the hits it asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("rank-greedy", "breadth-first", "statements-first")


def density(rank: Column, chars: Column) -> Column:
    return (1 / (1 + rank)) / F.greatest(F.lit(1), chars)


def ordered(units: DataFrame, policy: str = "rank-greedy", reserve: int = 0, group: str = "query_id") -> DataFrame:
    """Units with ``place``, their turn to be bought; the first ``reserve`` ranks are bought ahead."""
    if policy not in POLICIES:
        raise ValueError(f"unknown allocation policy {policy!r}; known: {', '.join(POLICIES)}")
    ahead = F.when(F.col("rank") < reserve, 0).otherwise(1) if reserve > 0 else F.lit(1)
    out = units.withColumn("_part", ahead).withColumn("_density", density(F.col("rank"), F.col("chars")))
    part = [group, "_part"]
    if policy == "rank-greedy":
        out = out.withColumn("_best", F.min("rank").over(Window.partitionBy(*part, "session_id")))
        order = ["_best", "session_id", "position"]
    elif policy == "breadth-first":
        deep = Window.partitionBy(*part, "session_id").orderBy(F.desc("_density"), "position")
        out = out.withColumn("_round", F.row_number().over(deep))
        order = ["_round", F.desc("_density"), "rank", "position", "session_id"]
    else:
        order = [F.when(F.col("role") == "user", 0).otherwise(1), "rank", "position", "session_id"]
    place = F.row_number().over(Window.partitionBy(group).orderBy("_part", *order))
    return out.withColumn("place", place).drop("_part", "_density", "_best", "_round")


def bought(units: DataFrame, budget: int, header: int, group: str = "query_id") -> DataFrame:
    """Units kept when bought by ``place``: a session's first pays its header and, but for the first
    session, two characters between; each pays one more for its line; what doesn't fit is passed over."""
    item = F.struct("place", "session_id", "position", F.col("chars").cast("long").alias("chars"))
    lists = units.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))  # a query's hits
    kind = dict(units.dtypes)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind['session_id']}>").alias("open"), F.array().cast("array<int>").alias("kept"))

    def buy(acc: Column, x: Column) -> Column:
        opening = ~F.array_contains(acc["open"], x["session_id"])
        cost = x["chars"] + 1 + F.when(opening, F.lit(header) + F.when(F.size(acc["open"]) > 0, 2).otherwise(0)).otherwise(0)
        now_open = F.when(opening, F.concat(acc["open"], F.array(x["session_id"]))).otherwise(acc["open"])
        taken = F.struct((acc["used"] + cost).cast("long").alias("used"), now_open.alias("open"), F.concat(acc["kept"], F.array(x["place"])).alias("kept"))
        return F.when(acc["used"] + cost <= budget, taken).otherwise(acc)

    kept = lists.select(group, F.explode(F.aggregate("items", start, buy)["kept"]).alias("place"))
    return units.join(kept, [group, "place"])


def assemble(sections: dict[str, DataFrame], shares: dict[str, float], budget: int, group: str = "query_id") -> DataFrame:
    """Sections (group, id, place, chars) packed in order; what one leaves over goes to the next, and an
    item that an earlier section has isn't bought again."""
    left = None
    for rows in sections.values():
        own = rows.select(group).distinct()
        left = own if left is None else left.union(own).distinct()
    left, done = left.withColumn("_over", F.lit(0).cast("long")), None
    for name, share in shares.items():
        rows = sections[name].select(group, "id", "place", F.col("chars").cast("long").alias("chars"))
        if done is not None:
            rows = rows.join(done.select(group, "id"), [group, "id"], "left_anti")
        lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("items"))  # a query's hits
        lists = left.join(lists, group, "left").withColumn("_limit", F.col("_over") + int(share * budget))
        start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
        buy = lambda acc, x: F.when(acc["used"] + x["chars"] <= F.col("_limit"), F.struct((acc["used"] + x["chars"]).alias("used"), F.concat(acc["kept"], F.array(x["place"])).alias("kept"))).otherwise(acc)
        packed = lists.select(group, "_limit", F.aggregate("items", start, buy).alias("r"))
        left = packed.select(group, (F.col("_limit") - F.coalesce("r.used", F.lit(0))).alias("_over"))
        kept = rows.join(packed.select(group, F.explode("r.kept").alias("place")), [group, "place"]).withColumn("section", F.lit(name))
        done = kept if done is None else done.unionByName(kept)
    return done
