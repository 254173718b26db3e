"""Connected components of an edge table, by contracting stars.

Each step hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones;
the number of steps is logarithmic in practice. Minima are aggregated before rows meet them again in
a join, so a node with very many links is split like any other skewed join key. Every step is
written to the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.plans.scratch import Scratch

MOST_STEPS = 60


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
    return tuple(r)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    m = _least(edges)
    moved = edges.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) of every node with an edge; component is the smallest reachable id.

    Edges are undirected; loops, repeated edges and edges with a null end connect nothing.
    """
    scratch = Scratch.of(edges.sparkSession)
    a, b = F.col(left), F.col(right)
    start = edges.where(a.isNotNull() & b.isNotNull())
    nodes = start.select(a.alias("id")).union(start.select(b.alias("id"))).distinct()
    now = scratch.save(start.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _signature(now)
    for _ in range(MOST_STEPS):
        if seen[0] == 0:
            break
        then = scratch.save(_small_star(_large_star(now)))
        was, seen = seen, _signature(then)
        scratch.drop(now)
        now = then
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle within {MOST_STEPS} steps")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
