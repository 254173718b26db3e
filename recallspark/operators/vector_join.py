"""Exact nearest vectors of many queries: cells around pivots, and block by block matrix products.

Every vector lies in the cell of its nearest pivot. By the triangle inequality a cell holds nothing closer to
a query than its distance to the pivot less the cell's radius, and so many vectors within the sum of both;
so each query knows cells that are enough and goes to no others. Both sides of a cell are dealt into blocks of
bounded size, and each task compares two blocks by one matrix product. Products choose candidates, with a
margin for rounding; distances are then taken from differences, as by brute force. The table is
read once to be dealt, however many queries there are.

Defined results: null vectors find nothing and are not found; equal distances go to the smaller id; a query
doesn't find its own id; ids of vectors are unique, those of queries may repeat with equal vectors; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Pivots, and rows of a block on either side, about.
PIVOTS, BLOCK = 64, 4096


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices, by a product, never below 0."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def _slack(*matrices: np.ndarray) -> float:
    """What rounding may add to or take from a squared distance by a product."""
    return 1e-9 * (1 + 4 * max((float((m * m).sum(1).max()) for m in matrices if m.size), default=0.0))


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, below: float | None = None, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance): the k nearest other vectors of every query, closer than ``below``.

    Both tables are (id, embedding), of one dimension.
    """
    spark = vectors.sparkSession
    ensure_on_executors(spark)
    scratch = Scratch.of(spark)
    out = "query_id long, id long, distance double"
    whole = lambda t: t.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = whole(vectors).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # bounded by the pivots
    if not chosen:
        return spark.createDataFrame([], out)
    centre = np.array([r["embedding"] for r in chosen], float)

    def assign(batches):
        for rb in batches:
            if rb.num_rows:
                d = _far(_matrix(rb.column("embedding")), centre)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("embedding"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "embedding", "cell", "far"])

    held = scratch.save(whole(vectors).mapInArrow(assign, "id long, embedding array<double>, cell int, far double"))
    told = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).orderBy("cell").collect()  # one row a cell
    cells, counts = np.array([r["cell"] for r in told]), np.array([r["n"] for r in told])
    least, most = np.array([r["least"] for r in told]), np.array([r["most"] for r in told])
    own = centre[cells]

    def ask(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            q = _matrix(rb.column("embedding"))
            d = _far(q, own)
            slack = math.sqrt(_slack(q, centre))
            order = np.argsort(d + most, axis=1)
            enough = (np.cumsum(counts[order], axis=1) > k).argmax(axis=1)  # one more, for the query itself
            limit = np.take_along_axis(d + most, order, 1)[np.arange(len(d)), enough]
            limit = np.where(counts.sum() > k, limit + 2 * slack, np.inf)
            if below is not None:
                limit = np.minimum(limit, below)
            near = np.maximum(d - most, least - d) <= limit[:, None] + 2 * slack
            row, at = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([rb.column("id").take(pa.array(row)), rb.column("embedding").take(pa.array(row)), pa.array(cells[at], pa.int32()), pa.array(limit[row])], ["query_id", "embedding", "cell", "limit"])

    asked = scratch.save(whole(queries).mapInArrow(ask, "query_id long, embedding array<double>, cell int, limit double"))
    parts = asked.groupBy("cell").count().collect()  # one row a cell
    blocks = {r["cell"]: [max(1, math.ceil(r["count"] / block)), 1] for r in parts}
    for c, n in zip(cells.tolist(), counts.tolist()):
        if c in blocks:
            blocks[c][1] = max(1, math.ceil(n / block))
    if not blocks:
        return spark.createDataFrame([], out)
    sizes = F.broadcast(spark.createDataFrame([(c, a, b) for c, (a, b) in blocks.items()], "cell int, parts long, subs long"))  # one row a cell
    deal = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).withColumn("sub", deal("subs")).drop("parts", "subs")
    right = held.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs"))).withColumn("part", deal("parts")).drop("parts", "subs", "far")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = ([], [], [])
        if a.num_rows and b.num_rows:
            q, v = _matrix(a.column("embedding")), _matrix(b.column("embedding"))
            asks, ids, limit = (t.column(c).to_numpy() for t, c in ((a, "query_id"), (b, "id"), (a, "limit")))
            slack = _slack(q, v)
            square = (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T)
            top = min(k + 1, len(ids))
            edge = np.minimum(np.partition(square, top - 1, axis=1)[:, top - 1], limit**2) + 2 * slack if top else limit**2
            for i in range(len(asks)):
                at = np.flatnonzero((square[i] <= edge[i]) & (ids != asks[i]))
                d = np.sqrt(((v[at] - q[i]) ** 2).sum(axis=1))
                if below is not None:
                    at, d = at[d < below], d[d < below]
                best = np.lexsort((ids[at], d))[:k]
                for x, y in zip(found, ([asks[i]] * len(best), ids[at[best]], d[best])):
                    x.extend(y)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "distance": pa.array(found[2], pa.float64())})

    by = ("cell", "sub", "part")
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, out)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
