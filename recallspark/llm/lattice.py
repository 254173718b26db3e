"""Near-duplicate embeddings by lattice hashing: random rotations decoded to E8 lattice points.

A random rotation splits every unit vector into tables of a few blocks of eight coordinates. Each
block is decoded to its nearest point of the scaled E8 lattice; a table's points together name a
cell. A vector is stored in one cell of each table, and looks into all neighbouring cells that a
vector close enough to link could fall into.

The search is exhaustive by construction. Vectors with cosine c differ by 2 - 2c in squared length,
which a rotation keeps and the tables share, so in some table the difference is at most that bound
divided by the number of tables. There, the other vector's lattice points differ from the own ones
by vectors of squared length 0, 2 or 4 only, and a cell can be reached only if crossing all its
bisecting planes costs no more than the bound. Pairs found are confirmed by cosine in double
precision, and counted in the first table in which their difference is within the bound, so each
link counts once without any table of pairs.

Labels keep apart by two hashes of 64 bits, one in a cell's name and one in its rows. Equal vectors of
a label form one class with a weight. Cells with many vectors are compared in
blocks, so that no task holds a whole cell.

Defined results: rows with a null label, or whose vector is null, empty, zero or holds null or
non-finite components, link with nothing; so do rows without vec_id, whose component_id is null and
which are kept; vectors of different length don't link; rows with equal vec_id and vector count as
separate rows of one node, and those with different vectors as one node that has the links of both; further columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import sorted_groups
from recallspark.operators.components import connected_components
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Scale of vectors against the lattice, blocks of eight coordinates in a table, and vectors of a
#: cell that are compared at a time.
SCALE, BLOCKS, BLOCK = 2.2, 2, 1024


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """Lattice vectors of squared length 2 and 4, doubled to integers."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0]
    out += [[4 * s if k == i else 0 for k in range(8)] for i in range(8) for s in (-1, 1)]
    for places in itertools.combinations(range(8), 4):
        for signs in itertools.product((-2, 2), repeat=4):
            v = [0] * 8
            for k, s in zip(places, signs):
                v[k] = s
            out.append(v)
    for i in range(8):
        for signs in itertools.product((-1, 1), repeat=8):
            v = list(signs)
            v[i] *= 3
            if sum(v) % 4 == 0:
                out.append(v)
    return np.array(out, np.int64)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to rows of eight coordinates, doubled to integers."""

    def nearest_even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2 != 0)
        worst = np.abs(off[odd]).argmax(axis=1)
        r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return r

    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


@lru_cache(maxsize=8)
def rotation(dim: int, blocks: int) -> np.ndarray:
    """Orthonormal columns, padded to whole tables."""
    size = -(-dim // (8 * blocks)) * 8 * blocks
    q, r = np.linalg.qr(np.random.default_rng(1_000_003 * dim + 17).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _point_hash(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of doubled lattice points."""
    h = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + (points[:, k] + 64).astype(np.uint64))
    return h


def _reach(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, point hash, squared cost) of all lattice points that a vector within ``most`` may decode to.

    Each row's own point comes first among its entries, with cost 0.
    """
    q = decode_e8(x)
    near = neighbours()
    v = near / 2.0
    size = np.sqrt((v**2).sum(axis=1))
    cost = (size / 2)[None, :] - (x - q / 2.0) @ (v / size[:, None]).T
    row, k = np.nonzero(cost <= most)
    rows = np.concatenate([np.arange(len(x)), row])
    points = np.concatenate([q, q[row] + near[k]])
    costs = np.concatenate([np.zeros(len(x)), np.maximum(cost[row, k], 0) ** 2])
    order = np.argsort(rows, kind="stable")
    return rows[order], _point_hash(points[order]), costs[order]


def cells(unit: np.ndarray, salt: np.ndarray, cosine: float, scale: float, blocks: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each table: every vector's own cell, and (vector, cell) of all cells it looks into."""
    turned = unit @ rotation(unit.shape[1], blocks) * scale
    tables = turned.shape[1] // (8 * blocks)
    most2 = (2 - 2 * cosine) / tables * scale**2 * (1 + 1e-9) + 1e-12
    out = []
    for t in range(tables):
        rows, keys, costs = np.arange(len(unit)), _mix(salt + np.uint64(t + 1)), np.zeros(len(unit))
        own = keys
        for b in range(blocks):
            x = turned[:, (t * blocks + b) * 8 : (t * blocks + b + 1) * 8]
            r, h, c = _reach(x, float(np.sqrt(most2)))
            first = np.searchsorted(r, np.arange(len(unit) + 1))
            own = _mix(own * np.uint64(31) + h[first[:-1]])
            n = np.diff(first)[rows]  # every entry so far meets all of its row's points
            at = np.repeat(first[:-1][rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            costs = np.repeat(costs, n) + c[at]
            keys = _mix(np.repeat(keys, n) * np.uint64(31) + h[at])
            rows = np.repeat(rows, n)
            ok = costs <= most2
            rows, keys, costs = rows[ok], keys[ok], costs[ok]
        out.append((own.view(np.int64), rows, keys.view(np.int64)))
    return out


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length and no nulls."""
    x = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(cosine: float, scale: float, blocks: int):
    """(key, table, id, own): the cell that stores each vector, and those it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 500):
                rb = big.slice(a, 500)
                ids, dims = rb.column("id").to_numpy(), rb.column("dim").to_numpy()
                salt = rb.column("salt").to_numpy().view(np.uint64)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    unit = _matrix(rb.column("v").take(pa.array(at)))
                    for t, (own, rows, key) in enumerate(cells(unit, salt[at], cosine, scale, blocks)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([own, key])), pa.array(np.full(len(own) + len(key), t, np.int32)), pa.array(np.concatenate([ids[at], ids[at][rows]])), pa.array(np.arange(len(own) + len(key)) < len(own)), pa.array(np.concatenate([own, own[rows]]))],
                            ["key", "table", "id", "stored", "home"],
                        )

    return run


def _spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the hits join, one for each row and column with a hit."""
    top = np.iinfo(np.int64).max
    of_right = right.copy()
    while True:
        of_left = np.minimum(np.where(hit, of_right[None, :], top).min(axis=1), left)
        new = np.minimum(np.where(hit, of_left[:, None], top).min(axis=0), of_right)
        if (new == of_right).all():
            break
        of_right = new
    l, r = hit.any(axis=1), hit.any(axis=0)
    return np.concatenate([left[l], right[r]]), np.concatenate([of_left[l], of_right[r]])


def _compare(cosine: float, blocks: int):
    """(id, n, other): weights of links by vector, and with n null the edges that join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["key", "mb", "qb"]):
            stored = cell.column("stored").to_numpy()
            m, q = np.flatnonzero(stored), np.flatnonzero(~stored)
            ids = cell.column("id").to_numpy()
            if not len(m) or not len(q) or (len(m) == 1 and len(q) == 1 and ids[m[0]] == ids[q[0]]):
                continue
            x = _matrix(cell.column("v"))
            hit = x[q] @ x[m].T >= cosine
            hit &= ids[q][:, None] != ids[m][None, :]
            kind = cell.column("kind").to_numpy()
            hit &= kind[q][:, None] == kind[m][None, :]
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            t = int(cell.column("table")[0].as_py())
            turned = x @ rotation(x.shape[1], blocks)
            width = 8 * blocks
            tables = turned.shape[1] // width
            bound = (2 - 2 * cosine) / tables * (1 + 1e-9) + 1e-12 / 25
            counted = np.zeros(len(q))
            weight = cell.column("weight").to_numpy()
            for s in range(0, len(a), 50_000):
                i, j = q[a[s : s + 50_000]], m[b[s : s + 50_000]]
                part = ((turned[i, : width * (t + 1)] - turned[j, : width * (t + 1)]) ** 2).reshape(len(i), t + 1, width).sum(axis=2) <= bound
                first = part[:, t] & ~part[:, :t].any(axis=1)
                counted += np.bincount(a[s : s + 50_000], weight[j] * first, len(q))
            some = counted > 0
            left, right = _spanning(hit, ids[q], ids[m])
            differ = left != right
            left, right = left[differ], right[differ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[q][some], left])), pa.array(np.concatenate([counted[some], np.zeros(len(left))]).astype(np.int64)), pa.array(np.concatenate([np.zeros(some.sum(), np.int64), right])), pa.array(np.arange(some.sum() + len(left)) < some.sum())],
                ["id", "n", "other", "is_count"],
            )

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, scale: float = SCALE, blocks: int = BLOCKS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    ensure_on_executors(spark)
    scratch = Scratch.of(spark)
    v = F.col("v")
    # every decoding of a link must stay among lattice differences of squared length 4 at most
    if scale * (2 - 2 * cosine) ** 0.5 > 0.89:
        raise ValueError("the scale is too large for links this far apart")
    vector = F.col(vector_col)
    if dict(vectors.dtypes).get(vector_col) != "array<float>":
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.col(label_col).alias("label"))
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = scratch.save(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    keyed = classes.select("id", "v", F.size("v").alias("dim"), F.xxhash64("label", F.size("v")).alias("salt"))
    keys = scratch.save(keyed.mapInArrow(_keys(cosine, scale, blocks), "key long, table int, id long, stored boolean, home long"))
    filled = keys.where("stored").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    looking = keys.where("not stored").join(filled, "key").where("m > 1 or key <> home").select("key", "table", "id", "m")
    looking = scratch.save(looking)
    asked = looking.groupBy("key").agg(F.count(F.lit(1)).alias("q"), F.first("m").alias("m"))
    asked = asked.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("mbs"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qbs"))
    h = F.xxhash64("id", F.lit(5))
    one = lambda n: F.pmod(h, F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = keys.where("stored").select("key", "table", "id").join(asked, "key").select("key", "table", "id", one("mbs").alias("mb"), every("qbs").alias("qb"), F.lit(True).alias("stored"))
    queries = looking.select("key", "table", "id").join(asked, "key").select("key", "table", "id", every("mbs").alias("mb"), one("qbs").alias("qb"), F.lit(False).alias("stored"))
    filled_cells = members.unionByName(queries).join(classes.select("id", "v", "weight", F.xxhash64(F.lit("kind"), "label").alias("kind")), "id")
    dealt = filled_cells.repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb")
    found = scratch.save(dealt.mapInArrow(_compare(cosine, blocks), "id long, n long, other long, is_count boolean"))
    scratch.release_shuffles()
    counts = found.where("is_count").groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("not is_count").select(F.col("id").alias("a"), F.col("other").alias("b")))
    summed = classes.join(counts, "id", "left").join(labels, "id", "left")
    summed = summed.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(summed, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_lattice(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
