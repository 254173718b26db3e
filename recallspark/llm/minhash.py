"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), a MinHash signature, band keys of the
   signature, and an odd sketch: each sample (place, minimum) flips one bit of a bitmap, so that the
   population count of two bitmaps' XOR estimates how many samples differ.
2. Texts with equal sets form one class, which goes on as one node with one of their texts. This
   pre-aggregates groups of exact copies of any size.
3. Within each band bucket all members are compared with one centre, again with another centre while
   much is left; members of one component are never compared again. What is left in buckets of
   several components is compared exhaustively: in blocks, each member outside the bucket's largest
   component against all members of other components. No bucket is capped.
4. Pairs whose sizes allow the threshold and whose sketches agree well enough (a margin of more than
   five standard deviations below the threshold) are confirmed on the full sets.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts with
fewer words than a shingle have their whole word sequence as one; rows with equal doc_id are one
node, with the links of all their texts; rows without doc_id are nodes by their sets, and come after
all ids: a component without ids has component_id null and its rows are kept; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.common import lean, small_slices, sorted_groups
from recallspark.operators.components import connected_components
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
#: Rounds of centres at most, comparisons left for each bucket row that end them, and members in a
#: block of the exhaustive comparison.
MOST_ROUNDS, PAIRS_A_ROW, BLOCK = 8, 500, 512
WORDS_KNOWN = 300_000
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(29))) * _K
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts; keeps a bounded table of word hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def _word(self, w: bytes) -> int:
        if len(self.known) >= WORDS_KNOWN:
            self.known.clear()
        h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: only A-Z fold, only ASCII white space splits
        if not words:
            return np.zeros(0, np.uint64)
        get, make = self.known.get, self._word
        h = np.array([get(w) or make(w) for w in words], np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, np.uint64(len(h) if k < self.words else self.words), np.uint64)
        for i in range(k):
            out = _mix(out * _K + h[i : i + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 256):
        np.minimum(low, (shingles[a : a + 256, None] * _A + _B).min(axis=0), out=low)
    return low >> np.uint64(16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of a matrix of signatures, (n, BANDS) as signed integers."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        out = _mix(out * _K + parts[:, :, i])
    return out.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps of signatures, (n, SKETCH_BITS / 64) as signed integers."""
    place = _mix(sig * _K + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    counts = np.zeros((len(sig), SKETCH_BITS), np.uint8)
    np.add.at(counts, (np.arange(len(sig))[:, None], place.astype(np.int64)), 1)
    return np.packbits(counts & 1, axis=1).view(np.int64)


def most_odd_bits(threshold: float, deviations: float = 5.5) -> int:
    """XOR bits that a pair at the threshold stays below but for that many standard deviations."""
    differ = 2 * SAMPLES * (1 - threshold)
    spread = 2 * math.sqrt(SAMPLES * threshold * (1 - threshold))
    bits = lambda d: SKETCH_BITS / 2 * (1 - math.exp(-2 * d / SKETCH_BITS))
    mean, by_samples = bits(differ), bits(differ + spread) - bits(differ)
    by_parity = math.sqrt(max(1.0, mean * (1 - mean / SKETCH_BITS) - mean / 2))
    return math.ceil(mean + deviations * math.hypot(by_samples, by_parity))


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tag, n_shingles, cls (128-bit digest of the set), bands and sketch; null without shingles.

    ``docs``: doc_id, tag (a hash of the text) and text.
    """
    ensure_on_executors(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for rb in small_slices(batches, "text", SLICE_BYTES):
            counts, cls, sigs = [], [], []
            for t in rb.column("text").cast(pa.large_binary()).to_pylist():
                s = shingle(t or b"")
                counts.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s))
            sig = np.array(sigs, np.uint64)
            some = np.array(counts) > 0
            bands, sketch = list(band_keys(sig)), list(odd_sketch(sig))
            for i in np.flatnonzero(~some).tolist():
                bands[i] = sketch[i] = None
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("tag"), pa.array(counts, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "tag", "n_shingles", "cls", "bands", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id long, tag long, n_shingles long, cls binary, bands array<long>, sketch array<long>")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return col.combine_chunks().flatten().to_numpy().reshape(len(col), -1)


def _plausible(na: Column, nb: Column, sa: Column, sb: Column, threshold: float) -> Column:
    bits = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        bits = bits + F.bit_count(F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i))))
    return (100 * F.least(na, nb) >= round(100 * threshold) * F.greatest(na, nb)) & (bits <= most_odd_bits(threshold))


def _confirm(pairs: DataFrame, source: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. ``source``: doc_id, text."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, left = Shingler(words), None, None
        for rb in batches:
            keep = []
            ids, other = rb.column("a").to_pylist(), rb.column("b").to_pylist()
            ta, tb = rb.column("text_a").cast(pa.large_binary()), rb.column("text_b").cast(pa.large_binary())
            for i in range(rb.num_rows):
                if last != ids[i] or left is None:
                    last, left = ids[i], shingle(ta[i].as_py() or b"")
                right = shingle(tb[i].as_py() or b"")
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(mask), rb.column("b").filter(mask)], ["a", "b"])

    text = source.select("doc_id", "text")
    one = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def _exhaustive(members: DataFrame, text: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) that join all components of a bucket that any link between its members joins.

    ``members``: key, rep, comp, n, sketch, bands. Members outside the bucket's largest component meet all
    members of the bucket, in cells of two blocks. A cell counts common shingles of plausible pairs
    of different components by an inverted index, exactly, and passes over pairs it has just joined.
    """
    ensure_on_executors(members.sparkSession)
    sizes = members.groupBy("key", "comp").count()
    top = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.sum("count").alias("n_all"), F.max("count").alias("n_top"))
    top = top.where("n_all > n_top").select("key", "top", F.ceil(F.col("n_all") / block).cast("int").alias("nb"), F.ceil((F.col("n_all") - F.col("n_top")) / block).cast("int").alias("sb"))
    m = members.join(top, "key")
    h = F.xxhash64("rep", F.lit(7))
    outside = m.where("comp <> top").select("key", F.pmod(h, F.col("sb")).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("m"), F.lit(True).alias("outer"), "rep", "comp", "n", "sketch", "bands")
    inside = m.select("key", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), F.pmod(h, F.col("nb")).cast("int").alias("m"), F.lit(False).alias("outer"), "rep", "comp", "n", "sketch", "bands")
    percent, most = round(100 * threshold), most_odd_bits(threshold)

    def links_of(cell: pa.Table, shingle: Shingler) -> tuple[list[int], list[int]]:
        outer = cell.column("outer").to_numpy()
        rep, comp, n = (cell.column(c).to_numpy() for c in ("rep", "comp", "n"))
        sketch = _matrix(cell.column("sketch")).view(np.uint64)
        rows, root, a_out, b_out = np.flatnonzero(~outer), {c: c for c in comp.tolist()}, [], []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        text_col = cell.column("text").cast(pa.large_binary())
        index: tuple[np.ndarray, np.ndarray] | None = None
        for i in np.flatnonzero(outer).tolist():
            near = rows[comp[rows] != comp[i]]
            near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= most]
            if not len(near):
                continue
            if index is None:
                sets = [shingle(text_col[j].as_py() or b"") for j in rows.tolist()]
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                index = flat[order], np.repeat(rows, [len(x) for x in sets])[order]
            own = shingle(text_col[i].as_py() or b"")
            lo, hi = np.searchsorted(index[0], own), np.searchsorted(index[0], own, side="right")
            length = hi - lo
            at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
            common = np.bincount(index[1][at], minlength=len(rep))[near]
            for j in near[100 * common >= percent * (n[i] + n[near] - common)].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a_out.append(int(rep[i]))
                    b_out.append(int(rep[j]))
        return a_out, b_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for cell in sorted_groups(batches, ["key", "s", "m"]):
            a, b = links_of(cell, shingle)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["key", "s", "m"]):
            outer = cell.column("outer").to_numpy()
            comp, n = cell.column("comp").to_numpy(), cell.column("n").to_numpy()
            sketch = _matrix(cell.column("sketch")).view(np.uint64)
            bands = _matrix(cell.column("bands"))
            key = cell.column("key")[0].as_py()
            rows, use = np.flatnonzero(~outer), np.zeros(len(outer), bool)
            for i in np.flatnonzero(outer).tolist():
                near = rows[(comp[rows] != comp[i]) & (100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i]))]
                near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= most]
                # a pair that shares several buckets is left to the first
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == key]
                use[near] = True
                use[i] = len(near) > 0
            if use.any():
                yield from cell.drop_columns("bands").filter(pa.array(use)).combine_chunks().to_batches()

    by = ("key", "s", "m")
    cells = outside.union(inside).repartition(*by).sortWithinPartitions(*by)
    cells = cells.mapInArrow(lean(plausible), cells.drop("bands").schema)  # only these rows need their texts
    cells = cells.join(text.select(F.col("doc_id").alias("rep"), "text"), "rep").repartition(*by).sortWithinPartitions(*by)
    return cells.mapInArrow(lean(run), "a long, b long").distinct()


def _same_id(f: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that repeat an id with different sets."""
    own = f.where("cls is not null and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("doc_id")
    nodes = own.join(several, "doc_id", "left_semi").join(classes, "cls").select("doc_id", "node").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return nodes.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))


def groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, n_shingles, node (null without shingles, equal in a component) and component_id of every row."""
    spark = docs.sparkSession
    scratch = Scratch.of(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    f = scratch.save(features(source, words))
    found_classes = f.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    # a class is named by its smallest id, where that has no other text, else by a hash
    same = Window.partitionBy("low", F.when(F.col("low").isNull(), F.xxhash64("cls"))).orderBy("cls")
    name = F.when((F.row_number().over(same) == 1) & F.col("low").isNotNull(), F.col("low")).otherwise(-F.abs(F.xxhash64("cls")))
    classes = scratch.save(found_classes.select("cls", "low", name.alias("node")))
    named = classes.select(F.col("low").alias("_low"), F.col("cls").alias("_cls"), "node")
    reps = f.join(named, (f["cls"] == F.col("_cls")) & f["doc_id"].eqNullSafe(F.col("_low"))).dropDuplicates(["doc_id", "cls"])
    reps = scratch.save(reps.select("node", "doc_id", "tag", "n_shingles", "bands", "sketch"))

    exploded = reps.select(F.explode("bands").alias("key"), F.col("node").alias("rep"))
    several = exploded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    members = scratch.save(exploded.join(several, "key"))
    active = reps.join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    active = scratch.save(active.select(F.col("node").alias("rep"), "doc_id", "tag", F.col("n_shingles").alias("n"), "sketch", "bands"))
    scratch.drop(reps)
    wanted = active.select(F.col("doc_id").alias("_doc_id"), F.col("tag").alias("_tag"), "rep")
    reps_text = source.join(wanted, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).dropDuplicates(["rep"])
    text = scratch.save(reps_text.select(F.col("rep").alias("doc_id"), "text"))
    scratch.release_shuffles()

    def joined(pairs: DataFrame) -> DataFrame:
        a = active.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = active.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        both = pairs.join(a, "a").join(b, "b")
        return both.where(_plausible(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), threshold)).select("a", "b")

    def with_comp(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("rep"))
        return members.join(labels, members.rep == labels.id, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))

    def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components after the links found; links run between members of components so far."""
        if labels is None:
            return scratch.save(connected_components(found))
        a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        between = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = scratch.save(connected_components(between)).toDF("old", "new")
        moved = labels.join(above, labels.component == above.old, "left").select("id", F.coalesce("new", "component").alias("component"))
        fresh = above.select(F.col("old").alias("id"), F.col("new").alias("component")).join(labels, "id", "left_anti")
        return scratch.save(moved.union(fresh))

    labels: DataFrame | None = None
    twins = scratch.save(_same_id(f, classes))
    if not twins.isEmpty():
        labels = merged(labels, twins)
    work = 0
    for i in range(MOST_ROUNDS):
        m = with_comp(labels)
        order = F.col("rep") if i == 0 else F.xxhash64("rep", F.lit(i))
        centre = m.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("centre"), F.col("comp").alias("of"))).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "c.centre", "c.of")
        pairs = m.join(centre, "key").where("comp <> of").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        found = scratch.save(_confirm(joined(pairs), text, words, threshold))
        scratch.release_shuffles()
        if not found.isEmpty():
            labels = merged(labels, found)
        # more centres only where comparing the rest exhaustively would cost far more than the buckets hold
        sizes = with_comp(labels).groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("n"), F.max("count").alias("top"))
        work, rows = sizes.agg(F.sum(F.col("n") * (F.col("n") - F.col("top"))), F.sum("n")).first()
        if not work or work <= PAIRS_A_ROW * rows:
            break
    if work:  # the rest, in buckets of several components
        m = with_comp(labels).join(active.select("rep", "n", "sketch", "bands"), "rep")
        found = scratch.save(_exhaustive(m.select("key", "rep", "comp", "n", "sketch", "bands"), text, words, threshold, BLOCK))
        if not found.isEmpty():
            labels = merged(labels, found)
    out = f.select("doc_id", "tag", "n_shingles", "cls").join(classes, "cls", "left").drop("cls")
    if labels is not None:
        lows = labels.join(classes.select(F.col("node").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("least"))
        by_node = labels.join(lows, "component").select(F.col("id").alias("node"), "component", "least")
        out = out.join(by_node, "node", "left").withColumn("low", F.coalesce("least", "low")).withColumn("node", F.coalesce("component", "node"))
    return out.select("doc_id", "tag", "n_shingles", "node", F.coalesce("low", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row."""
    out = groups(docs, words, threshold, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others), with one row of each component: that of the smallest
    id, of its texts the one of the smallest hash; rows without words all stay."""
    scratch = Scratch.of(docs.sparkSession)
    rows = scratch.save(groups(docs, words, threshold).where("node is not null").select("doc_id", "tag", "node"))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tag")
    first = rows.groupBy("node").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = rows.join(first, "node")
    stays = key.eqNullSafe(F.col("first"))
    gone = twice.where(~stays).select("doc_id", "tag").distinct()
    again = scratch.save(twice.where(stays).groupBy("doc_id", "tag").count().where("count > 1").select("doc_id", "tag"))
    tag, doc_id = F.xxhash64("text"), F.col("doc_id").cast("long")

    def matches(keys: DataFrame):
        k = keys.toDF("_doc_id", "_tag")
        return k, (doc_id.eqNullSafe(k["_doc_id"])) & (tag == k["_tag"])

    kept = docs.join(*matches(gone), "left_anti")
    if again.isEmpty():
        return kept
    k, same = matches(again)
    repeated = kept.join(k, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(k, same, "left_anti").unionByName(repeated)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
