"""Removal of repeated passages, by suffix arrays over shards that are cut by content.

Every window of ``length`` bytes belongs to its minimizer, the k-gram in it with the least hash
(leftmost of equals). Equal windows have equal minimizers, so windows are sharded by that hash and no
repeat is lost; neighbouring windows with one minimizer travel together as one stretch of text.
Minimizers are counted first, and only stretches whose minimizer occurs twice are sent. Stretches equal
to an earlier one of their block are set aside before the shuffle, and those equal to an earlier one
of their shard in it. All suffixes of what is left are sorted by induced sorting, and suffixes whose
common prefix with their predecessor reaches the length are equal windows; all but the earliest are
repeats.

A minimizer with many different surroundings is split before the shuffle: windows are told apart by
where the minimizer lies in them, which equal windows agree on, in ranges so short that all windows of
a range share a longer string; that string names the shard. The shortest range is one place, where the
string is the window. What is sorted at once stays bounded, at any number of surroundings.

Defined results: null text is empty; texts shorter than the length lose nothing; a window is earlier
than another if its doc_id is smaller, or its start in the same document; null ids come first; rows
that repeat an id and its text count as one document; rows that repeat an id with different texts are
documents of their own, ordered by a hash of the text; cuts need not respect characters, so the
cleaned text drops broken ones; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallspark.llm.common import lean, small_slices, text_bytes
from recallspark.llm.induced_sort import permuted_prefixes, suffix_array
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

LENGTH, GRAM = 100, 24
#: Bytes of text cut at a time, longest part of one document, and stretch bytes sorted at a time.
SLICE_BYTES, PART_BYTES, SHARD_BYTES = 1 << 19, 1 << 21, 1 << 20
#: Ranges that a minimizer's windows are split into, as a power of two, beyond so many different stretches.
SPLITS = ((40_000, 7), (4_000, 3))
#: Text bytes of a block of documents that is cut in one task.
BLOCK_BYTES = 6 << 20
LEAST_ID = -(1 << 63)

_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(flat: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``size`` bytes, doubled up from single bytes."""
    level, width, out, done = flat.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = level, width
            else:
                n = len(flat) - done - width + 1
                out = out[:n] * np.uint64(pow(base, width, 1 << 64)) + level[done : done + n]
                done += width
        if done == size:
            return _mix(out)
        level = level[:-width] * np.uint64(pow(base, width, 1 << 64)) + level[width:]
        width *= 2


def _window_minimum(keys: np.ndarray, size: int) -> np.ndarray:
    level, width = keys, 1
    while width * 2 <= size:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    n = len(keys) - size + 1
    return np.minimum(level[:n], level[size - width : size - width + n])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    total = int(lengths.sum())
    return flat[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]


def stretches(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimizer hash, its place, start and byte length of each run of windows with one minimizer,
    and a hash that differs between most different runs of a minimizer."""
    none = (np.zeros(0, np.int64),) * 5
    if len(flat) < length:
        return none
    grams = _gram_hashes(flat, gram, _BASE[0])
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = (_window_minimum((grams & ~low) | place, length - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(flat) + 1, np.int32)
    sizes = np.diff(offsets)
    some = sizes >= length
    inside[offsets[:-1][some]] += 1
    inside[offsets[1:][some] - length + 1] -= 1
    valid = np.cumsum(inside)[: len(least)] > 0
    first = np.empty(len(least), bool)
    first[0] = True
    first[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    # a run also ends where a document does, which an invalid window always follows unless length is 1
    starts = np.flatnonzero(valid & first)
    if not len(starts):
        return none
    size = np.add.reduceat(valid.astype(np.int64), starts) + length - 1
    look = (grams[starts] ^ (grams[starts + size - gram] << np.uint64(1))).view(np.int64) ^ size
    return grams[least[starts]].view(np.int64), least[starts], starts, size, look


def _pieces(rb: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes, offsets, row numbers and first offset of pieces of a batch; a very long text gives several."""
    at = 0
    for part in small_slices(iter([rb]), "text", SLICE_BYTES):
        flat, offsets = text_bytes(part, "text")
        rows = np.arange(at, at + part.num_rows)
        at += part.num_rows
        if len(flat) <= PART_BYTES:
            yield flat, offsets, rows, np.zeros(len(rows), np.int64)
            continue
        for a in range(0, len(flat) - length + 1, PART_BYTES):
            own = flat[a : a + PART_BYTES + length - 1]
            yield own, np.array([0, len(own)]), rows, np.array([a])


def _mark(length: int, gram: int):
    """(shard, block, n, looks): stretches of each shard and block in a slice, and about how many differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            block = part.column("block").to_numpy()
            for flat, offsets, rows, _ in _pieces(part, length):
                shard, _, starts, _, look = stretches(flat, offsets, length, gram)
                key = block[rows[np.searchsorted(offsets, starts, side="right") - 1]]
                order = np.lexsort((look, shard, key))
                shard, key, look = shard[order], key[order], look[order]
                change = np.append(True, (shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) if len(shard) else np.zeros(0, bool)
                first = np.flatnonzero(change)
                n = np.diff(np.append(first, len(shard)))
                other = change.copy()
                other[1:] |= look[1:] != look[:-1]
                looks = np.add.reduceat(other.astype(np.int64), first) if len(first) else n
                yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(key[first]), pa.array(n, pa.int64()), pa.array(looks, pa.int64())], ["shard", "block", "n", "looks"])

    return run


_CUT_SCHEMA = pa.schema({"shard": pa.int64(), "doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "data": pa.binary()})
_CUT_DDL = "shard long, doc_id long, tag long, start long, stop long, data binary"


def _repeated(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows equal in ``same``: the earliest, and those at later places."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 2
    order = np.lexsort((start, tag, doc, *same))
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in same])
    head = order[np.maximum.accumulate(np.where(again, -1, np.arange(len(order))))]
    later = again & ((doc[order] != doc[head]) | (tag[order] != tag[head]) | (start[order] != start[head]))
    return np.sort(order[~again]), order[later]


def split_runs(flat: np.ndarray, shard: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, level: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches cut into ranges of the minimizer's place: (stretch, longer-named shard, start, size)."""
    width = -(-(length - gram + 1) // (1 << level))
    ranges = np.arange(-(-(length - gram + 1) // width))
    near = place[:, None] - ranges * width  # the last window that starts so far before the minimizer
    low = np.maximum(start[:, None], near - width + 1)
    high = np.minimum((start + size - length)[:, None], near)
    own, which = np.nonzero(low <= high)
    low, high = low[own, which], high[own, which]
    name = _gram_hashes(flat, length - width + 1, _BASE[1])[near[own, which]]
    name = _mix(name ^ shard[own].view(np.uint64) ^ (which.astype(np.uint64) + np.uint64(1)))
    return own, name.view(np.int64), low, high - low + length


def _cut(length: int, gram: int):
    """Rows of a block of documents: stretches of shards met twice, and those set aside (null data)."""

    def run(texts: pa.Table, shards: pa.Table) -> pa.Table:
        wanted, at = np.unique(shards.column("shard").to_numpy(), return_index=True)
        levels = shards.column("level").to_numpy()[at]
        if not len(wanted) or not texts.num_rows:
            return _CUT_SCHEMA.empty_table()
        doc_ids, tags = texts.column("doc_id").to_numpy(), texts.column("tag").to_numpy()
        found, at = [], 0  # (row, shard, start, size, hashes of both ends, bytes)
        for rb in texts.to_batches():
            for flat, offsets, rows, first in _pieces(rb, length):
                shard, place, start, size, _ = stretches(flat, offsets, length, gram)
                slot = np.minimum(np.searchsorted(wanted, shard), len(wanted) - 1)
                met = wanted[slot] == shard
                if not met.any():
                    continue
                shard, place, start, size, level = shard[met], place[met], start[met], size[met], levels[slot[met]]
                runs = [(shard[level == 0], start[level == 0], size[level == 0])]
                for deep in np.unique(level[level > 0]).tolist():
                    x = level == deep
                    runs.append(split_runs(flat, shard[x], place[x], start[x], size[x], deep, length, gram)[1:])
                shard, start, size = (np.concatenate(x) for x in zip(*runs))
                # the first and last windows of a stretch cover it: hashes of both name its text
                h1 = _gram_hashes(flat, length, _BASE[0])[start]
                h2 = _gram_hashes(flat, length, _BASE[1])[start + size - length]
                row = np.searchsorted(offsets, start, side="right") - 1
                place_in_doc, number = start - offsets[row] + first[row], rows[row] + at
                keep, aside = _repeated(doc_ids[number], tags[number], place_in_doc, h2, h1, size)
                sent = gather(flat, start[keep], size[keep])
                found.append((number, shard, place_in_doc, size, h1, h2, keep, aside, sent))
            at += rb.num_rows
        return _block_rows(found, doc_ids, tags) if found else _CUT_SCHEMA.empty_table()

    return run


def _block_rows(found: list[tuple[np.ndarray, ...]], doc_ids: np.ndarray, tags: np.ndarray) -> pa.Table:
    """Rows of all pieces of a block, those equal to an earlier one of another piece set aside too."""
    picked = [tuple(x[f[6]] for x in f[:6]) for f in found]
    number, shard, start, size, h1, h2 = (np.concatenate(x) for x in zip(*picked))
    sent = np.concatenate([f[8] for f in found])
    begins = np.cumsum(size) - size
    keep, later = _repeated(doc_ids[number], tags[number], start, h2, h1, size)
    lengths = size[keep]
    data = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(gather(sent, begins[keep], lengths))])
    asides = [tuple(x[f[7]] for x in (f[0], f[2], f[3])) for f in found] + [(number[later], start[later], size[later])]
    a_number, a_start, a_size = (np.concatenate(x) for x in zip(*asides))
    number, start, size = (np.concatenate(x) for x in ((number[keep], a_number), (start[keep], a_start), (size[keep], a_size)))
    # rows that are settled go anywhere, so that none of them meet in a hot shard
    anywhere = _mix(tags[a_number].view(np.uint64) + a_start.astype(np.uint64) * np.uint64(_BASE[0]))
    columns = [np.append(shard[keep], anywhere.view(np.int64)), doc_ids[number], tags[number], start, start + size]
    return pa.Table.from_arrays([*map(pa.array, columns), pa.concat_arrays([data, pa.nulls(len(a_number), pa.binary())])], schema=_CUT_SCHEMA)


def _rows(doc, tag, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, tag, start, stop)], ["doc_id", "tag", "start", "stop"])


def repeats_by_suffix_array(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For texts in order, offsets of their windows that occur earlier, in them or before them."""
    sizes = np.array([len(p) for p in parts])
    s = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 2
    begins = np.cumsum(sizes + 1) - sizes - 1
    s[begins + sizes] = 1  # ends of parts; nothing common runs over them
    s = np.append(s, np.int16(0))
    sa = suffix_array(s)
    common = permuted_prefixes(s, sa, 1)
    same = common[sa] >= length
    group = np.cumsum(~same)
    counts = np.bincount(group)
    many = sa[counts[group] > 1]
    if not len(many):
        return [np.zeros(0, np.int64)] * len(parts)
    g = group[counts[group] > 1]
    cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    earliest = np.repeat(np.minimum.reduceat(many, cuts), np.diff(np.append(cuts, len(many))))
    later = np.sort(many[many > earliest])
    part = np.searchsorted(begins, later, side="right") - 1
    bounds = np.searchsorted(part, np.arange(len(parts) + 1))
    return [later[bounds[i] : bounds[i + 1]] - begins[i] for i in range(len(parts))]


def _runs(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans covered by windows at sorted offsets, one for each run of neighbours."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + length


class _Shard:
    """Collects shards with several different stretches and sorts them a block at a time."""

    def __init__(self, length: int):
        self.length, self.parts, self.where, self.bytes = length, [], [], 0

    def add(self, group: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Different stretches of one shard, earliest first."""
        for *where, data in group:
            self.parts.append(data)
            self.where.append(where)
            self.bytes += len(data)
        if self.bytes >= SHARD_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            out = [[], [], [], []]
            for (doc, tag, at), found in zip(self.where, repeats_by_suffix_array(self.parts, self.length)):
                for a, b in zip(*(x.tolist() for x in _runs(found, self.length))):
                    for x, v in zip(out, (doc, tag, a + at, b + at)):
                        x.append(v)
            self.parts, self.where, self.bytes = [], [], 0
            if out[0]:
                yield _rows(*out)


def _sort_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(length)
        open_hash, group, seen = None, [], {}
        for rb in batches:
            if not rb.num_rows:
                continue
            keys, *where = (rb.column(c).to_numpy() for c in ("shard", "doc_id", "tag", "start", "stop"))
            data = rb.column("data")
            null = data.is_null().to_numpy(zero_copy_only=False)
            aside = [x[null] for x in where]
            rows = np.flatnonzero(~null)
            if len(rows):
                k = keys[rows]
                # shards met once in this batch need no look at their text, but at its edges
                once = np.ones(len(k), bool)
                once[1:] &= k[1:] != k[:-1]
                once[:-1] &= k[1:] != k[:-1]
                once[0] = once[-1] = False
                more = [[], [], [], []]
                for i in rows[~once].tolist():
                    key, text, at = int(keys[i]), data[i].as_py(), tuple(int(x[i]) for x in where)
                    if key != open_hash:
                        if len(group) > 1:
                            yield from shard.add(group)
                        open_hash, group, seen = key, [], {}
                    first = seen.get(text)
                    if first is None:
                        seen[text] = at[:3]
                        group.append((*at[:3], text))
                    elif at[:3] != first:
                        for x, v in zip(more, at):
                            x.append(v)
                aside = [np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(aside, more)]
            if len(aside[0]):
                yield _rows(*aside)
        if len(group) > 1:
            yield from shard.add(group)
        yield from shard.flush()

    return run


def _identified(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, text and ``row`` of every row; the tag tells apart different texts of one id.

    Rows without id stand at the least id, before rows that have it: by the sign of their tags.
    """
    doc_id, tag, least = F.col(id_col).cast("long"), F.xxhash64(text_col), F.lit(LEAST_ID)
    signed = F.when(doc_id.isNull(), tag.bitwiseOR(least)).when(doc_id == least, tag.bitwiseAND(~LEAST_ID)).otherwise(tag)
    return docs.select(F.coalesce(doc_id, least).alias("doc_id"), signed.alias("tag"), F.col(text_col).alias("text"), row.alias("row"))


def repeated_spans(source: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, start, stop) of repeats, overlapping spans not yet merged. ``source``: doc_id, tag, text."""
    ensure_on_executors(source.sparkSession)
    scratch = Scratch.of(source.sparkSession)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(blocks)))
    marks = source.mapInArrow(lean(_mark(length, gram)), "shard long, block long, n long, looks long")
    whole = Window.partitionBy("shard")
    counted = marks.select("shard", "block", F.sum("n").over(whole).alias("n"), F.sum("looks").over(whole).alias("looks")).where("n > 1")
    level = F.coalesce(*[F.when(F.col("looks") > n, k) for n, k in SPLITS], F.lit(0)).alias("level")
    shards = scratch.save(counted.select("shard", "block", level))
    scratch.release_shuffles()
    cut = source.groupBy("block").cogroup(shards.groupBy("block")).applyInArrow(_cut(length, gram), _CUT_DDL)
    dealt = cut.repartition("shard").sortWithinPartitions("shard", "doc_id", "tag", "start")
    found = scratch.save(dealt.mapInArrow(lean(_sort_shards(length)), "doc_id long, tag long, start long, stop long"))
    scratch.drop(shards)
    scratch.release_shuffles()
    return found


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and cleaned text of every row, beside its id and its column ``row``."""
    for rb in small_slices(batches, "text", SLICE_BYTES):
        out = [[], [], [], [], []]
        text, spans = rb.column("text").cast(pa.large_binary()), rb.column("spans")
        for i in range(rb.num_rows):
            t = text[i].as_py() or b""
            kept, removed, n, at = [], 0, 0, 0
            if spans[i].is_valid:
                v = spans.value_lengths()[i].as_py()
                own = spans[i].values
                a, b = own.field("start").to_numpy(), own.field("stop").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.append(True, a[1:] > b[:-1]) if v else np.zeros(0, bool)
                lo, hi = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, v - 1)] if v else b
                for x, y in zip(lo.tolist(), hi.tolist()):
                    kept.append(t[at:x])
                    removed += y - x
                    at = y
                n = len(lo)
            kept.append(t[at:])
            rest = b"".join(kept)
            for x, v in zip(out, (len(t), removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", errors="ignore"))):
                x.append(v)
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("row"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "clean_text"])


def _cleaned(source: DataFrame, length: int, gram: int) -> DataFrame:
    """``source`` (doc_id, tag, text, row) with the figures and cleaned texts instead of tag and text."""
    spans = repeated_spans(source.select("doc_id", "tag", "text"), length, gram).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(spans, ["doc_id", "tag"], "left")
    figures = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean_text string")
    return joined.mapInArrow(lean(_apply), StructType([*joined.select("doc_id", "row").schema, *figures]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and clean_text of every row."""
    source = _identified(docs, F.col(id_col).cast("long"), id_col, text_col)
    return _cleaned(source, length, gram).withColumn("doc_id", F.col("row")).drop("row")


def clean_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents (doc_id, text and any other columns) with repeats cut out of their texts."""
    others = [c for c in docs.columns if c != "text"]
    out = _cleaned(_identified(docs, F.struct(*[F.col(c) for c in others])), length, gram)
    return out.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
