"""Packing token sequences by shortest-pack-first over the length histogram.

Whole sequences are cut off the front of each document first; only the rest, shorter than a sequence,
is packed. The histogram of rest lengths has as many bins as a sequence has tokens, so the plan is
made on the driver in bounded memory: lengths are placed longest first, and all documents of a length
move together by counts. Documents then find their pattern by their rank among the rests of equal
length; ranks are counted in salted groups, whose offsets are a table that rows are joined to, so no length lands in one task. There are more
groups as rows grow, those of whole sequences without bound, those of rests up to ``MOST_SALTS``.

A sequence that its pieces fill exactly to a power of two needs no padding, all others are padded to
the full length; pieces say where they lie, and nothing here depends on the padding.

Defined results: null text counts as empty, so it is the end id alone; a document of n tokens gives
ceil(n / length) pieces that cover it without gaps; repeated ids are packed as separate documents
when their rows differ only in place; null ids are packed like others and stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.bpe import SLICE_BYTES, default_vocabulary, encoder
from recallspark.llm.common import lean, small_slices, texts
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

SEQUENCE, END_ID, SALTS = 2048, 1, 64
#: Groups of the rests of a length at most, and rows to a group between.
MOST_SALTS, GROUP_ROWS = 1024, 500_000


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in the order they were placed) that hold the histogram exactly.

    Lengths come longest first. Each goes to the shortest pack that takes it, which is the open
    pattern with the most room; of a pattern with more copies than documents left, only as many
    copies are split off. A length that no open pattern takes opens a new one.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room left -> (count, lengths)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, open_ in room.items() if open_), default=0)
            if space < length:
                room.setdefault(size - length, []).append((left, (length,)))
                break
            count, lengths = room[space].pop()
            n = min(left, count)
            if count > n:
                room[space].append((count - n, lengths))
            room.setdefault(space - length, []).append((n, (*lengths, length)))
            left -= n
    return [pattern for space in sorted(room) for pattern in room[space]]


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: start, length, crc32 of the ids, and the document's token count."""
    ensure_on_executors(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        step = size * 4
        for rb in small_slices(batches, "text", SLICE_BYTES):
            doc, start, length, crc, total = [], [], [], [], []
            for i, text in zip(rb.column("doc_id").to_pylist(), texts(rb, "text")):
                packed = enc.encode_packed(text) + end
                for a in range(0, len(packed), step):
                    part = packed[a : a + step]
                    doc.append(i)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
                    total.append(len(packed) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, the sequence of each first rank, and the offset."""
    at: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for n, lengths in patterns:
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((at.get(x, 0), sequence, offset))
            at[x] = at.get(x, 0) + n
            offset += x
        sequence += n
    return {x: tuple(np.array(v, np.int64) for v in zip(*rows)) for x, rows in slots.items()}


def pack(piece_rows: DataFrame, size: int = SEQUENCE, salts: int = SALTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces; a piece of ``size`` tokens is a sequence by itself."""
    spark = piece_rows.sparkSession
    scratch = Scratch.of(spark)
    saved = scratch.save(piece_rows)
    groups = max(salts, math.ceil(saved.count() / group_rows))
    several = F.when(F.col("length") == size, groups).otherwise(min(groups, max(salts, MOST_SALTS)))
    rows = saved.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), several).cast("int"))
    counts = scratch.save(rows.groupBy("length", "salt").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    whole = histogram.pop(size, 0)
    patterns = shortest_pack_first(histogram, size)
    packed = sum(n for n, _ in patterns)
    slots = _slots(patterns)
    slots[size] = (np.array([0]), np.array([packed]), np.array([0])) if whole else (np.zeros(0, np.int64),) * 3
    shared = spark.sparkContext.broadcast(slots)  # bounded by size squared
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for rb in batches:
            if not rb.num_rows:
                continue
            length, rank = rb.column("length").to_numpy(), rb.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(bounds, [*bounds[1:], len(order)]):
                own = order[a:b]
                x = int(length[own[0]])
                ranks = rank[own]
                starts, sequences, offsets = slots[x]
                k = np.searchsorted(starts, ranks, side="right") - 1
                seq[own], off[own] = sequences[k] + ranks - starts[k], offsets[k]
            keep = [rb.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    w = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(w).cast("long") - 1).join(firsts, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("first"))
    return ranked.mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
