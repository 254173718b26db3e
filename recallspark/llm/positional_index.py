"""Benchmark decontamination by a distributed positional inverted index.

1. The training documents are indexed in segments of some megabytes. A row of the index is a segment:
   its distinct terms, how often each occurs, and each term's postings, the ascending positions of its
   occurrences. The index is written once and serves any number of searches.
2. Test items become windows of consecutive words, sent to the segments in blocks of bounded size. In
   a segment, a window starts from the postings of its rarest term there, shifted by the term's place
   in the window; these are intersected with the shifted postings of the next rarest term, and so on.
   What is left are the exact phrase matches. A proximity search looks up the same postings for
   stretches of so many words that hold all terms of a window, in any order.
3. Matches are gathered for each document: covered spans of words and items.

Terms are compared as strings, never by hashes. Candidates are expanded in bounded portions, so a very
common passage costs time in proportion to its occurrences and no memory. A document longer than a
segment is cut into several that overlap by ``overlap`` words, so no match is lost between them.

Defined results: null, empty and blank texts have no words and match nothing; an item of fewer words
than a window is one window, one without words none; repeated rows of documents are separate documents;
items with equal ids are one item, and a null item id is written as the empty string; very long
documents are held whole by one worker at about four times their bytes; further columns of both inputs
are ignored; empty tables give no rows, or rows without matches where only the items' table is empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import small_slices, text_bytes
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Words of a window; bytes of text in a segment, and words in a segment of a longer document; words
#: that such segments share, which bounds windows and stretches.
WINDOW, SEGMENT_BYTES, SEGMENT_WORDS, OVERLAP = 10, 4 << 20, 1 << 19, 63
#: Windows and bytes of their words in a block, and candidates that are expanded at once.
BLOCK_WINDOWS, BLOCK_BYTES, CANDIDATES = 200_000, 32 << 20, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of a word after lower-casing: digits, a to z, and all that aren't ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

INDEX = "terms array<string>, counts array<int>, postings binary, docs array<struct<row: long, doc_id: long, words: int, own: int, first: long>>"
FOUND = "row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def words_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Lower-cased words of texts in UTF-8 that are cut at ``offsets``, and the number of words of each text."""
    flat = _LOWER[flat]
    inside = _WORD[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(flat)]
    starts[edge] = inside[edge]
    at = np.flatnonzero(starts)
    data = flat[inside]
    ends = np.append((np.cumsum(inside) - 1)[at], len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(at, offsets))


def _inverted(words: pa.LargeStringArray) -> list[pa.Array]:
    """Terms, counts and postings of a segment's words, as columns of one row."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    terms = coded.dictionary.cast(pa.string())
    counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
    postings = np.argsort(codes, kind="stable").astype("<i4")
    one = pa.array([0, len(terms)], pa.int32())
    return [pa.ListArray.from_arrays(one, terms), pa.ListArray.from_arrays(one, pa.array(counts)), pa.array([postings.tobytes()], pa.binary())]


def _segment(words: pa.LargeStringArray, docs: dict[str, list]) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "words": pa.int32(), "own": pa.int32(), "first": pa.int64()}
    fields = pa.StructArray.from_arrays([pa.array(docs[k], t) for k, t in kinds.items()], list(kinds))
    listed = pa.ListArray.from_arrays(pa.array([0, len(fields)], pa.int32()), fields)
    return pa.RecordBatch.from_arrays([*_inverted(words), listed], ["terms", "counts", "postings", "docs"])


@dataclass(frozen=True)
class PositionalIndex:
    """A written index; matches of up to ``overlap + 1`` words are found."""

    table: DataFrame
    overlap: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlap: int = OVERLAP, segment_bytes: int = SEGMENT_BYTES, segment_words: int = SEGMENT_WORDS) -> PositionalIndex:
        """Indexes every whole text; ``doc_id`` and a number of its own keep each row apart."""
        ensure_on_executors(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in small_slices(batches, "text", segment_bytes):
                flat, offsets = text_bytes(rb, "text")
                words, n = words_of(flat, offsets)
                row, doc = rb.column("row").to_pylist(), rb.column("doc_id").to_pylist()
                if rb.num_rows == 1 and len(words) > segment_words:
                    for a in range(0, len(words), segment_words):
                        part = words[a : a + segment_words + overlap]
                        own = min(segment_words, len(words) - a)
                        yield _segment(part, {"row": row, "doc_id": doc, "words": [len(part)], "own": [own], "first": [a]})
                else:
                    yield _segment(words, {"row": row, "doc_id": doc, "words": n, "own": n, "first": np.zeros(len(n), np.int64)})

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
        return cls(Scratch.of(docs.sparkSession).save(rows.mapInArrow(run, INDEX), large_rows=True), overlap)

    def occurrences(self) -> DataFrame:
        """term, n_segments and n: how often each term occurs in all documents."""
        each = self.table.select(F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        return each.groupBy(F.col("e.terms").alias("term")).agg(F.count("*").alias("n_segments"), F.sum("e.counts").alias("n"))


def windows_of(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (its id as text) and terms of every different window of every item."""
    ensure_on_executors(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                words, _ = words_of(*text_bytes(rb.slice(i, 1), "text"))
                n = len(words)
                if not n:
                    continue
                k = min(size, n)
                for a in range(0, n - k + 1, 20_000):
                    starts = np.arange(a, min(a + 20_000, n - k + 1))
                    terms = words.take(pa.array((starts[:, None] + np.arange(k)).ravel())).cast(pa.string())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * k, pa.int32()), terms)
                    yield pa.RecordBatch.from_arrays([pa.array([rb.column("item")[i].as_py()] * len(starts), pa.string()), lists], ["item", "terms"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, terms array<string>").distinct()


@dataclass(frozen=True)
class Block:
    """Different windows of bounded number: codes of their terms in ``terms``, padded by -1, and their items."""

    terms: pa.Array
    codes: np.ndarray
    #: items[first[w] : first[w + 1]] are places in ``names`` of the items that window w belongs to.
    first: np.ndarray
    items: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, size: int) -> Block:
        lists = table.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        codes = np.full((len(lists), size), -1, np.int64)
        codes[np.arange(size) < lengths[:, None]] = coded.indices.to_numpy(zero_copy_only=False)
        codes, own = np.unique(codes, axis=0, return_inverse=True)
        names, item = np.unique(np.array(table.column("item").to_pylist(), object), return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        first = np.searchsorted(own.ravel()[order], np.arange(len(codes) + 1))
        return cls(coded.dictionary, codes, first, item[order], names)


class Segment:
    """One row of the index, opened for lookups."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, postings: bytes, docs: dict[str, np.ndarray]):
        self.terms, self.docs = terms, docs
        self.counts = counts.astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.postings = np.frombuffer(postings, "<i4").astype(np.int64)
        #: Term and position in one number; ascending, as postings are.
        self.keys = np.repeat(np.arange(len(counts)) << 32, self.counts) + self.postings
        self.doc_end = np.cumsum(docs["words"])
        self.doc_begin = self.doc_end - docs["words"]

    def before(self, code: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Places of (term, position) in the postings."""
        return np.searchsorted(self.keys, (code << 32) + position)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_end, position, side="right")

    def rarest_first(self, block: Block, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms occur here; codes and offsets of their terms, rarest first, padded by -1."""
        here = pc.index_in(block.terms, value_set=self.terms).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.where(block.codes < 0, -1, here[block.codes])
        alive = np.flatnonzero((codes != -2).all(axis=1))
        codes = codes[alive]
        if distinct:
            codes = np.sort(codes, axis=1)
            codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = -1
        cost = np.where(codes < 0, np.iinfo(np.int64).max, np.append(self.counts, 0)[codes])
        order = np.argsort(cost, axis=1, kind="stable")
        return alive, np.take_along_axis(codes, order, axis=1), order

    def anchors(self, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (window, position of its rarest term), in portions of bounded size."""
        n = self.counts[first]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, CANDIDATES):
            at = np.arange(a, min(a + CANDIDATES, total))
            w = np.searchsorted(ends, at, side="right")
            yield w, self.postings[self.begin[first[w]] + at - (ends[w] - n[w])]

    def phrases(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of the block and the positions at which they begin."""
        alive, codes, offsets = self.rarest_first(block, distinct=False)
        length = (codes >= 0).sum(axis=1)
        for w, at in self.anchors(codes[:, 0]):
            start = at - offsets[w, 0]
            doc = self.doc_of(at)
            fit = (start >= self.doc_begin[doc]) & (start + length[w] <= self.doc_end[doc])
            w, start = w[fit], start[fit]
            for k in range(1, codes.shape[1]):
                if not len(w):
                    break
                code, here = codes[w, k], start + offsets[w, k]
                place = np.minimum(self.before(code, here), len(self.keys) - 1)
                keep = (code < 0) | (self.keys[place] == (code << 32) + here)
                w, start = w[keep], start[keep]
            if len(w):
                yield alive[w], start

    def stretches(self, block: Block, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of the block and positions of their rarest terms that some ``near`` words around hold all terms of."""
        alive, codes, _ = self.rarest_first(block, distinct=True)
        for w, at in self.anchors(codes[:, 0]):
            doc = self.doc_of(at)
            low, high = self.doc_begin[doc], self.doc_end[doc]
            for k in range(1, codes.shape[1]):
                code = codes[w, k]
                n = self.before(code, np.minimum(at + near, high)) - self.before(code, np.maximum(at - near + 1, low))
                keep = (code < 0) | (n > 0)
                w, at, low, high = w[keep], at[keep], low[keep], high[keep]
            step = max(1, CANDIDATES // near)
            for a in range(0, len(w), step):
                own, lo, hi = (x[a : a + step, None] for x in (w, low, high))
                start = at[a : a + step, None] - near + 1 + np.arange(near)
                good = np.ones(start.shape, bool)
                for k in range(1, codes.shape[1]):
                    code = codes[own, k]
                    good &= (code < 0) | (self.before(code, np.minimum(start + near, hi)) > self.before(code, np.maximum(start, lo)))
                found = np.flatnonzero(good.any(axis=1)) + a
                if len(found):
                    yield alive[w[found]], at[found]


def _pairs(block: Block, doc: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Different (document, item) pairs as one number each, ascending."""
    n = len(block.first) - 1
    both = np.unique(doc * n + window)
    doc, window = both // n, both % n
    size = block.first[window + 1] - block.first[window]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.first[window], size)
    return np.unique(np.repeat(doc, size) * len(block.names) + block.items[at])


def _found(seg: Segment, block: Block, matches: Callable, every: bool) -> pa.RecordBatch:
    """Rows of documents with a match, or of ``every`` document: spans and items."""
    docs, total = seg.docs, int(seg.doc_end[-1]) if len(seg.doc_end) else 0
    edge = np.zeros(total + 1, np.int64)
    pairs = np.zeros(0, np.int64)
    length = (block.codes >= 0).sum(axis=1)
    for window, start in matches(seg, block):
        np.add.at(edge, start, 1)
        np.add.at(edge, np.minimum(start + length[window], total), -1)
        pairs = np.union1d(pairs, _pairs(block, seg.doc_of(start), window))
    hit = np.cumsum(edge)[:total] > 0
    first = np.zeros(total + 1, bool)
    first[seg.doc_begin] = True
    begin = np.flatnonzero(hit & (first[:total] | ~np.append(False, hit[:-1])))
    end = np.flatnonzero(hit & (np.append(first[1:total], True) | ~np.append(hit[1:], False))) + 1
    own = seg.doc_of(begin)
    shift = docs["first"][own] - seg.doc_begin[own]
    at = np.arange(len(docs["row"])) if every else np.unique(pairs // max(1, len(block.names)))
    spans = pa.StructArray.from_arrays([pa.array(begin + shift), pa.array(end + shift)], ["start", "end"])
    doc_of_pair, name = pairs // max(1, len(block.names)), pairs % max(1, len(block.names))
    cut = lambda x: pa.array(np.append(np.searchsorted(x, at), len(x)), pa.int32())
    items = pa.ListArray.from_arrays(cut(doc_of_pair), pa.array(block.names[name], pa.string()))
    cols = [pa.array(docs["row"][at]), docs["doc_id"].take(pa.array(at)), pa.array(docs["own"][at]), pa.ListArray.from_arrays(cut(own), spans), items]
    return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_words", "spans", "items"])


def _search(index: PositionalIndex, items: DataFrame, size: int, matches: Callable, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: row, doc_id, n_words, spans and items of its matches."""
    spark = items.sparkSession
    scratch = Scratch.of(spark)
    windows = scratch.save(windows_of(items, size, id_col, text_col))
    amount = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("terms", " "))).alias("b")).first()
    blocks = max(1, math.ceil(amount["n"] / BLOCK_WINDOWS), math.ceil((amount["b"] or 0) / BLOCK_BYTES))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        # a block is bounded in windows and bytes, whatever the items' table holds
        block = spark.sparkContext.broadcast(Block.of(dealt.where(F.col("block") == b).select("item", "terms").toArrow(), size))

        def run(batches: Iterator[pa.RecordBatch], block=block, every=b == 0) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for i in range(rb.num_rows):
                    terms, counts, docs = (rb.column(c)[i].values for c in ("terms", "counts", "docs"))
                    fields = {k: docs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("row", "words", "own", "first")} | {"doc_id": docs.field("doc_id")}
                    seg = Segment(terms, counts.to_numpy(zero_copy_only=False), rb.column("postings")[i].as_py(), fields)
                    yield _found(seg, block.value, matches, every)

        part = index.table.mapInArrow(run, FOUND)
        parts.append(part if blocks == 1 else scratch.save(part))
    scratch.drop(windows)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part.withColumn("n_words", F.lit(0).cast("long")))
    gathered = lambda c: F.flatten(F.collect_list(c))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.array_sort(gathered("spans")).alias("spans"), F.array_sort(F.array_distinct(gathered("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of places that sorted spans cover; they may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def phrase_matches(index: PositionalIndex, items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans, n_hit and items of each document.

    ``spans``: places of words [start, end) that an occurrence of a window covers, in order; they overlap
    only where a document lies in several segments or the windows in several blocks.
    """
    if size - 1 > index.overlap:
        raise ValueError(f"segments share {index.overlap} words, too few for windows of {size}")
    found = _search(index, items, size, lambda seg, block: seg.phrases(block), id_col, text_col)
    return found.select("doc_id", "n_words", "spans", covered(F.col("spans")).alias("n_hit"), "items")


def proximity_matches(index: PositionalIndex, items: DataFrame, size: int = WINDOW, near: int = 2 * WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and the items of which all words of some window occur within ``near`` words of the document, in any order."""
    if near - 1 > index.overlap:
        raise ValueError(f"segments share {index.overlap} words, too few for stretches of {near}")
    return _search(index, items, size, lambda seg, block: seg.stretches(block, near), id_col, text_col).select("doc_id", "n_words", "items")


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = phrase_matches(PositionalIndex.build(docs), items)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i+k-1], ' ') AS x FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, k, i, array_to_string(w[i:i+k-1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), h AS (
  SELECT r, i, dw.k AS k, item FROM dw JOIN bw ON dw.x = bw.x AND dw.k = bw.k
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""
