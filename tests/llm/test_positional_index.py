"""Phrase and proximity matches of the positional index against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from recallspark.llm import positional_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, terms string, items string, row long"
ITEM = "item_id long, text string, spans string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def windows(t, size):
    w = words(t)
    k = min(size, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def slow(docs, items, size):
    """(doc_id, words, covered words, items) of every row."""
    known = {}
    for i, t in items:
        for w in windows(t, size):
            known.setdefault(w, set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in known}:
            for a in range(len(w) - k + 1):
                if own := known.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def slow_near(docs, items, size, near):
    out = []
    for i, t in docs:
        w, found = words(t), set()
        for j, text in items:
            for x in windows(text, size):
                if any(set(x) <= set(w[a : a + near]) for a in range(max(1, len(w) - near + 1))):
                    found.add("" if j is None else str(j))
        out.append((i, len(w), tuple(sorted(found))))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    vocabulary = ["a", "B", "c", "the", "Of", "é", "9x", "中", "zebra"]
    text = lambda n, sep: sep.join(rng.choice(vocabulary, n))
    items = [(i, text(int(n), "-")) for i, n in enumerate(rng.integers(1, 9, 12))] + [(None, "the of the"), (3, "zebra zebra"), (50, None), (51, " .. "), (52, "one"), (52, "one")]
    docs = [(i, text(int(n), ", ")) for i, n in enumerate(rng.integers(0, 60, 60))]
    docs += [(100, None), (101, ""), (102, "!!"), (103, "one"), (103, "one"), (None, "ONE two"), (None, "ONE two"), (104, "ab"), (105, "c" * 500 + " one")]
    docs += [(200, text(4000, " ")), (201, "the " * 3000), (202, text(700, "\n"))]
    return docs, items


@pytest.mark.parametrize("blocks,portion,segment", [(200_000, 1 << 20, 1 << 19), (7, 50, 100), (3, 1 << 20, 64)])
def test_phrases(spark, rows, monkeypatch, blocks, portion, segment):
    monkeypatch.setattr(pi, "BLOCK_WINDOWS", blocks)
    docs, items = rows
    frame = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs], DOC).repartition(3)
    listed = spark.createDataFrame([(i, t, "z") for i, t in items], ITEM)
    index = pi.PositionalIndex.build(frame, overlap=20, segment_bytes=2000, segment_words=segment)
    for size in (4, 2):
        got = pi.phrase_matches(index, listed, size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == slow(docs, items, size)
        assert all(len({p for s in r.spans for p in range(s.start, s.end)}) == r.n_hit for r in got)


def test_portions_of_candidates(spark, rows, monkeypatch):
    docs, items = rows
    monkeypatch.setattr(pi, "CANDIDATES", 64)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    block = pi.Block.of(pi.windows_of(spark.createDataFrame(items, "item_id long, text string"), 4).toArrow(), 4)
    index = pi.PositionalIndex.build(frame, segment_bytes=1 << 20)
    row = index.table.toArrow()
    assert row.num_rows == 1 and len(block.names) == len({i for i, t in items if words(t)})
    d = row.column("docs")[0].values
    fields = {k: d.field(k).to_numpy().astype(np.int64) for k in ("row", "words", "own", "first")} | {"doc_id": d.field("doc_id")}
    seg = pi.Segment(row.column("terms")[0].values, row.column("counts")[0].values.to_numpy(), row.column("postings")[0].as_py(), fields)
    found = pi._found(seg, block, lambda s, b: s.phrases(b), True)
    assert Counter(zip(found.column("doc_id").to_pylist(), found.column("n_words").to_pylist(), (tuple(sorted(x)) for x in found.column("items").to_pylist()))) == Counter(
        (i, n, x) for i, n, _, x in slow(docs, items, 4).elements()
    )


@pytest.mark.parametrize("segment", [1 << 19, 80])
def test_proximity(spark, rows, segment):
    docs, items = rows
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = pi.PositionalIndex.build(frame, overlap=20, segment_bytes=3000, segment_words=segment)
    got = pi.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), 4, 6).collect()
    assert Counter((r.doc_id, r.n_words, tuple(r["items"])) for r in got) == slow_near(docs, items, 4, 6)
    with pytest.raises(ValueError):
        pi.proximity_matches(index, frame, near=40)


def test_occurrences_and_empty_tables(spark, rows):
    docs, items = rows
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = pi.PositionalIndex.build(frame)
    assert {r.term: r.n for r in index.occurrences().collect()} == Counter(w for _, t in docs for w in words(t))
    none, listed = frame.limit(0), spark.createDataFrame(items, "item_id long, text string")
    assert pi.phrase_matches(pi.PositionalIndex.build(none), listed).count() == 0
    out = pi.phrase_matches(index, listed.limit(0)).collect()
    assert len(out) == len(docs) and not any(r.n_hit or r["items"] for r in out)


def test_index_has_small_row_groups(spark):
    import pyarrow.parquet as pq

    text = "concat_ws(' ', transform(sequence(1, 1 << 15), x -> hex(xxhash64(id, x))))"
    docs = spark.range(0, 128, numPartitions=1).selectExpr("id AS doc_id", f"{text} AS text")
    index = pi.PositionalIndex.build(docs, segment_bytes=1 << 20)
    groups = [m.row_group(i) for f in index.table.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://").removeprefix("file:"))] for i in range(m.num_row_groups)]
    # a task holds a row group while it writes or reads, whatever it has to index
    assert sum(g.total_byte_size for g in groups) > 48 << 20 and max(g.total_byte_size for g in groups) < 32 << 20
