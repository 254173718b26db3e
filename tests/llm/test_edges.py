"""Nulls in every column, clashing names, repeated rows and hot lengths, for operators tested less elsewhere."""

import hashlib
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from recallspark.llm import bpe, context_tree, lattice, minhash, packing, quality_rules, url_filter

TEXTS = [None, "", " \t", "Some words here, some words here.", "Some words here, some words here.", "<|endoftext|>", "x" * 70]


@pytest.fixture(scope="module")
def rows():
    return [(None, TEXTS[3]), (None, TEXTS[3]), (None, None), (1, TEXTS[3]), (1, TEXTS[3]), (1, "other"), *((10 + i, t) for i, t in enumerate(TEXTS))]


def frame(spark, rows, *columns):
    """doc_id, text and columns with the names that operators use inside."""
    ddl = ", ".join(["doc_id long", "text string", *(f"{c} string" for c in columns)])
    return spark.createDataFrame([(*r, *(None for _ in columns)) for r in rows], ddl)


def test_rules(spark, rows):
    docs = frame(spark, rows, "row", "t", "words", "ws", "hit", "n_words", "kept")
    out = quality_rules.quality_rules(docs).collect()
    def repeats(words):
        windows = Counter(zip(words, words[1:], words[2:]))
        return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)})

    assert Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in out) == Counter((i, len((t or "").split()), repeats((t or "").split())) for i, t in rows)
    assert all(not r.kept and r.base_failed for r in out) and len(out) == len(rows)
    assert quality_rules.keep_passing(docs).columns == docs.columns


def test_context_tree(spark, rows):
    out = context_tree.score_texts(frame(spark, rows, "block", "held_out", "word", "shard", "key"), block_bytes=100).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    same = {(r.score, r.base_score) for r in out if r.doc_id in (None, 1) and r.n_tokens == 7}
    assert len(same) == 1 and all((r.score == 0) == (r.n_tokens == 1 and r.bits_per_byte == 0) for r in out)


def test_round_trip(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    digest = lambda t: hashlib.sha256(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    out = bpe.round_trip(frame(spark, rows, "ids", "n_tokens")).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in out) == Counter((i, digest(t)) for i, t in rows)


def test_vocabularies_that_break_an_assumption(tmp_path):
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="next larger id"):
        bpe.ForcedBoundaryBpe(str(path))


def slow_packer(lengths, size):
    """Sequences by shortest pack first, a document at a time; packs that a length opens take no more of it."""
    packs: list[list[int]] = []  # filled, length that opened it
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if p[0] + n <= size and p[1] != n]
        if fits:
            min(fits)[0] += n
        else:
            packs.append([n, n])
    return sorted(p[0] for p in packs)


def test_packing(spark, rows):
    docs = frame(spark, rows, "salt", "rank", "length", "start")
    got = packing.pack(packing.pieces(docs, size=16), size=16, salts=2, group_rows=3).toPandas()
    assert len(got[got.start == 0]) == len(rows) and (got[got.start == 0].doc_id.isna()).sum() == 3
    assert got.length.sum() == got.doc_tokens[got.start == 0].sum()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.append(0, np.cumsum(own.length))[:-1].tolist() and own.length.sum() <= 16
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(1, 40, rng.integers(1, 200)).tolist()
        plan = packing.shortest_pack_first(dict(Counter(lengths)), 40)
        assert sorted(sum(x) for n, x in plan for _ in range(n)) == slow_packer(lengths, 40)
        assert Counter(v for n, x in plan for v in x for _ in range(n)) == Counter(lengths)


def test_vectors(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=8)
    near = v + rng.normal(size=8) * 0.01
    big = (v * 1e200).tolist()  # beyond single precision
    rows = [(1, v.tolist(), "a"), (2, near.tolist(), "a"), (3, near.tolist(), "b"), (None, v.tolist(), "a"), (4, None, "a"), (5, [0.0] * 8, "a"), (6, [None] * 8, "a"), (7, [float("nan")] * 8, "a"), (8, v.tolist(), None), (9, [], "a"), (10, big, "a"), (11, v.tolist()[:7], "a")]
    docs = spark.createDataFrame([(*r, 1, True, 2) for r in rows], "vec_id long, embedding array<double>, label string, key long, stored boolean, id long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(docs).collect()}
    alone = lambda i: (0, i, True)
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), **{i: alone(i) for i in (3, 4, 5, 6, 7, 8, 9, 11, None)}}


def test_urls(spark):
    listed = spark.createDataFrame([(f"h{i}.org/{i}",) for i in range(300)] + [(None,)], "canonical string")
    urls = ["http://www.h7.org/7.html?x", "http://h7.org/8", None, "http://h7.org/7", "http://h7.org/7"]
    pages = spark.createDataFrame([(None if i == 1 else i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, key string, listed string")
    want = [(None, "allow"), (0, "block"), (2, "allow"), (3, "block"), (4, "block")]
    for blocks in (None, 1):  # one full block lets all pass to the exact join
        got = url_filter.url_filter(pages, listed, (), blocks=blocks).collect()
        assert sorted(((r.page_id, r.verdict) for r in got), key=lambda x: (x[0] is not None, x[0])) == want
    assert [url_filter.blocks_for(n) for n in (0, 12_000, 10**9)] == [url_filter.LEAST_BLOCKS, 4096, url_filter.MOST_BLOCKS]


def test_keys_of_strings():
    flat = np.frombuffer(b"abcab", np.uint8)
    keys = context_tree.grams(flat, np.array([0, 3, 5]), 2)
    assert [k.to_bytes(3, "big") for k in keys.tolist()] == [b"\0\0a", b"a\0b", b"bac", b"\0\0a", b"a\0b"]
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 55, 1000))
    assert (context_tree.unpack_keys(context_tree.pack_keys(x)) == x).all() and crc32(b"") == 0


def test_equal_length_lists():
    column = pa.chunked_array([pa.array([[1, 2], [3, 4]]), pa.array([[5, 6]])])
    assert minhash._matrix(column).tolist() == [[1, 2], [3, 4], [5, 6]]
    assert np.allclose(lattice._matrix(column.cast(pa.list_(pa.float32()))), np.array([[1, 2], [3, 4], [5, 6]]) / np.sqrt([[5], [25], [61]]))
