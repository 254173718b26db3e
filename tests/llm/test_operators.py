"""The ten operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from recallspark.llm import bpe, context_tree, induced_sort, lattice, minhash, packing, quality_mil, quality_rules, suffix_dedup, toxicity, url_filter

DOC = "doc_id long, text string, extra string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "running", "idiot", "x", "Größe"]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 90)))) for i in range(30)]
    long = " ".join(f"w{rng.integers(0, 900)}" for _ in range(400))
    out += [(40, long), (41, long), (42, "tail " + long[:900] + " end"), (43, long + " more"), (44, None), (45, ""), (46, " \n\t "), (47, "<|endoftext|> x"), (48, "a" * 3000), (49, "é\U0001f600 中文 " * 40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "score") for i, t in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("short", [induced_sort.SHORT, 0])
def test_suffix_arrays_and_prefixes(short, monkeypatch):
    monkeypatch.setattr(induced_sort, "SHORT", short)
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.append(rng.integers(1, 2 + rng.integers(1, 4), rng.integers(0, 50)), 0).astype(np.int16)
        sa, x = induced_sort.suffix_array(s), s.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = induced_sort.permuted_prefixes(s, sa, 1)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k] > 1:
                k += 1
            assert common[b] == k


def removed(rows):
    """Bytes, removed bytes, spans and digest of each text in order, by sets of windows."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                hit[k : k + 100] = True
            seen.add(b[k : k + 100])
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("splits", [suffix_dedup.SPLITS, ((2, 3),), ((3, 7), (1, 1))])
def test_repeats(docs, rows, none, splits, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLITS", splits)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: x for (i, _), x in zip(sorted(rows), removed(sorted(rows)))}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_of_ids_and_long_texts(spark):
    rng = np.random.default_rng(8)
    shared = "".join(map(chr, rng.integers(97, 123, 131)))
    rows = [(1, shared + " one"), (1, "zz " + shared), (None, shared), (None, shared), (2, "short")]
    docs = spark.createDataFrame([(i, t, i, "s", 7) for i, t in rows], "doc_id long, text string, start long, shard string, tag int")
    out = suffix_dedup.clean_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r.text for r in out.collect()) == sorted([" one", "short", "zz ", shared, shared])
    kept = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept == {(None, 0), (1, 131), (2, 0)}  # rows that repeat id and text are one document
    long = "".join(map(chr, rng.integers(97, 123, (2 << 20) + 4000)))
    at = (2 << 20) - 150
    docs = spark.createDataFrame([(1, long), (2, "#" + long[at : at + 300] + "#"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()) == [(1, 0, 0), (2, 300, 1), (3, 0, 0)]


@pytest.mark.parametrize("block,pairs", [(512, 500), (2, 0)])
def test_near_duplicates(spark, rows, none, block, pairs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", pairs)
    rng = np.random.default_rng(2)
    base = [f"v{i}" for i in range(120)]
    more = []
    for i in range(40):
        copy = list(base)
        for k in rng.integers(0, 120, 3):
            copy[k] = f"z{i}"
        more.append((100 + i, " ".join(copy)))
    all_rows = [*rows, *more]
    docs = spark.createDataFrame([(i, t, "cls") for i, t in all_rows], "doc_id long, text string, rep string")

    def shingles(t):
        w = words(lower(t))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in all_rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=4).collect()}
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.near_duplicates(none).count() == 0


def test_ids_at_both_ends(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    least, most = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(most, one), (5, one), (6, two), (None, one), (None, "p q"), (most, "r s"), (least, "t u")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(most, 56, 5, False), (5, 56, 5, True), (6, 56, 6, True), (None, 56, 5, False), (None, 1, None, True), (most, 1, 5, False), (least, 1, least, True)}
    docs = spark.createDataFrame([(least, one), (None, one), (least, two), (most, two), (None, two)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed > 0, len(r.clean_text)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(str(least), True, 0), (str(least), True, 0), (str(most), True, 0), ("None", False, len(one)), ("None", False, len(two))])


def test_near_duplicates_of_missing_and_repeated_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, one), (7, two), (9, two), (3, one), (None, one), (None, "c d e f g h"), (None, "c d e f g h"), (5, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, tag int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(7, 56, 3, False), (9, 56, 3, False), (3, 56, 3, True), (None, 56, 3, False), (None, 2, None, True), (5, 0, 5, True), (6, 0, 6, True)}
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, one), (None, "c d e f g h"), (5, None), (6, " ")]))
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_context_tree(docs, rows, none):
    got = {r.doc_id: r for r in context_tree.score_texts(docs).collect()}
    train = [(i, t) for i, t in rows if crc32(str(i).encode()) % 10]
    count = Counter(w for _, t in train for w in [*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].score <= 0
    assert context_tree.score_texts(none).count() == 0


def slow_tree(train, depth):
    """log10 probability of a text, by trees of dictionaries."""
    count, below = {}, {}
    for t in train:
        b = bytes(depth) + t
        for at in range(depth, len(b)):
            for j in range(8):
                place, bit = 1 << j | b[at] >> 8 - j, b[at] >> 7 - j & 1
                for d in range(depth + 1):
                    node = place, b[at - d : at]
                    count.setdefault(node, [0, 0])[bit] += 1
                    if d < depth:
                        below.setdefault(node, set()).add((place, b[at - d - 1 : at]))
    known = {}

    def own(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(node):
        if node not in known:
            alone = own(count[node])
            rest = sum(map(weighted, below[node])) if len(node[1]) < depth else None
            known[node] = alone if rest is None else np.logaddexp(alone, rest) - math.log(2)
        return known[node]

    def chance(b, at, j, d):
        place, bit = 1 << j | b[at] >> 8 - j, b[at] >> 7 - j & 1
        node = place, b[at - d : at]
        n = count.get(node, (0, 0))
        alone = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return alone
        rest = sum(map(weighted, below.get(node, ())))
        share = 1 / (1 + math.exp(min(700, max(-700, rest - own(n)))))
        return share * alone + (1 - share) * chance(b, at, j, d + 1)

    def score(t):
        b = bytes(depth) + t
        return sum(math.log10(chance(b, at, j, 0)) for at in range(depth, len(b)) for j in range(8))

    return score


@pytest.mark.parametrize("depth", [2, 6])
def test_context_tree_against_a_slow_tree(spark, depth):
    texts = ["Ab abab", "ab ba é", "", None, "zzz zz", "abba ABBA abba", "ab ab"] * 3
    rows = [(None if i == 4 else i, t, "x") for i, t in enumerate(texts)]
    score = slow_tree([lower(t).encode() for i, t, _ in rows if crc32(b"" if i is None else str(i).encode()) % 10], depth)
    got = context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, word string"), depth=depth, block_bytes=60)
    got = {r.doc_id: r for r in got.collect()}
    for i, t, _ in rows:
        assert abs(got[i].score - score(lower(t).encode())) < 1e-5 and (got[i].score == 0) == (not t)
    # the probabilities of all bytes after one context sum to one
    import pyarrow as pa

    flat = np.frombuffer(b"abab ab baab", np.uint8)
    keys = np.unique(context_tree.grams(flat, np.array([0, len(flat)]), depth))
    every = keys[3] >> 8 << 8 | np.arange(256)
    counts = dict.fromkeys([*keys.tolist(), *every.tolist()], 0) | dict.fromkeys(keys.tolist(), 2)
    frame = spark.createDataFrame(pa.table({"key": list(counts), "n": list(counts.values())}))
    chance = [10**r.value for r in context_tree.string_scores(frame, depth).collect() if r.key in set(every.tolist())]
    assert len(chance) == 256 and abs(sum(chance) - 1) < 1e-5


def test_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip(none).count() == 0


def test_packing(docs, rows, none):
    got = packing.pack(packing.pieces(docs, size=128), size=128).toPandas()
    enc = bpe.encoder(bpe.default_vocabulary())
    for i, t in rows:
        ids = np.append(np.frombuffer(enc.encode_packed(t or ""), "<u4"), 1).astype("<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.offset == by.groupby("sequence_id").length.cumsum() - by.length).all()
    assert by.groupby("sequence_id").length.sum().max() <= 128
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packs_are_shortest_first():
    patterns = packing.shortest_pack_first({6: 2, 5: 1, 3: 3, 1: 4}, 10)
    total = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 10
        for x in lengths:
            total[x] += n
    assert total == Counter({6: 2, 5: 1, 3: 3, 1: 4})


def test_quality_rules(docs, rows, none):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in rows:
        w = words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (got[i].kept and got[i].base_failed)
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality_rules(none).count() == 0


def test_urls(spark):
    urls = ["http://a.example.com/en/7x", "http://a.example.com/en/8", "HTTP://X.NET/de/8?q", "https://example.net/de/81#a", "http://notcom/en/", None, "no scheme", "http://www.spam-farm.example.org/fr/5/", "http://spam-farm.example.org/fr/5000", "http://COM/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.farm_list(spark.createDataFrame([(5, "fr"), (5000, "de"), (6, None), (None, "fr"), (5, "fr")], "doc_id long, lang string"))
    for limit in (0, 3, 100_000):  # salted, broadcast of confirmed hits, broadcast of the list
        url_filter.BROADCAST_ENTRIES = limit
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
        assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "block"), 3: ("example.net/de/8", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow"), 9: ("com/en/", "block")}
    url_filter.BROADCAST_ENTRIES = 100_000
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 64))
    v = [(i, (centres[i % 6] + 0.1 * rng.normal(size=64)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    v += [(500, v[0][1], 0), (501, None, 0), (502, [0.0] * 64, 0), (503, v[0][1], None), (504, [float("nan")] * 64, 0), (505, [None] + v[0][1][1:], 0), (506, [], 1), (507, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.near_vectors(frame).collect()}
    good = [(i, np.array(x, float), y) for i, x, y in v if i < 501]
    links = {i: {j for j, z, w in good if j != i and w == y and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.98} for i, x, y in good}
    for i, _, _ in v:
        near = links.get(i, set())
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near), min(reach), min(reach) == i)
    assert lattice.near_vectors(frame.limit(0)).count() == 0


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8))
    q = lattice.decode_e8(x) / 2.0
    near = lattice.neighbours() / 2.0
    assert (((x - q) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - q[:, None] - near[None]) ** 2).sum(axis=2) + 1e-12).all()


def test_classifiers_learn_and_hold(spark, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        t = list(rng.choice(WORDS[:7], 60))
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            t[rng.integers(0, 60)] = "idiot"
        rows.append((i, " ".join(t) if good else " ".join(t).upper() + "!!", "label"))
        labels.append((i, good, toxic))
    rows += [(900, None, "x"), (901, "", "x"), (902, "  \n", "x"), (0, rows[0][1], "again")]
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (g, t) for i, g, t in labels}
    for run, k in ((quality_mil.quality, 0), (toxicity.toxicity, 1)):
        got = run(docs, y).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert sum(r.predicted == truth[r.doc_id][k] for r in held) > 0.95 * len(held)
        assert run(none, y).count() == 0
        assert {r.score for r in run(docs.limit(5), y.limit(0)).collect()} == {0.5}


def test_context_tree_reaches_six_bytes(spark):
    # the byte after "=xxxxx" is told by the byte six places back alone
    rng = np.random.default_rng(2)
    text = "".join(c + "_____" + c.upper() for c in rng.choice(list("abcdefghijkl"), 3000))
    lots = spark.createDataFrame([(i, text[k : k + 2100], "") for i, k in enumerate(range(0, len(text), 2100))], DOC)
    deep, flat = (np.mean([r.bits_per_byte for r in context_tree.score_texts(lots, **d).collect()]) for d in ({}, {"depth": 3}))
    assert deep < 0.8 * flat
    many = {r.doc_id: r.score for r in context_tree.score_texts(lots, block_bytes=4000).collect()}  # blocks don't change scores
    assert all(abs(many[r.doc_id] - r.score) < 1e-6 for r in context_tree.score_texts(lots).collect())


def test_toxic_terms_late_in_long_words():
    glued = "_".join(["alpha", "beta", "gamma"] * 9).encode()
    for k in range(len(glued)):
        assert any(glued[k : k + 5] in part for part in toxicity.words_of(glued))
    assert b"".join(p[4 * (i > 0) :] for i, p in enumerate(toxicity.words_of(glued))) == glued
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(300):
        t = list(rng.choice(WORDS[:7], 60))
        if i % 4 == 0:
            t[rng.integers(0, 60)] = "idiot"
        texts.append(" ".join(t).encode())
        labels.append(int(i % 4 == 0))
    clean, late = toxicity.Scorer(toxicity.train(texts, labels))([glued, glued[:80] + b"_idiot_" + glued[80:]])
    assert late > clean + 0.3


def test_sample_passes_over_texts_that_do_not_fit(spark):
    train = [i for i in range(200) if crc32(str(i).encode()) % 5]
    y = spark.createDataFrame([(i, i % 2) for i in train], "doc_id long, toxic int")
    sizes = {i: 5000 if k % 4 == 0 else 10 for k, i in enumerate(train)}
    docs = spark.createDataFrame([(i, "é" * (n // 2), "x") for i, n in sizes.items()], DOC)
    texts, labels = toxicity.labelled_sample(docs, y, "toxic", most_bytes=2000)
    assert len(texts) == len(labels) == sum(n == 10 for n in sizes.values()) and set(labels) == {0, 1}


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_crowded_shards_of_a_context_tree_are_split(spark, monkeypatch, depth):
    rng = np.random.default_rng(7)
    texts = ["".join(c + d + "e " for c, d in rng.choice(list("abcdfg"), (40, 2))) for _ in range(12)] + ["", None, "xe xe"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = slow_tree([lower(t).encode() for i, t in enumerate(texts) if crc32(str(i).encode()) % 10], depth)
    saved, save = [], context_tree.Scratch.save
    monkeypatch.setattr(context_tree.Scratch, "save", lambda self, df, *a, **k: saved.append(save(self, df, *a, **k)) or saved[-1])

    def shards():
        own = [df for df in saved if df.columns == ["shard", "key", "value"]][-1].collect()  # of the strings
        return {r.shard: len(context_tree.unpack_keys(r.key)) for r in own}

    whole = {r.doc_id: r for r in context_tree.score_texts(rows, depth=depth, block_bytes=400).collect()}
    before = shards()
    got = {r.doc_id: r for r in context_tree.score_texts(rows, depth=depth, block_bytes=400, most_keys=20).collect()}
    after = shards()
    assert sum(after.values()) == sum(before.values())
    if depth > 2:  # "e " goes before six letters, and any of six before it
        assert max(after.values()) < max(before.values()) and {context_tree.depth_of(s) for s in after} >= {2, 3}
    if depth == 6:
        assert max(before.values()) > 100 and max(after.values()) <= 40
    for i, t in enumerate(texts):
        assert abs(got[i].score - score(lower(t).encode())) < 1e-4
        assert got[i].base_score == whole[i].base_score and (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (whole[i].n_tokens, whole[i].n_known, whole[i].train_tokens)
