"""The corpus pipeline against plain Python, stage by stage."""

import numpy as np
import pytest

import corpus_pipeline as P
from recallspark.llm import quality_mil, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(400)] + ["the", "of", "and", "to", "in", "is"] * 40
    sentence = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    prose = lambda n: " ".join(sentence(rng.integers(8, 15)) for _ in range(n))
    shared = prose(5)
    rows = [(i, prose(12)) for i in range(40)]
    rows += [(40, rows[0][1]), (41, rows[1][1] + " Indeed."), (42, prose(6) + " " + shared), (43, shared + " " + prose(6))]
    rows += [(44 + i, "#### $$$$ **** " * 30) for i in range(20)] + [(70, "too short"), (71, None), (72, "")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 44), 0) for i, _ in rows if i < 64], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows)


def test_stages_and_run(spark, corpus):
    folder, texts = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    assert [n for n, _ in P.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "suffix-array dedup", "packing"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == COLUMNS
        seen.append({r.doc_id: r.text for r in out.collect()} if name != "packing" else out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)
    ruled, good, single, cut, pieces = seen
    passed = {r.doc_id for r in quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.kept}
    assert set(ruled) == passed and not passed & {70, 71, 72}
    score = {r.doc_id: r.score for r in quality_mil.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(good) == {i for i in passed if score[i] >= 0.3} and not set(good) & set(range(44, 64))
    assert set(single) == set(good) - {40, 41}

    windows: set[bytes] = set()
    for i in sorted(single):
        b = single[i].encode()
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in windows:
                hit[k : k + 100] = True
            windows.add(b[k : k + 100])
        assert cut[i] == bytes(c for c, h in zip(b, hit) if not h).decode(errors="ignore")
    assert len(cut[43]) < len(texts[43]) and cut[42] == texts[42]

    for i in cut:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(n for _, n in own) == next(p.doc_tokens for p in pieces if p.doc_id == i)
    run = P.run(spark, folder).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, pieces))
