"""The postings table against scans of the same texts: fields, batches, partitions read, best matches."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.operators import retrieval
from recallspark.operators.postings import PostingsIndex
from recallspark.plans.scratch import Scratch

WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "x1"]
FIELDS = {"content": 10.0, "tags": 5.0}


def folder(spark):
    return f"{Scratch.of(spark).root}/postings-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(rng.choice(WORDS, n, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.03, 0.02]))
    return [(int(i), text(rng.integers(0, 30)), text(rng.integers(0, 3))) for i in rng.permutation(300) - 20]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, content string, tags string")


def cells(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def blocks(index):
    return cells(index.blocks(None, index.generations()[0]).drop("bucket").select("term", "block", F.col("ids").cast("string"), F.col("dls").cast("string"), F.col("content").cast("string"), F.col("tags").cast("string"), "n", "least_dl", "most_content", "most_tags"))


@pytest.fixture(scope="module")
def index(spark, rows):
    return PostingsIndex.create(frame(spark, rows), folder(spark), FIELDS, buckets=8, bits=5)


@pytest.mark.parametrize("terms", [["alpha", "zeta"], ["x1", "gamma", "delta"], ["alpha"], ["nowhere", "alpha", "beta"], ["nowhere"]])
def test_same_counts_and_relevance_as_a_scan(spark, rows, index, terms):
    docs = frame(spark, rows)
    for scope in (docs, docs.where("id % 3 = 0"), docs.limit(0)):
        scan, read = retrieval.count_terms(scope, terms, FIELDS), index.count(terms, scope)
        assert (scan.rows, scan.df, scan.most, round(scan.mean, 9)) == (read.rows, read.df, read.most, round(read.mean, 9))
        assert cells(scan.hits.select("id", scan.bm25, scan.matched)) == cells(read.hits.select("id", read.bm25, read.matched))
        for window, scoped in [(2000, True), (7, True), (7, False)]:
            assert cells(retrieval.relevance(scan, window, scoped)) == cells(retrieval.relevance(read, window, scoped))


def test_windows(spark, rows):
    docs = frame(spark, rows)
    c = retrieval.count_terms(docs, ["alpha", "beta"], FIELDS)
    length = {i: len(a) + len(b) for i, a, b in rows}
    both = [i for i, a, b in rows if all(w in f"{a} {b}".split() for w in ("alpha", "beta"))]
    # both terms are everywhere, so coverage ranks: of each term's rows the shortest
    for window in (5, 40):
        per_term = [sorted((i for i, a, b in rows if w in f"{a} {b}".split()), key=lambda i: (length[i], i))[:window] for w in ("alpha", "beta")]
        got = {r.id: r.relevance for r in retrieval.relevance(c, window).collect()}
        assert len(both) > window and got == {i: sum(i in x for x in per_term) / 2 for x in per_term for i in x}
    rare = retrieval.count_terms(docs, ["zeta", "x1", "delta"], FIELDS)
    assert 0 < retrieval.relevance(rare, 3).count() <= 3
    plan = retrieval.relevance(rare, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_reads_only_the_terms_partitions(index):
    plan = index.blocks(["zeta"], index.generations()[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,zeta)]" in plan


def test_batches_equal_a_rebuild(spark, rows):
    old = [(i, a, b) for i, a, b in rows if i % 2]
    changed = [(i, f"new {a}", None) for i, a, b in rows if i % 3 == 0]
    gone = [(i,) for i, _, _ in rows if i % 5 == 0] + [(9999,)]
    index = PostingsIndex.create(frame(spark, old), folder(spark), FIELDS, buckets=8, bits=5)
    number = index.add(frame(spark, changed))
    index.add(frame(spark, []), spark.createDataFrame(gone, "id long"))
    index.add(frame(spark, changed), number=number)  # a batch that runs again
    left = {i: (i, a, b) for i, a, b in old} | {r[0]: r for r in changed}
    left = [r for i, r in left.items() if i % 5]
    again = PostingsIndex.create(frame(spark, left), folder(spark), FIELDS, buckets=8, bits=5)
    for terms in (["alpha", "new"], ["delta"]):
        a, b = index.count(terms), again.count(terms)
        assert (a.df, a.rows) == (b.df, b.rows) and cells(a.hits) == cells(b.hits)
        assert cells(index.best(terms, 9)) == cells(again.best(terms, 9))
    assert len(index.generations()) == 3
    index.compact()
    assert len(index.generations()) == 1 and blocks(index) == blocks(again)
    index.compact()
    assert blocks(index) == blocks(again)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("probed", [1, 4, 100])
def test_best_matches(spark, rows, index, every, probed):
    for terms in (["zeta", "alpha"], ["x1", "delta", "x1"], ["gamma"], ["nowhere", "alpha"]):
        c = index.count(list(dict.fromkeys(terms)))
        want = c.hits.where(c.matched == c.terms) if every else c.hits
        want = want.select("id", c.bm25.alias("s")).orderBy(F.desc("s"), "id").limit(6).collect()
        got = index.best(terms, 6, every, probed).collect()
        assert [(r.id, round(r.bm25, 9)) for r in got] == [(r.id, round(r.s, 9)) for r in want]


def test_ids_missing_and_repeated_and_empty_tables(spark):
    docs = frame(spark, [(None, "alpha", ""), (1, "alpha", None), (1, "beta", ""), (1, "alpha", None), (-5, None, None)])
    index = PostingsIndex.create(docs, folder(spark), FIELDS, buckets=4)
    assert [tuple(r) for r in index.frequencies().collect()] == [("beta", 1, 1, 0)]
    assert sorted(r.id for r in index.documents().collect()) == [-5, 1]
    none = PostingsIndex.create(docs.limit(0), folder(spark), FIELDS, buckets=4)
    assert none.count(["alpha"]).rows == 0 and none.best(["alpha"], 3).count() == 0 and none.frequencies().count() == 0


def test_lengths_are_counted_before_words(spark, rows, index):
    plan = index._counted(frame(spark, rows).repartition(2))._jdf.queryExecution().executedPlan().toString()
    words = next(line for line in plan.splitlines() if "Generate inline(words" in line)
    assert "[id" in words and "content" not in words.split("inline(words")[1]  # a word carries its text's length, not the text
    assert plan.count("Exchange hashpartitioning(") == 1
