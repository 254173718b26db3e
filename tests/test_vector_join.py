"""Nearest vectors of many queries against all pairs."""

import numpy as np
import pytest

from recallspark.operators.vector_join import nearest_many
from recallspark.plans.scratch import Scratch

VECTOR = "id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], VECTOR).repartition(3)


def slow(vectors, queries, k, below):
    out = set()
    known = [(i, np.array(v, float)) for i, v in vectors if v is not None]
    for q, x in queries:
        if x is not None:
            d = sorted((float(np.sqrt(((v - np.array(x, float)) ** 2).sum())), i) for i, v in known if i != q)
            out |= {(q, i, round(s, 9)) for s, i in [p for p in d if below is None or p[0] < below][:k]}
    return out


def cells(df):
    return {(r.query_id, r.id, round(r.distance, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(5, 6)) * 4
    v = [(i, np.float32(groups[i % 5] + rng.normal(size=6) * (0.05 if i % 3 else 1))) for i in range(400)]
    v += [(1000 + i, v[i][1]) for i in range(40)] + [(2000 + i, np.zeros(6)) for i in range(30)] + [(3000, None)]
    return v


@pytest.mark.parametrize("k,below", [(3, None), (7, 0.5), (1000, 3.0), (1, None)])
@pytest.mark.parametrize("pivots,block", [(64, 4096), (5, 20), (1, 7)])
def test_same_as_all_pairs(spark, vectors, k, below, pivots, block):
    queries = [*vectors[::9], (3000, None), (5000, np.ones(6)), (5001, np.full(6, 50.0))]
    got = nearest_many(frame(spark, vectors), frame(spark, queries), k, below, pivots, block)
    assert cells(got) == slow(vectors, queries, k, below)


def test_empty_and_small_tables(spark, vectors):
    some, none = frame(spark, vectors[:4]), frame(spark, vectors[:1]).limit(0)
    assert nearest_many(none, some, 3).count() == 0 and nearest_many(some, none, 3).count() == 0
    assert nearest_many(frame(spark, [(1, None)]), some, 3).count() == 0
    assert cells(nearest_many(some, some, 9)) == slow(vectors[:4], vectors[:4], 9, None)


def test_passes_do_not_grow_with_queries(spark, vectors, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: saved.append(1) or save(self, *a, **k))
    for n in (3, 400):
        saved.clear()
        plan = nearest_many(frame(spark, vectors), frame(spark, vectors[:n]), 2, block=50)
        assert len(saved) == 2 and plan._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 2


def test_cells_far_away_are_not_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4) + 1000 * (i % 8)) for i in range(800)]
    asked, save = [], Scratch.save
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Scratch, "save", lambda self, df, *a, **k: asked.append(save(self, df, *a, **k)) or asked[-1])
        nearest_many(frame(spark, rows), frame(spark, rows[:80]), 3)
    cells_of = asked[1].groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert cells_of <= 16  # of 64: those around the query's own group
