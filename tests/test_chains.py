"""Pointer doubling and closures against walks one step at a time, and the number of their rounds."""

import numpy as np
import pytest

from recallspark.operators import components, graph
from recallspark.plans.scratch import Scratch

LINK = "source_id long, target_id long, link_type string, revision int, created_at long, judged_at long"


def links(spark, pairs):
    return spark.createDataFrame([(a, b, "supersedes", 1, a, None) for a, b in pairs], LINK)


def walk(pairs, most=None):
    """id -> (end, steps, loops), one step at a time."""
    step = {}
    for a, b in pairs:
        step[a] = min(b, step.get(a, b))
    out = {}
    for i in step:
        seen, at = [i], step[i]
        while at in step and at not in seen:
            seen.append(at)
            at = step[at]
        if at in seen:
            out[i] = (min(seen[seen.index(at) :]), len(seen) - 1, True)
        else:
            out[i] = (at, len(seen), False)
    return out


@pytest.fixture
def saves(monkeypatch):
    n, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: n.append(1) or save(self, *a, **k))
    return n


def test_pointers_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    for n, edges in [(30, 40), (60, 55), (12, 12)]:
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (edges, 2))]
        got = {r.id: (r.end, r.steps, r.loops) for r in graph.pointer_ends(spark.createDataFrame([*pairs, (None, 1), (1, None)], "id long, next long")).collect()}
        assert got == walk(pairs)
        depth = {r.id: r.depth for r in graph.chain_depth(links(spark, pairs)).collect()}
        assert depth == {i: steps + 1 for i, (_, steps, _) in walk(pairs).items()}
    pairs = [(i, i + 1) for i in range(150)] + [(900, 901), (901, 902), (902, 900), (903, 901)]  # a short loop beside a chain beyond the bound
    depth = {r.id: r.depth for r in graph.chain_depth(links(spark, pairs)).collect()}
    assert depth == {i: min(steps + 1, 101) for i, (_, steps, _) in walk(pairs).items()}


def test_a_long_chain_takes_few_rounds(spark, saves):
    n = 10_000
    order = np.random.default_rng(1).permutation(n).tolist()
    pairs = list(zip(order, order[1:]))
    frame = links(spark, pairs)
    ends = graph.pointer_ends(frame.selectExpr("source_id AS id", "target_id AS next"))
    assert len(saves) <= 17 and ends.where(f"end <> {order[-1]}").count() == 0  # two tables and at most 15 rounds
    assert {r.id: r.steps for r in ends.collect()} == {i: n - 1 - k for k, i in enumerate(order[:-1])}
    saves.clear()
    assert {r.id: r.depth for r in graph.chain_depth(frame).collect()} == {i: min(n - k, 101) for k, i in enumerate(order[:-1])}
    assert len(saves) <= 17
    saves.clear()
    seeds = spark.createDataFrame([(order[5],), (n + 7,)], "id long")
    got = graph.closure(frame, seeds)
    assert len(saves) <= 17 and got.where(f"seed = {order[5]}").count() == n and got.where(f"seed = {n + 7}").count() == 1


def test_closure_in_order_and_at_a_time(spark):
    pairs = [(i + 1, i) for i in range(1000)]
    assert graph.closure(links(spark, pairs), spark.createDataFrame([(0,)], "id long"), as_of=500).count() == 501
    assert graph.closure(links(spark, pairs).limit(0), spark.createDataFrame([(4,), (4,)], "id long")).collect() == [(4, 4)]
    assert components.connected_components(links(spark, [(1, 1)]), "source_id", "target_id").collect() == [(1, 1)]
