"""A change feed read in pages, against changes applied one by one; failures in the middle of a page."""

import uuid

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from recallspark.plans.scratch import Scratch
from recallspark.sources.connector import CHANGE, ParquetFeed, SourceState, change_stream, sync


def folder(spark, name):
    return f"{Scratch.of(spark).root}/{name}-{uuid.uuid4().hex}"


def slow(changes):
    """Current items, all revisions and counts."""
    items, known, gone, n = {}, {}, set(), {"upserted": 0, "deleted": 0, "skipped": 0}
    for _, kind, item, revision, content, at in sorted(changes):
        item = item or ""
        if kind == "delete":
            gone.add(item)
            items.pop(item, None)
            n["deleted"] += 1
        elif item in gone or (item, revision) in known:
            n["skipped"] += 1
        else:
            known[item, revision] = items[item] = (revision, content or "", at)
            n["upserted"] += 1
    return items, set(known), n


@pytest.fixture(scope="module")
def changes():
    rng = np.random.default_rng(9)
    out = []
    for seq in sorted(rng.choice(240, 200, replace=False).tolist()):
        item, revision = f"i{rng.integers(40)}", f"r{rng.integers(6)}"
        kind = "delete" if rng.random() < 0.04 else "upsert"
        out.append((seq, kind, None if rng.random() < 0.02 else item, revision, f"text {revision}" if revision != "r5" else None, 7 if revision == "r1" else None))
    return [c for c in out if not 80 <= c[0] < 160]  # a page without changes


@pytest.fixture(scope="module")
def feed(spark, changes):
    path = folder(spark, "feed")
    spark.createDataFrame(changes, CHANGE).repartition(3).write.parquet(path)
    return ParquetFeed(path)


def state_of(state):
    items = {r.external_id: (r.revision, r.content, r.occurred_at) for r in state.items().collect()}
    known = {(r.external_id, r.revision) for r in state.revisions().collect()}
    journal = sorted(tuple(r) for r in state.journal().collect())
    return items, known, journal


@pytest.mark.parametrize("page", [80, 1000])
def test_pages(spark, feed, changes, page):
    state = SourceState(spark, folder(spark, "state"))
    sync(spark, feed, state, folder(spark, "checkpoint"), page)
    items, known, journal = state_of(state)
    want = slow(changes)
    assert (items, known) == want[:2]
    assert {k: sum(r[i] for r in journal) for i, k in ((4, "upserted"), (5, "deleted"), (6, "skipped"))} == want[2]
    assert [r[0] for r in journal] == list(range(1, len(journal) + 1)) and len(journal) == -(-feed.head() // page)
    assert all(a[2] == b[1] for a, b in zip(journal, journal[1:])) and state.position() == (feed.head(), len(journal))
    old = {(r.external_id, r.revision) for r in state.withdrawn().collect()}
    assert old == known - {(i, r[0]) for i, r in items.items()}


@pytest.mark.parametrize("part", ["before", "halfway", "after"])
def test_stop_and_restart_in_a_page(spark, feed, changes, part):
    state, checkpoint = SourceState(spark, folder(spark, "state")), folder(spark, "checkpoint")

    def failing(own, rows, start, end, generation):
        if generation == 3:
            if part == "halfway":  # some files of the page, and no journal
                target = own._pages.folder(generation)
                spark.createDataFrame([("junk", 3)], "external_id string, generation long").write.parquet(f"{target}/tombstones")
            if part == "after":
                SourceState.apply(own, rows, start, end, generation)
            raise RuntimeError("lost")
        SourceState.apply(own, rows, start, end, generation)

    with pytest.raises(StreamingQueryException):
        sync(spark, feed, state, checkpoint, 80, failing)
    assert state.position()[1] == (3 if part == "after" else 2)
    replays = []
    sync(spark, feed, state, checkpoint, 80, lambda *a: replays.append(SourceState.apply(*a)))
    assert replays[0]["replay"] == (part == "after") and not any(r["replay"] for r in replays[1:])
    once = SourceState(spark, folder(spark, "state"))
    sync(spark, feed, once, folder(spark, "checkpoint"), 80)
    assert state_of(state) == state_of(once) and state_of(state)[:2] == slow(changes)[:2]
    sync(spark, feed, state, folder(spark, "checkpoint"), 80)  # a new checkpoint goes on at the state's cursor
    assert state_of(state) == state_of(once)


def test_growing_feed_and_refusals(spark):
    path = folder(spark, "feed")
    write = lambda rows: spark.createDataFrame(rows, CHANGE).write.mode("append").parquet(path)
    write([(0, "upsert", "a", "1", "x", None), (1, "upsert", "b", "1", "y", None)])
    state, checkpoint = SourceState(spark, folder(spark, "state")), folder(spark, "checkpoint")
    sync(spark, ParquetFeed(path), state, checkpoint, 10)
    write([(2, "upsert", "a", "2", "z", 5), (3, "delete", "b", None, None, None), (4, "upsert", "b", "2", "again", None)])
    sync(spark, ParquetFeed(path), state, checkpoint, 10)
    assert state_of(state)[0] == {"a": ("2", "z", 5)} and state.position() == (5, 2)
    page = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    good = page((5, "upsert", "c", "1", "c", None))
    for rows, start, generation in [
        (good, 4, 3),
        (good, 5, 4),
        (page((5, "upsert", "a", "1", "other", None)), 5, 3),
        (page((5, "rename", "a", "1", "x", None)), 5, 3),
        (page((2, "upsert", "a", "2", "changed", 5)), 2, 2),
        (page((5, "upsert", "d", "1", "p", None), (6, "upsert", "d", "1", "q", None)), 5, 3),
    ]:
        with pytest.raises(ValueError):
            state.apply(rows, start, 7, generation)
    assert state.apply(good, 5, 7, 3) == {"upserted": 1, "deleted": 0, "skipped": 0, "replay": False}
    assert state.apply(good, 5, 7, 3)["replay"] and state.apply(good.limit(0), 7, 9, 4)["upserted"] == 0
    with pytest.raises(ValueError):
        change_stream(spark, ParquetFeed(path), state, 0)


def test_pages_are_applied_together(spark, feed, changes, monkeypatch):
    applied, real = [], SourceState._write
    monkeypatch.setattr(SourceState, "_write", lambda self, rows, pages, *a: applied.append(len(pages)) or real(self, rows, pages, *a))
    together, single = (SourceState(spark, folder(spark, "state")) for _ in range(2))
    sync(spark, feed, together, folder(spark, "checkpoint"), 40)
    assert applied == [-(-feed.head() // 40)]  # one write for all pages
    sync(spark, feed, single, folder(spark, "checkpoint"), 40, lambda *a: SourceState.apply(*a))
    assert state_of(together) == state_of(single)
    stones = lambda s: sorted(tuple(r) for r in s.tombstones().collect())
    assert stones(together) == stones(single)


def test_refused_page_keeps_those_before(spark):
    path = folder(spark, "feed")
    rows = [(0, "upsert", "a", "1", "x", None), (1, "upsert", "b", "1", "y", None), (2, "upsert", "a", "1", "other", None), (3, "upsert", "c", "1", "z", None)]
    spark.createDataFrame(rows, CHANGE).write.parquet(path)
    state = SourceState(spark, folder(spark, "state"))
    with pytest.raises(StreamingQueryException):
        sync(spark, ParquetFeed(path), state, folder(spark, "checkpoint"), 1)
    assert state.position() == (2, 2) and set(state_of(state)[0]) == {"a", "b"}
