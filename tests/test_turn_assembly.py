"""Assembled turns against buying them one by one."""

import random
from datetime import UTC, datetime

import pytest

from recallspark.operators import turn_assembly as ta

TURN = "session_id string, turn int, role string, text string, created_at long"
HIT = "query_id int, session_id string, turn int, rank int"


def date(ms):
    return "undated" if ms is None else datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d %H:%M utc")


def slow(sessions, hits, budget, ingest, render, first, reserve):
    """(blocks, (chars, sessions, turns, skipped)) of one query."""
    covered = {}
    for s, turn, rank in sorted(hits, key=lambda h: h[2]):
        if s in sessions and 0 <= turn < len(sessions[s][1]):
            for i in range(max(0, turn - render), min(len(sessions[s][1]) - 1, turn + ingest - 1 + render) + 1):
                covered.setdefault(s, {})
                covered[s][i] = min(rank, covered[s].get(i, rank))
    line = lambda s, i: ": ".join(x for x in (sessions[s][1][i][0], sessions[s][1][i][1]) if x is not None) if sessions[s][1][i][0] else sessions[s][1][i][1]
    when = lambda s: (sessions[s][0] is None, sessions[s][0] or 0, s)
    kept, used = {}, 0
    if first:
        every = [(s, i, r) for s, t in covered.items() for i, r in t.items()]
        for s, i, _ in sorted(every, key=lambda x: (x[2] >= reserve, sessions[x[0]][1][x[1]][0] != "user", x[2], x[0], x[1])):
            cost = len(line(s, i)) + 1 + (0 if s in kept else len(date(sessions[s][0])) + 2 + (2 if kept else 0))
            if used + cost <= budget:
                kept.setdefault(s, []).append(i)
                used += cost
    else:
        for s in sorted(covered, key=lambda s: (min(covered[s].values()), *when(s))):
            text, own = f"[{date(sessions[s][0])}]", []
            for i in sorted(covered[s]):
                longer = f"{text}\n{line(s, i)}"
                if used + len(longer) + (2 if kept else 0) <= budget:
                    text = longer
                    own.append(i)
            if own:
                kept[s] = own
                used += len(text) + (2 if len(kept) > 1 else 0)
    shown = [f"[{date(sessions[s][0])}]\n" + "\n".join(line(s, i) for i in sorted(kept[s])) for s in sorted(kept, key=when)]
    return shown, (len("\n\n".join(shown)), len(kept), sum(map(len, kept.values())), len(covered) - len(kept))


@pytest.mark.parametrize("first,reserve", [(False, 0), (True, 0), (True, 3)])
@pytest.mark.parametrize("budget,ingest,render", [(400, 1, 1), (150, 2, 0), (30, 1, 2), (5000, 3, 1)])
def test_same_as_one_by_one(spark, first, reserve, budget, ingest, render):
    rng = random.Random(budget)
    sessions = {f"s{k}": (None if k % 5 == 0 else 1_700_000_000_000 + rng.randrange(3) * 86_400_000, [(rng.choice(["user", "assistant", ""]), "word " * rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))]) for k in range(12)}
    hits = {q: [(f"s{rng.randrange(14)}", rng.randrange(-1, 9), r) for r in range(rng.randrange(1, 10))] for q in range(8)}
    turns = spark.createDataFrame([(s, i, role, text, at) for s, (at, t) in sessions.items() for i, (role, text) in enumerate(t)], TURN)
    frame = spark.createDataFrame([(q, *h) for q, own in hits.items() for h in own], HIT)
    kept = ta.assembled_turns(frame, turns, budget, ingest, render, first, reserve)
    got, told = {}, {r.query_id: tuple(r)[1:] for r in ta.summary(frame, turns, kept, ingest, render).collect()}
    for r in sorted(ta.blocks(kept).collect(), key=lambda r: (r.query_id, r.block)):
        got.setdefault(r.query_id, []).append(r.text)
    for q, own in hits.items():
        shown, counts = slow(sessions, own, budget, ingest, render, first, reserve)
        assert got.get(q, []) == shown
        assert told.get(q, (0, 0, 0, 0)) == counts
