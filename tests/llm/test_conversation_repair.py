"""Conversation repair against an exhaustive search over edits, small and large blocks, and edge cases."""

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import numpy as np
import pytest

from recallspark.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?\Z")
CONV = "conv_id long, turn long, role string, text string, copies string, mark long, part string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind < 2 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.append((conv, turn, "user" if kind == 4 else role, text, 0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def cheapest(rows, faults):
    """(cost, letters, turns) by search over all edits, with the pattern followed by one letter at a time."""
    steps = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "0'", ("0'", "u"): "2"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in ("0", "0'") else []
        if i < len(rows):
            role, text, fault = rows[i][0], rows[i][1], faults[i]
            c, letters, turns = best(i + 1, state, 2)
            options.append((c + 3, "D" + letters, turns))
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                for r, letter, cost in [(role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)]:
                    if r[:1] and (state, r[:1]) in steps:
                        c, letters, turns = best(i + 1, steps[state, r[:1]], 2)
                        options.append((c + cost + add, letter + letters, ((r, text), *turns)))
        if inserts:
            for initial, r in names.items():
                if (state, initial) in steps:
                    c, letters, turns = best(i, steps[state, initial], inserts - 1)
                    options.append((c + 2, "I" + letters, ((r, ""), *turns)))
        return min(options, key=lambda x: x[:2]) if options else (10**9, "", ())

    return best(0, "0", 2)


def slow(rows):
    out = []
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    for conv, own in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        own = [(turn, role, text) for _, turn, role, text, copies in own for _ in range(copies)]
        faults, known = [], set()
        for _, role, text in own:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in known else "truncated" if body[-1] not in ".!?" else "")
            known.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters, left = cheapest(tuple(r[1:] for r in own), tuple(faults))
        assert GOOD.match("".join(r[:1] for r, _ in left))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, digest))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "usher", "", "tool", None]
    texts = ["Yes.", "Why?", "no end", "", " \n", "Well! ", "cut \t", "é.", None, "x\x85", "Go!\n"]
    out = []
    for conv in range(150):
        for turn in range(int(rng.integers(1, 9))):
            regular = "user" if turn % 2 == 0 else "assistant"
            role = regular if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            t = None if rng.random() < 0.05 else int(turn + (rng.random() < 0.1) * 3)
            out.append((conv, t, role, texts[rng.integers(len(texts))]))
    for turn in range(260):
        out.append((777, turn, ["user", "assistant", "system"][int(rng.integers(3))], texts[rng.integers(len(texts))] or f"t{turn % 90}."))
    return out + [(None, 0, "user", "Hm."), (None, None, "assistant", None), (-4, 1, "system", "S."), (9223372036854775807, -3, "user", "A.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "7", None, "p") for r in rows], CONV).repartition(5)


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_same_as_search(spark, rows, block):
    dealt = cr.damaged(frame(spark, rows))
    assert Counter(map(tuple, dealt.collect())) == Counter(damage(rows))
    pieces = cr.repair(dealt, block_rows=block)
    got = Counter(tuple(r) for r in cr.report(pieces).collect())
    assert got == Counter(slow(damage(rows)))


def test_bytes_of_blocks_and_rows_without_copies(spark, rows):
    bare = frame(spark, [r for r in rows if r[0] == 777]).drop("copies")
    pieces = cr.repair(bare, block_bytes=300)
    got = cr.report(pieces).collect()
    assert pieces.count() > 2 and [tuple(r) for r in got] == slow([(*r, 1) for r in rows if r[0] == 777])


def test_long_texts_equal_rows_and_no_rows(spark):
    long = "x" * 5_000_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 1, "assistant", long + "."), *[(2, 5, "user", "Same.")] * 40, (2, 6, "assistant", "Done.")]
    got = Counter(tuple(r) for r in cr.report(cr.repair(frame(spark, rows).drop("copies"), block_rows=6)).collect())
    assert got == Counter(slow([(*r, 1) for r in rows]))
    assert cr.report(cr.repair(cr.damaged(frame(spark, rows).limit(0)))).count() == 0


def test_all_short_sequences():
    rng = np.random.default_rng(2)
    for _ in range(300):
        symbols = "".join(rng.choice(list("suaxSUAXF"), rng.integers(0, 8)))
        own = tuple(({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), f"t{i}") for i, c in enumerate(symbols))
        faults = tuple("blank" if c == "F" else "truncated" if c.isupper() else "" for c in symbols)
        cost, letters, left = cheapest(own, faults)
        got = cr.solve(symbols)
        assert got[:2] == (cost, letters)
        assert tuple(cr.edited(*got[1:], [r for r, _ in own], [t for _, t in own])) == left
