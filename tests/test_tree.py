"""Consolidation of a scope tree, level by level, against a recursive walk."""

import random

import pytest

from recallspark.operators import digests, reports

MEMORY = "id long, namespace string, type string, content string, pinned boolean, origin string, importance double, created_at long"
TOPIC = "id long, namespace string, summary string, updated_at long"


def packed(lines, budget):
    if len("\n".join(lines)) <= budget:
        return "\n".join(lines)
    kept, used = [], 0
    for line in lines:
        cost = len(line) + (1 if kept else 0)
        if used + cost + 24 > budget:
            break
        kept.append(line)
        used += cost
    if not kept:
        return lines[0][: max(budget - 1, 1)] + "…"
    return ("\n".join(kept) + f"\n…({len(lines) - len(kept)} more)")[:budget]


def slow(rows, topics, nodes, pins, path, budget, out, depth=0, most=64):
    if depth > most:
        return
    children = sorted(n for n, parent in nodes.items() if parent == path)
    for child in children:
        slow(rows, topics, nodes, pins, child, budget, out, depth + 1, most)
    lines = [x.strip(" ") for x in pins.get(path, "").split("\n") if x.strip(" ")]
    own = sorted((t for t in topics if t[1] == path and t[2].strip(" ")), key=lambda t: (-t[3], t[0]))[:5]
    lines += [f"[topic] {t[2].strip(' ')}" for t in own]
    promoted = sorted((r for r in rows if r[1] == path and r[5] == "promotion"), key=lambda r: (-r[6], -r[7], r[0]))[:4]
    lines += ["[pattern] " + r[3].split("\n")[0].strip(" ")[:160] for r in promoted]
    for child in children[:8]:
        if child not in out:
            continue
        told = [x.strip(" ") for x in out[child].split("\n") if x.strip(" ")]
        lines += [f"[child {child}] " + (told[0] if told else "(no digest yet)"), *(f"  {x}" for x in told[1:])]
    out[path] = packed(lines, budget) if lines else ""


@pytest.fixture(scope="module")
def tree():
    rng = random.Random(8)
    paths = ["/r"]
    for i in range(60):
        paths.append(f"{rng.choice(paths[-12:])}/{rng.choice('abcdefghijkl')}{i}")
    paths += [f"/r/w{i:02d}" for i in range(15)]
    words = ["short", "a longer line of facts", "two\nlines here", "  spaced  ", "x" * 300]
    rows = [(i, rng.choice(paths), "fact", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.random() < 0.3, "promotion" if rng.random() < 0.2 else None, rng.randrange(4) / 10, rng.randrange(20)) for i in range(250)]
    rows += [(1000, "/other/a", "fact", "elsewhere", True, None, 0.1, 1)]
    topics = [(i, rng.choice(paths), rng.choice(["topic one", " ", "topic two "]), rng.randrange(9)) for i in range(80)]
    return rows, topics


@pytest.mark.parametrize("budget,most", [(1200, 64), (90, 64), (400, 3)])
def test_same_as_recursion(spark, tree, budget, most):
    rows, topics = tree
    m, t = spark.createDataFrame(rows, MEMORY), spark.createDataFrame(topics, TOPIC)
    nodes = reports.namespace_nodes(m)
    parents = {r.path: r.parent_path for r in nodes.collect()}
    pins = {r.namespace: r.content for r in digests.digests(m).collect()}
    want = {}
    slow(rows, topics, parents, pins, "/r", budget, want, 0, most)
    got = {r.path: r.digest for r in digests.consolidated(m, t, nodes, "/r", budget, most).collect()}
    assert got == want and len(got) > (25 if most == 3 else 60)
    assert digests.consolidated(m, t, nodes, "/none").count() == 0
