"""Keys of JSON values: equal for equal values, apart for others, against canonical texts."""

import json
import random

from pyspark.sql import functions as F

from recallspark.functions import json_values
from recallspark.operators import reports


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind < 6:
        return [None, rng.random() < 0.5, rng.randrange(3), rng.choice([0.5, 1.0, -2.0, 1e3]), rng.choice(["1", "a,b", "", 'q"', "é\n"]), str(rng.randrange(3))][kind]
    if kind == 6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("abc") + rng.choice(["", '"', ":"]): _value(rng, depth + 1) for _ in range(rng.randrange(3))}


def _spelled(v, rng):
    if isinstance(v, dict):
        pairs = list(v.items())
        rng.shuffle(pairs)
        return "{" + " ,".join(f"{json.dumps(k)} : {_spelled(x, rng)}" for k, x in pairs) + " }"
    if isinstance(v, list):
        return "[ " + ",".join(_spelled(x, rng) for x in v) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return rng.choice([repr(v), repr(float(v)), f"{float(v):e}"])
    return json.dumps(v, ensure_ascii=rng.random() < 0.5)


def test_keys_agree_with_canonical_texts(spark):
    rng = random.Random(4)
    texts = [_spelled(v, rng) for v in (_value(rng) for _ in range(150)) for _ in range(2)]
    texts += ["nope", None, "", '{"a":1,"a":2}', "1e999", "[" * 12 + "]" * 12, "[" * 13 + "]" * 13, json.dumps("x" * 9000), "-0.0", "0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    keys = {r.i: r.k for r in rows.select("i", json_values.canonical_key(F.col("t")).alias("k")).collect()}
    plain = [json_values.canonical(t) for t in texts]
    for i in range(300):
        assert keys[i] is not None
        for j in range(i):
            assert (keys[i] == keys[j]) == (plain[i] == plain[j]), (texts[i], texts[j])
    assert [keys[300 + i] is None for i in range(8)] == [True, True, True, True, True, False, True, True] and keys[308] == keys[309]


def test_facts_that_say_the_same(spark):
    facts = [(1, "s", "p", '{"a":1,"b":2}', 5), (2, "s", "p", '{"b":2.0,"a":1}', 4), (3, "s", "p", '{"a":"1","b":2}', 1), (4, None, "p", "1", 1), (5, None, "p", "1.0", 2), (6, "", "p", "1", 0), (7, "s", "q", None, 1), (8, "s", "p", "{", 1)]
    frame = spark.createDataFrame(facts, "memory_id long, subject string, predicate string, value string, observed_at long")
    got = sorted(map(tuple, reports.same_assertions(frame).collect()))
    assert got == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2), (6, 6, 1)]
    held = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert [r.memory_id for r in reports.assertions(frame, held, "p", '{ "b": 2, "a": 1e0 }').collect()] == [1, 2]
    assert reports.same_assertions(frame.limit(0)).count() == 0
