"""The vector cache: writers side by side, uses, eviction and merging, against a dictionary."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from recallspark.operators.vector_cache import STEP_MS, VectorCache
from recallspark.plans.scratch import Scratch


@pytest.fixture
def cache(spark):
    return VectorCache(spark, f"{Scratch.of(spark).root}/vectors-{uuid.uuid4().hex}")


def texts(spark, names):
    return spark.createDataFrame([(n, None if n is None else [float(len(n)), float(ord(n[-1]))]) for n in names], "text string, embedding array<double>")


def found(df):
    return {r.text: None if r.embedding is None else list(r.embedding) for r in df.collect()}


def vector(n):
    return [float(len(n)), float(ord(n[-1]))]


def test_put_and_get(spark, cache):
    asked = texts(spark, ["a", "bb", "zz", None])
    assert found(cache.get(asked, "m", 1)) == {"a": None, "bb": None, "zz": None}
    cache.put(texts(spark, ["a", "bb", "a", None]), "m", 1)
    cache.put(spark.createDataFrame([("a", [9.0]), ("none", None), ("empty", [])], "text string, embedding array<double>"), "m", 2)  # an entry never changes
    assert found(cache.get(asked, "m", 3)) == {"a": vector("a"), "bb": vector("bb"), "zz": None}
    assert found(cache.get(asked, "other", 3)) == {"a": None, "bb": None, "zz": None}
    assert cache.entries().count() == 2 and cache.last_uses().where("used_at = 3").count() == 2


def test_two_writers_lose_nothing(spark, cache):
    names = [[f"w{w}-{i}" for i in range(40)] for w in range(4)]
    cache.put(texts(spark, ["start"]), "m", 0)
    failures = []

    def work(w):
        try:
            cache.put(texts(spark, names[w]), "m", w)
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)] + [threading.Thread(target=cache.compact)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    every = ["start", *(n for own in names for n in own)]
    assert found(cache.get(texts(spark, every), "m", 9)) == {n: vector(n) for n in every}
    cache.compact()
    assert found(cache.get(texts(spark, every), "m", 10)) == {n: vector(n) for n in every} and len(cache._folders("entries")) == 1


def test_eviction_by_last_use(spark, cache):
    names = [f"t{i}" for i in range(30)]
    for i in range(3):
        cache.put(texts(spark, names[i::3]), "m", i * STEP_MS)
    cache.get(texts(spark, names[:5]), "m", 7 * STEP_MS + 5)
    cache.get(texts(spark, names[3:8]), "m", 9 * STEP_MS)
    key = {r.text: r.key for r in texts(spark, names).select("text", F.sha2(F.concat(F.lit("m\0"), "text").cast("binary"), 256).alias("key")).collect()}
    last = {n: (i % 3) * STEP_MS for i, n in enumerate(names)} | {n: 7 * STEP_MS + 5 for n in names[:5]} | {n: 9 * STEP_MS for n in names[3:8]}
    for capacity in (0, 4, 5, 7, 17, 30, 99):
        want = {key[n] for n in sorted(names, key=lambda n: (-last[n], key[n]))[:capacity]}
        assert {r.key for r in cache.kept(capacity).collect()} == want
    cache.compact(7)
    left = sorted(names, key=lambda n: (-last[n], key[n]))[:7]
    assert {r.key for r in cache.entries().collect()} == {key[n] for n in left}
    assert {r.key: r.used_at for r in cache.last_uses().collect()} == {key[n]: last[n] for n in left}


def test_lookups_read_the_partitions_of_their_keys(spark, cache):
    cache.put(texts(spark, [f"t{i}" for i in range(60)]), "m", 1)
    plan = cache.entries().where("prefix = 'ab'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan
