"""Components, ranks and streams on small inputs, and the driver's contract without the llm folders."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from recallspark.operators.components import connected_components
from recallspark.operators.graph import personalised_rank
from recallspark.streaming import ledgers

ROOT = Path(__file__).resolve().parent.parent


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_matches_power_iteration(spark):
    edges = [(1, 2, 0.5), (2, 3, 1.0), (3, 1, 0.25), (3, 4, 0.75)]
    links = spark.createDataFrame(edges, "source_id long, target_id long, similarity double")
    got = {r.id: r["rank"] for r in personalised_rank(links, spark.createDataFrame([(1,)], "id long")).collect()}
    w = {}
    for a, b, s in edges:
        w[a, b] = w[b, a] = s
    rank = {1: 1.0}
    for _ in range(20):
        new = {1: 0.15}
        for a, r in rank.items():
            total = sum(s for (x, _), s in w.items() if x == a)
            for (x, b), s in w.items():
                if x == a:
                    new[b] = new.get(b, 0) + 0.85 * r * s / total
        rank = new
    assert all(abs(got[k] - v) < 1e-9 for k, v in rank.items())


def test_streaming_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ledgers.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = ledgers.windowed_counts(events)
    pick = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert pick(spark.table("counts")) == pick(batch)


def test_append_once_is_idempotent(spark, tmp_path):
    batch = spark.range(10).withColumn("v", F.lit("x"))
    for _ in range(2):
        ledgers.append_once(batch, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_entry_works_without_training_data_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__")  # corpus_pipeline.py stays, and can't be imported
    shutil.copytree(ROOT, tmp_path / "r", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
