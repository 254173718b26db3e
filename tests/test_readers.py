"""Readers of nested inputs, streams, digests of corpora and assembled sections, against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallspark.operators import digests, recall, runs
from recallspark.sources import readers
from recallspark.streaming import ledgers


def test_json_arrays_and_lines(spark, tmp_path):
    rows = [{"id": i, "text": f"t{i}", "more": [i]} for i in range(23)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows))
    got = readers.json_array(spark, str(path), "id long, text string", stride=5, limit=3).collect()
    assert sorted((r["index"], r["id"], r["text"]) for r in got) == [(0, 0, "t0"), (5, 5, "t5"), (10, 10, "t10")]
    assert readers.json_facts(spark, str(path)) == (23, hashlib.sha256(path.read_bytes()).hexdigest())
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r["id"] for r in readers.json_lines(spark, str(lines), "id long").collect()) == [1, 2]
    assert readers.drift(spark.read.json(str(lines)), StructType.fromDDL("id string, gone int")) == ["id: bigint instead of string", "gone: missing"]


def test_dialogues_and_haystacks(spark, tmp_path):
    path = tmp_path / "d.json"
    talk = {"sample_id": "s", "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "hi"}, {"dia_id": "D1:2", "speaker": "B", "text": "yo"}], "session_1_date_time": "x", "session_10": [{"dia_id": "D10:1", "speaker": "A", "text": "ok"}]}}
    path.write_text(json.dumps([talk]))
    rows = readers.json_array(spark, str(path), "sample_id string, conversation map<string, string>")
    rows = rows.withColumn("conversation", F.transform_values("conversation", lambda _, v: F.try_parse_json(v)))
    assert [(r.session, r.position, r.dia_id, r.text) for r in readers.dialogue_turns(rows).orderBy("session", "position").collect()] == [(1, 0, "D1:1", "hi"), (1, 1, "D1:2", "yo"), (10, 0, "D10:1", "ok")]
    hay = [("q", ["b", "a"], ["2023/05/20 (Sat) 02:21", "2023/06/01 (Thu) 10:00", "bad"], ["a", "b", "c"], [[("user", "one"), ("assistant", "two")], [("user", "three")], []])]
    ddl = "question_id string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>"
    corpus, qrels = readers.haystack(spark.createDataFrame(hay, ddl))
    assert {(r.session_id, r.date, r.content) for r in corpus.collect()} == {("a", 1684549260000, "user: one\nassistant: two"), ("b", 1685613600000, "user: three"), ("c", None, "")}
    assert [(r.targets, r.latest_target) for r in qrels.collect()] == [(["a", "b"], "b")]


def test_store_of_declared_tables(spark, tmp_path):
    for name, ddl in readers.SCHEMAS.items():
        rows = [(1, [0.5, 0.5]), (2, [1.0]), (3, None)] if name == "embeddings" else []
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}")
    tables = readers.open_tables(spark, str(tmp_path), dimension=2)
    assert {r.id: r.stale for r in tables["embeddings"].collect()} == {1: False, 2: True, 3: True}
    assert tables["links"].count() == 0


def test_corpus_hash_and_report(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string")
    one = runs.corpus_hash(rows, ["id", "text"])
    assert one == runs.corpus_hash(rows.repartition(7), ["text", "id"]) != runs.corpus_hash(rows.where("id > 0"), ["id", "text"])
    assert digests.report(rows.where("id = 3")) == "| id | text |\n| --- | --- |\n| 3 | t3 |"


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", 10), (1, "a", 20), (2, "a", 5)], "user_id long, kind string, at long").select("user_id", "kind", F.timestamp_seconds("at").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    query = ledgers.drained(ledgers.first_within(stream, ["user_id", "kind"], "1 hour"), lambda batch, n: seen.extend(batch.collect()), f"{tmp_path}/c")
    query.awaitTermination()
    assert sorted(r.user_id for r in seen) == [1, 2]
    assert sorted(r.user_id for r in ledgers.first_within(events, ["user_id"], "1 hour").collect()) == [1, 2]


def slow_assembly(items, budget, recipe):
    spec, carry = recall.RECIPES[recipe]["sections"], recall.RECIPES[recipe]["carry"]

    def pack(rows, limit, room, served):
        kept, cut, left = [], len(rows) > limit, room
        for x in rows[:limit]:
            if x[1] in served or x[1] in {k[1] for k in kept}:
                continue
            if x[2] <= left:
                kept.append((*x[:2], x[2]))
                left -= x[2]
            elif left > recall.LEAST_ITEM:
                kept.append((*x[:2], left))
                left, cut = 0, True
            else:
                cut = True
        return kept, cut, room - left

    by = {k: sorted((p, i, c) for kind, p, i, c in items if kind == k) for k in spec}
    out, used, allotted, served = {}, 0, 0, set()
    for k, (share, limit) in spec.items():
        own = int(budget * share)
        room = min(own + (max(0, allotted - used) if carry else 0), budget - used)
        allotted += own
        out[k] = pack(by[k], limit, room, served)
        served |= {x[1] for x in out[k][0]}
        used += out[k][2]
    if carry:
        for k, (_, limit) in spec.items():
            if out[k][1]:
                others = {x[1] for o in spec if o != k for x in out[o][0]}
                again = pack(by[k], limit, out[k][2] + budget - used, others)
                if again[2] > out[k][2]:
                    used += again[2] - out[k][2]
                    out[k] = again
    return {(k, *x) for k in spec for x in out[k][0]}


@pytest.mark.parametrize("recipe", ["default", "qa", "session-priming"])
def test_assembled_sections(spark, recipe):
    import random

    rng = random.Random(4)
    kinds = ["evidence", "memories", "summaries", "state", "working"]
    groups = {g: [(rng.choice(kinds), p, rng.randrange(60), rng.choice([0, 5, 40, 120, 300])) for p in range(rng.randrange(1, 40))] for g in range(12)}
    rows = spark.createDataFrame([(g, *x) for g, own in groups.items() for x in own], "query_id long, kind string, place int, id long, chars int")
    got = {}
    for r in recall.assembled(rows, 700, recipe).collect():
        got.setdefault(r.query_id, set()).add((r.kind, r.place, r.id, r.chars))
    want = {g: slow_assembly(own, 700, recipe) for g, own in groups.items()}
    assert got == {g: v for g, v in want.items() if v}
