"""Queries that write the given tables in the shapes that readers take, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallspark.functions import json_values
from recallspark.operators import channels, graph, upkeep
from recallspark.plans.queries import _M, _vectors
from recallspark.plans.registry import query
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors
from recallspark.plans.upkeep_queries import _NAMED, _ranked
from recallspark.sources import readers
from recallspark.sources.tables import EPOCH, HOUR, links, memories, table
from recallspark.streaming import ledgers


def _folder(spark) -> str:
    return f"{Scratch.of(spark).root}/files-{uuid.uuid4().hex}"


@query("store_vectors", "SELECT vec_id AS id, vec_id % 7 = 0 AS stale FROM embeddings")
def store_vectors(spark, d):
    """A store's declared tables, some vectors of which have lost a component."""
    folder, v = _folder(spark), _vectors(spark, d)
    shorter = F.when(F.col("id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    v.select("id", shorter.alias("embedding")).write.parquet(f"{folder}/embeddings")
    for name, rows in (("memories", memories(spark, d)), ("links", links(spark, d)), ("episodes", memories(spark, d).select("id", "namespace"))):
        rows.write.parquet(f"{folder}/{name}")
    return readers.open_tables(spark, folder, 64)["embeddings"].select("id", "stale")


@query("json_array_rows", "SELECT n - 1 AS index, c_custkey AS k, c_mktsegment AS segment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE (n - 1) % 3 = 0 ORDER BY n LIMIT 500")
def json_array_rows(spark, d):
    folder = _folder(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    # the format is one array in one file
    whole = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "segment"))), lambda r: F.to_json(r)), ","), F.lit("]")).alias("value"))
    whole.coalesce(1).write.text(folder)
    return readers.json_array(spark, folder, "k long, segment string", 3, 500).select(F.col("index").cast("long").alias("index"), "k", "segment")


@query("json_line_rows", "SELECT event_id, event_type, value FROM events WHERE event_id % 11 <> 0")
def json_line_rows(spark, d):
    """Lines of JSON, some of them broken off."""
    folder = _folder(spark)
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    return readers.json_lines(spark, folder, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("dialogue_rows", "SELECT conv_id // 10 AS sample_id, conv_id % 10 AS session, turn AS position, conv_id || ':' || turn AS dia_id, role AS speaker, text FROM conversations")
def dialogue_rows(spark, d):
    """Samples of ten dialogues each, with a date beside every one."""
    c = table(spark, d, "conversations")
    turn = F.struct("turn", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), F.col("role").alias("speaker"), "text")
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["dia_id"].alias("dia_id"), x["speaker"].alias("speaker"), x["text"].alias("text")))
    name = F.concat(F.lit("session_"), (F.col("conv_id") % 10).cast("string"))
    entries = F.array(F.struct(name.alias("key"), turns.alias("value")), F.struct(F.concat(name, F.lit("_date_time")).alias("key"), F.slice(turns, 1, 1).alias("value")))
    samples = one.select(F.floor(F.col("conv_id") / 10).alias("sample_id"), F.explode(entries).alias("e")).groupBy("sample_id").agg(F.map_from_entries(F.collect_list("e")).alias("conversation"))
    out = readers.dialogue_turns(samples)
    return out.select("sample_id", F.col("session").cast("long").alias("session"), F.col("position").cast("long").alias("position"), "dia_id", "speaker", "text")


_STACK = f"s AS (SELECT conv_id // 5 AS question_id, 's' || conv_id AS session_id, conv_id, {EPOCH} + (conv_id % 28) * {24 * HOUR} AS date, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"


def _haystack(spark, d):
    c = table(spark, d, "conversations")
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    date = F.date_format(F.timestamp_millis(F.lit(EPOCH) + (F.col("conv_id") % 28) * 24 * HOUR), "yyyy/MM/dd '('EEE')' HH:mm")
    rows = one.select(F.floor(F.col("conv_id") / 5).alias("question_id"), F.struct("conv_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), date.alias("date"), turns.alias("turns")).alias("s"))
    own = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("s")).alias("l"))  # five sessions
    answers = F.transform(F.filter("l", lambda s: s["conv_id"] % 5 < 2), lambda s: s["id"])
    return own.select("question_id", answers.alias("answer_session_ids"), F.transform("l", lambda s: s["id"]).alias("haystack_session_ids"), F.transform("l", lambda s: s["date"]).alias("haystack_dates"), F.transform("l", lambda s: s["turns"]).alias("haystack_sessions"))


@query("haystack_corpus", f"WITH {_STACK} SELECT question_id, session_id, date, content FROM s")
def haystack_corpus(spark, d):
    return readers.haystack(_haystack(spark, d))[0]


@query("haystack_targets", f"WITH {_STACK} SELECT question_id, array_to_string(list_sort(list(session_id)), ',') AS targets, arg_max(session_id, {{'d': date, 's': session_id}}) AS latest_target FROM s WHERE conv_id % 5 < 2 GROUP BY 1")
def haystack_targets(spark, d):
    return readers.haystack(_haystack(spark, d))[1].select("question_id", F.array_join("targets", ",").alias("targets"), "latest_target")


@query("schema_faults", """SELECT event_id, CASE WHEN event_id % 5 = 1 AND json_extract_string(props, '$.k') <> '0' THEN '$.k: not integer' WHEN event_id % 5 = 2 THEN '$.k: missing' WHEN event_id % 5 = 3 THEN '$: not JSON' WHEN event_id % 5 = 4 THEN '$.l[1]: not string' END AS fault FROM events""")
def schema_faults(spark, d):
    ensure_on_executors(spark)
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "l": {"type": "array", "items": {"type": "string"}}}}
    props = F.expr("""CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN replace(props, ': ', ': 0.') WHEN 2 THEN replace(props, 'k', 'q') WHEN 3 THEN substring(props, 1, 5) ELSE replace(props, '}', ', "l": ["a", 1]}') END""")
    return table(spark, d, "events").where("event_id IS NOT NULL").select("event_id", json_values.schema_fault(props, schema).alias("fault"))


@query("entities_by_name", f"{_M}, {_NAMED}, n AS (SELECT lower(min(entity_text)) AS name FROM nd) SELECT memory_id FROM nd JOIN m ON m.id = nd.memory_id WHERE lower(entity_text) = (SELECT name FROM n) GROUP BY 1 ORDER BY max(m.created_at) DESC, memory_id LIMIT 20")
def entities_by_name(spark, d):
    """Memories that name the first of all entities, whatever its case."""
    named = channels.entity_rows(memories(spark, d))
    first = named.agg(F.min("entity_text")).first()[0]
    return channels.entity_lookup(named, first or "").select("memory_id")


_KEEPER = """k AS (SELECT m.id, first_value(m.id) OVER (w ORDER BY pinned DESC, importance DESC, access_count DESC, coalesce(degree, 0) DESC, created_at, m.id) AS keeper FROM m LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM l UNION ALL SELECT target_id FROM l WHERE source_id <> target_id) GROUP BY id) g ON m.id = g.id WINDOW w AS (PARTITION BY namespace, type, substring(coalesce(content, ''), 1, 48)))"""


@query("prune_plan", f"{_M}, {_KEEPER} SELECT id, keeper FROM k WHERE id <> keeper")
def prune_plan(spark, d):
    return upkeep.prune_plan(upkeep.lexical_families(_ranked(spark, d), whole_prefix=True)).select("id", "keeper")


@query("repointed_links", f"{_M}, {_KEEPER}, r AS (SELECT * FROM k WHERE id <> keeper), x AS (SELECT coalesce(s.keeper, l.source_id) AS source_id, coalesce(t.keeper, l.target_id) AS target_id, link_type, s.id IS NOT NULL OR t.id IS NOT NULL AS moved FROM l LEFT JOIN r s ON s.id = l.source_id LEFT JOIN r t ON t.id = l.target_id) SELECT DISTINCT source_id, target_id, link_type FROM x WHERE NOT (moved AND source_id = target_id)")
def repointed_links(spark, d):
    plan = upkeep.prune_plan(upkeep.lexical_families(_ranked(spark, d), whole_prefix=True))
    return upkeep.repointed(links(spark, d), plan).select("source_id", "target_id", "link_type")


@query("appended_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY 1, 2")
def appended_once(spark, d):
    """A batch, a later one and the first again: what was stored stays single."""
    path, e = _folder(spark), table(spark, d, "events")
    for part in (e.where("event_id % 3 <> 0"), e, e.where("event_id % 3 <> 0")):
        ledgers.append_once(part.select("user_id", "event_type", "props"), path, ["user_id", "event_type", "props"])
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("drained_batches", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def drained_batches(spark, d):
    """A stream of files handed on in micro-batches, each stored under its number."""
    folder = _folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    e.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    ledgers.drained(stream, store, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("pointer_ends", _M.replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT source_id AS id, min(target_id) AS next FROM l GROUP BY 1), w(id, pos, steps) AS (SELECT id, next, 1 FROM p UNION ALL SELECT w.id, p.next, steps + 1 FROM w JOIN p ON p.id = w.pos)
SELECT id, arg_max(pos, steps) AS end_id, max(steps)::BIGINT AS steps FROM w GROUP BY 1""")
def pointer_ends(spark, d):
    ends = graph.pointer_ends(links(spark, d).select(F.col("source_id").alias("id"), F.col("target_id").alias("next")))
    return ends.select("id", F.col("end").alias("end_id"), "steps")
