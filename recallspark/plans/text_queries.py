"""Registered queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import entities, scoring, text
from recallspark.operators.digests import to_millis
from recallspark.plans.queries import _M, _QUERY_VECTOR, _vectors
from recallspark.plans.registry import query
from recallspark.sources import readers
from recallspark.sources.tables import EPOCH, HOUR, memories, table

_NOISE = "concat('fooBar_', event_type, ' is the ', event_type, 'Kind of v', event_id, ' rare-token')"


def _noise(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("fooBar_"), "event_type", F.lit(" is the "), "event_type", F.lit("Kind of v"), F.col("event_id").cast("string"), F.lit(" rare-token")).alias("q"))


@query("query_tokens", f"SELECT event_id, array_to_string(string_split(trim({_NOISE}), ' '), '|') AS words FROM events")
def query_tokens(spark, d):
    return _noise(spark, d).select("event_id", F.array_join(text.query_tokens(F.col("q")), "|").alias("words"))


_SPLIT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_.\-/:]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("split_identifiers", f"SELECT event_id, {_SPLIT.format(_NOISE)} AS variant FROM events")
def split_identifiers(spark, d):
    return _noise(spark, d).select("event_id", text.split_identifiers(F.col("q")).alias("variant"))


_RARE = r"array_to_string(list_filter(string_split({0}, ' '), lambda t: regexp_matches(t, '[A-Z_./:\d]') OR length(t) >= 9), ' ')"


@query("expanded_queries", f"SELECT event_id, array_to_string([q, {_SPLIT.format('q')}, '\"' || q || '\"', {_RARE.format('q')}], '|') AS variants FROM (SELECT event_id, {_NOISE} AS q FROM events)")
def expanded_queries(spark, d):
    return _noise(spark, d).select("event_id", F.array_join(text.expand_query(F.col("q")), "|").alias("variants"))


@query("entity_query_tokens", "SELECT event_id, array_to_string(list_filter(['foo', 'bar', event_type, 'kind', 'v' || event_id, 'rare', 'token'], lambda t: length(t) >= 3), '|') AS words FROM events")
def entity_query_tokens(spark, d):
    return _noise(spark, d).select("event_id", F.array_join(entities.entity_terms(F.col("q")), "|").alias("words"))


@query("state_keys", r"SELECT event_id, lower(regexp_replace(trim('  ' || event_type || chr(9) || '  Port '), '\s+', ' ', 'g')) AS key FROM events")
def state_keys(spark, d):
    return table(spark, d, "events").select("event_id", text.state_key(F.concat(F.lit("  "), "event_type", F.lit("\t  Port "))).alias("key"))


@query("normalized_answers", f"SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower({_NOISE}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM events")
def normalized_answers(spark, d):
    return _noise(spark, d).select("event_id", text.normalize_answer(F.col("q")).alias("answer"))


@query("exact_matches", "SELECT event_id, event_type IN ('click', 'view') AS hit FROM events")
def exact_matches(spark, d):
    answers = F.array(F.array(F.lit("The Click")), F.array(F.lit("nothing"), F.lit("a view")))
    return _noise(spark, d).select("event_id", text.exact_match(F.col("q"), answers).alias("hit"))


@query("truncated_texts", _M + "SELECT id, CASE WHEN length(content) > 40 THEN substr(content, 1, 39) || '…' ELSE content END AS short FROM m")
def truncated_texts(spark, d):
    return memories(spark, d).select("id", text.truncate(F.col("content"), 40).alias("short"))


@query("scope_mentions", "SELECT event_id, event_type = 'click' AS named FROM events")
def scope_mentions(spark, d):
    return _noise(spark, d).select("event_id", text.mentions(F.concat(F.lit("the "), "event_type", F.lit(", clicks")), "click").alias("named"))


@query("quoted_terms", "SELECT event_id, event_type || '|b c' AS terms FROM events")
def quoted_terms(spark, d):
    q = F.concat(F.lit('x "'), "event_type", F.lit('" "b c" "b c" ""'))
    return table(spark, d, "events").select("event_id", F.array_join(text.quoted_terms(q), "|").alias("terms"))


@query("shared_rare_tokens", "SELECT event_id, array_to_string(list_sort(['rare', 'token'] || CASE WHEN event_type = 'error' THEN ['error'] ELSE [] END), '|') AS shared FROM events")
def shared_rare_tokens(spark, d):
    out = text.shared_rare_tokens(F.concat("q", F.lit(" kind "), "event_type"), F.lit("a rare kind of token and error"), ["kind"])
    return _noise(spark, d).select("event_id", F.array_join(F.array_sort(out), "|").alias("shared"))


@query("archive_tokens", "SELECT event_id, array_to_string(['foobar_' || event_type, event_type || 'kind', 'v' || event_id, 'rare', 'token'], '|') AS words FROM events")
def archive_tokens(spark, d):
    return _noise(spark, d).select("event_id", F.array_join(text.archive_tokens(F.col("q")), "|").alias("words"))


@query("line_chunks", """WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), c(doc_id, n, used, k) AS (SELECT doc_id, 1, length(l[1]), 1 FROM s UNION ALL
SELECT c.doc_id, n + 1, CASE WHEN used + 1 + length(l[n + 1]) <= 500 THEN used + 1 + length(l[n + 1]) ELSE length(l[n + 1]) END, CASE WHEN used + 1 + length(l[n + 1]) <= 500 THEN k ELSE k + 1 END FROM c JOIN s ON s.doc_id = c.doc_id WHERE n < len(l)) SELECT doc_id, max(k)::BIGINT AS chunks FROM c GROUP BY 1""")
def line_chunks(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(text.line_chunks(F.col("text"), 500)).cast("long").alias("chunks"))


@query("clock_forms", f"SELECT event_id, strftime(make_timestamp(({EPOCH} + event_id * {HOUR}) * 1000), '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN {EPOCH} + event_id * 1000 ELSE {EPOCH} + event_id * 1000 END AS millis, least(event_id // 5, 2) AS value_at, least(60000, 1000 * pow(2, event_id % 8))::BIGINT AS delay FROM events")
def clock_forms(spark, d):
    i = F.col("event_id")
    at = F.when(i % 2 == 0, EPOCH + i * 1000).otherwise(F.floor((EPOCH + i * 1000) / 1000))
    return table(spark, d, "events").select("event_id", text.iso_day(EPOCH + i * HOUR).alias("day"), to_millis(at).alias("millis"), text.value_index(EPOCH + i * HOUR, F.lit(EPOCH), 5 * HOUR, 3).alias("value_at"), text.retry_delay(i % 8).alias("delay"))


@query("dataset_dates", f"SELECT event_id, {EPOCH} + (event_id % 28) * 86400000 + (event_id % 24) * {HOUR} AS at FROM events")
def dataset_dates(spark, d):
    i = F.col("event_id")
    raw = F.date_format(F.timestamp_millis(EPOCH + (i % 28) * 86_400_000 + (i % 24) * HOUR), "yyyy/MM/dd '('EEE')' HH:mm")
    return table(spark, d, "events").select("event_id", readers.dataset_time(raw).alias("at"))


@query("score_parts", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[64], {_QUERY_VECTOR}::DOUBLE[64]), 6) AS cosine, round(0.3 * least(greatest(0.5 + (vec_id % 10 / 10.0 - 0.5) * 2, 0), 1) + 0.7 * 0.25, 6) AS blended, round(CASE WHEN vec_id % 5 * 1000 <= 1000 THEN 0.1 WHEN vec_id % 5 * 1000 >= 4000 THEN 0.4 ELSE 0.1 + 0.3 * (vec_id % 5 * 1000 - 1000) / 3000.0 END, 6) AS share FROM embeddings")
def score_parts(spark, d):
    i = F.col("id")
    target = F.array(*[F.lit(float(x)) for x in _QUERY_VECTOR])
    return _vectors(spark, d).select("id", F.round(scoring.cosine(F.col("embedding"), target), 6).alias("cosine"), F.round(scoring.rerank_blend(F.lit(0.25), i % 10 / 10, 0.3), 6).alias("blended"), F.round(scoring.digest_share(i % 5 * 1000), 6).alias("share"))


@query("fact_pool", "SELECT event_id AS serial, event_type || ' happened' AS fact FROM events")
def fact_pool(spark, d):
    lines = F.concat_ws("\n", F.concat(F.col("event_id").cast("string"), F.lit(". "), "event_type", F.lit(" happened")), F.lit("no number here"))
    return readers.fact_pool(table(spark, d, "events").select(lines.alias("context")))


@query("decoded_rows", f"SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'a|b' ELSE '' END AS tags, {EPOCH} + event_id AS valid_from FROM events")
def decoded_rows(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, '["a", 7, "b"]').when(i % 3 == 1, "[broken")
    rows = table(spark, d, "events").select(i.alias("id"), raw.alias("tags"), (EPOCH + i).alias("created_at"), F.lit(None).cast("long").alias("valid_from"))
    return readers.decoded(rows).select("id", F.array_join("tags", "|").alias("tags"), "valid_from")


@query("staged_items", "SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS revision FROM documents WHERE doc_id % 2 = 1 OR doc_id % 4 = 0")
def staged_items(spark, d):
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("content"))
    stored = x.where("item_id % 2 = 0").select("source", "item_id", F.lit(1).alias("revision"), F.when(F.col("item_id") % 4 == 0, "other").otherwise(F.sha2("content", 256)).alias("content_hash"), F.lit(1).alias("generation"))
    return readers.staged(x.withColumn("generation", F.lit(2)), stored).select("item_id", "revision")
