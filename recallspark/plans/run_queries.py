"""Registered queries of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.operators import runs
from recallspark.plans.registry import query
from recallspark.sources.tables import table

_RANK = "r AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, CASE WHEN event_id % 4 = 0 THEN '/q' ELSE '/p' END AS namespace, props AS content FROM events)"
_QUERIES = "q AS (SELECT user_id AS query_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, list(event_id) FILTER (event_type = 'purchase') AS targets, list(event_id) FILTER (event_type = 'error') AS forbidden FROM events GROUP BY 1)"
_RUN = f"WITH {_RANK}, {_QUERIES}, h AS (SELECT q.*, r.id, rank, namespace, content FROM q JOIN r USING (query_id) WHERE rank <= 10)"
_DETAIL = """d AS (SELECT query_id, any_value(kind) AS kind, len(any_value(targets)) AS targets, round(count(*) FILTER (list_contains(targets, id) AND rank <= 5) / len(any_value(targets)), 3) AS recall_5, round(count(*) FILTER (list_contains(targets, id)) / 10, 3) AS precision_10,
  round(coalesce(1 / min(rank) FILTER (list_contains(targets, id)), 0), 3) AS mrr, round(avg((namespace <> '/p')::INT), 3) AS leak_rate, round(avg(list_contains(forbidden, id)::INT), 3) AS stale_rate, sum(length(content))::BIGINT AS served_chars, sum(ceil(length(content) / 4))::BIGINT AS served_tokens FROM h GROUP BY query_id HAVING len(any_value(targets)) > 0)"""


def _run(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(w).alias("rank"), F.when(F.col("event_id") % 4 == 0, "/q").otherwise("/p").alias("namespace"), F.col("props").alias("content"))
    ids = lambda t: F.collect_list(F.when(F.col("event_type") == t, F.col("event_id")))
    q = e.groupBy(F.col("user_id").alias("query_id")).agg(ids("purchase").alias("targets"), ids("error").alias("forbidden"))
    q = q.select("query_id", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b").alias("kind"), F.lit("/p").alias("namespace"), "targets", "forbidden", F.get("targets", F.lit(0)).alias("latest_target"), F.lit(False).alias("subtree"))
    return q.where("size(targets) > 0"), ranked


@query("scored_queries", f"{_RUN}, {_DETAIL} SELECT * FROM d")
def scored_queries(spark, d):
    return runs.scored_queries(*_run(spark, d)).select("query_id", "kind", "targets", "recall_5", "precision_10", "mrr", "leak_rate", "stale_rate", "served_chars", "served_tokens")


@query("averages_by_kind", f"{_RUN}, {_DETAIL} SELECT kind, count(*) AS queries, round(avg(mrr), 3) AS mrr, round(avg(leak_rate), 3) AS leak_rate, round(sum(served_tokens) / sum(served_chars), 3) AS tokens_per_char, round(sum(served_tokens) / count(*), 3) AS tokens_per_query FROM d GROUP BY kind")
def averages_by_kind(spark, d):
    return runs.averages(runs.scored_queries(*_run(spark, d))).select("kind", "queries", "mrr", "leak_rate", "tokens_per_char", "tokens_per_query")


@query("token_costs", "SELECT conv_id AS query_id, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(sum(ceil(length(text) / 4)) / sum(length(text)), 6) AS tokens_per_char FROM conversations GROUP BY 1 HAVING sum(length(text)) > 0")
def token_costs(spark, d):
    out = runs.token_cost(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("content")))
    return out.where("chars > 0").select("query_id", "chars", "tokens", F.round("tokens_per_char", 6).alias("tokens_per_char"))


@query("confidence_by_relation", "SELECT l_shipmode AS relation, count(*) AS n, round(avg(l_discount), 3) AS mean_confidence FROM (SELECT l_discount, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1")
def confidence_by_relation(spark, d):
    return runs.confidence_by_relation(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence")))


@query("candidate_recall", "SELECT event_type AS relation, count(*) AS pairs, round(avg((event_id % 3 = 0)::INT), 3) AS recall FROM events GROUP BY 1")
def candidate_recall(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.col("event_type").alias("relation"))
    return runs.candidate_recall(e, e.where("id % 3 = 0"))


_SYSTEMS = "g AS (SELECT 's' || (l_linenumber % 3) AS system, l_orderkey AS question_id, l_returnflag AS reader, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS question_type, bool_or(l_quantity > 25) AS correct, min(l_quantity) AS tokens FROM lineitem GROUP BY 1, 2, 3, 4)"
_GRADED = "x AS (SELECT system, question_id, min(question_type) AS question_type, bool_or(correct) AS correct FROM g GROUP BY 1, 2)"
_COMMON = "c AS (SELECT question_id FROM x GROUP BY 1 HAVING count(*) = 3)"


def _systems(spark, d):
    x = table(spark, d, "lineitem")
    kind = F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd")
    by = [F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("system"), F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("reader"), kind.alias("question_type")]
    return x.groupBy(*by).agg(F.bool_or(F.col("l_quantity") > 25).alias("correct"), F.min("l_quantity").alias("tokens"))


def _graded(spark, d):
    return _systems(spark, d).groupBy("system", "question_id").agg(F.min("question_type").alias("question_type"), F.bool_or("correct").alias("correct"))


@query("reader_aggregates", f"WITH {_SYSTEMS} SELECT reader, question_type, count(*) AS questions, count(correct) AS graded, round(avg(correct::INT), 3) AS accuracy, round(avg(tokens), 3) AS tokens FROM g GROUP BY GROUPING SETS ((reader), (reader, question_type))")
def reader_aggregates(spark, d):
    return runs.reader_aggregates(_systems(spark, d))


@query("common_questions", f"WITH {_SYSTEMS}, {_GRADED}, {_COMMON} SELECT question_id FROM c")
def common_questions(spark, d):
    return runs.common_questions(_graded(spark, d))


@query("paired_questions", f"WITH {_SYSTEMS}, {_GRADED} SELECT question_id, CASE WHEN bool_or(system = 's1') AND bool_or(system = 's2') THEN 'both' WHEN bool_or(system = 's1') THEN 'only_left' ELSE 'only_right' END AS side FROM x WHERE system IN ('s1', 's2') GROUP BY 1")
def paired_questions(spark, d):
    return runs.paired(_graded(spark, d), "s1", "s2")


@query("compared_systems", f"""WITH {_SYSTEMS}, {_GRADED}, {_COMMON}, y AS (SELECT * FROM x WHERE question_id IN (SELECT question_id FROM c))
SELECT a.question_type, a.system AS "left", b.system AS "right", count(*) AS n, round(avg(a.correct::INT), 6) AS accuracy_left, count(*) FILTER (a.correct AND NOT b.correct) AS only_left, count(*) FILTER (b.correct AND NOT a.correct) AS only_right, count(*) < 30 AS low_n FROM y a JOIN y b ON a.question_id = b.question_id AND a.system < b.system GROUP BY 1, 2, 3""")
def compared_systems(spark, d):
    return runs.compared(_graded(spark, d), by_type=True).select("question_type", "left", "right", "n", F.round("accuracy_left", 6).alias("accuracy_left"), "only_left", "only_right", "low_n")


@query("identity_conflicts", f"WITH {_SYSTEMS} SELECT system, 'reader' AS field, 'disagrees' AS verdict FROM g GROUP BY 1 HAVING count(DISTINCT reader) > 1 UNION ALL SELECT DISTINCT system, 'run', 'intervention' FROM g WHERE system <> 's0' UNION ALL SELECT DISTINCT system, 'sha', 'unverified' FROM g")
def identity_conflicts(spark, d):
    rows = _systems(spark, d).withColumn("run", F.col("system")).withColumn("sha", F.lit(None).cast("string"))
    return runs.identity_conflicts(rows, ["reader", "run", "sha"], ("run",))


@query("config_deltas", "WITH b AS (SELECT n_regionkey AS c, n_nationkey % 2 AS metric, round(avg(n_nationkey), 3) AS value FROM nation GROUP BY 1, 2) SELECT b.c::VARCHAR AS config, b.metric, a.value AS baseline, b.value, round(b.value - a.value, 3) AS delta FROM b JOIN b a ON a.metric = b.metric AND a.c = 0 WHERE b.c <> 0")
def config_deltas(spark, d):
    b = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("config"), (F.col("n_nationkey") % 2).alias("metric")).agg(F.round(F.avg("n_nationkey"), 3).alias("value"))
    return runs.config_deltas(b, "0")


@query("state_accuracy", "SELECT o_orderpriority AS kind, count(*) AS probes, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 3) AS accuracy, round(avg((o_orderkey % 3 <> 0)::INT), 3) AS coverage, round(avg((o_orderkey % 3 <> 0 AND o_orderstatus = 'O')::INT), 3) AS stale_rate FROM orders GROUP BY 1")
def state_accuracy(spark, d):
    o = table(spark, d, "orders")
    probes = o.select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderpriority").alias("kind"), F.lit("F").alias("expected"))
    answers = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderstatus").alias("value"), (F.col("o_orderstatus") == "O").alias("other"))
    return runs.state_accuracy(probes, answers)


@query("guide_violations", "WITH g AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '/p/a' ELSE '/q' END AS namespace, text AS excerpt FROM documents) SELECT namespace, excerpt, 'out of tree' AS violation FROM g WHERE namespace = '/q' UNION ALL SELECT namespace, excerpt, 'leak' FROM g WHERE excerpt IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def guide_violations(spark, d):
    x = table(spark, d, "documents")
    g = x.select(F.when(F.col("doc_id") % 2 == 0, "/p/a").otherwise("/q").alias("namespace"), F.col("text").alias("excerpt"))
    return runs.guide_violations(g, x.where("doc_id % 3 = 0").select(F.col("text").alias("content")), "/p")


_CASES = "k AS (SELECT o_orderkey AS case_id, o_orderstatus AS arm, o_orderpriority AS family, o_orderkey % 4 AS e, o_custkey % 4 AS s, o_orderkey % 7 = 0 AS over, o_orderkey % 50 = 0 AS thin FROM orders), v AS (SELECT *, CASE WHEN thin THEN 'excluded' WHEN e <> s OR over OR s = 3 THEN 'failed' ELSE 'passed' END AS verdict FROM k)"


def _cases(spark, d):
    o, one = table(spark, d, "orders"), lambda c: F.array(F.col(c) % 4)
    over = F.when(F.col("o_orderkey") % 7 == 0, 11).otherwise(10)
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("family"), one("o_orderkey").alias("expected"), one("o_custkey").alias("served"), F.array(F.lit(3).cast("bigint")).alias("forbidden"), over.alias("used"), F.lit(10).alias("budget"), (F.col("o_orderkey") % 50 == 0).alias("insufficient"))


@query("continuity_cases", f"WITH {_CASES} SELECT case_id, verdict FROM v")
def continuity_cases(spark, d):
    return runs.continuity(_cases(spark, d)).select("case_id", "verdict")


@query("continuity_summary", f"WITH {_CASES} SELECT arm, family, count(*) FILTER (verdict = 'passed') AS passed, count(*) FILTER (verdict <> 'excluded') AS scored, count(*) FILTER (verdict = 'excluded') AS excluded FROM v GROUP BY GROUPING SETS ((arm), (arm, family))")
def continuity_summary(spark, d):
    return runs.continuity_summary(runs.continuity(_cases(spark, d))).drop("rate")


@query("overlap_violations", "WITH w AS (SELECT doc_id AS id, list_distinct(string_split(text, ' ')) AS words FROM documents WHERE text IS NOT NULL) SELECT a.id AS query_id, b.id, len(list_intersect(a.words, b.words)) AS shared FROM w a JOIN w b ON b.id = a.id + 1 WHERE len(list_intersect(a.words, b.words)) > 5")
def overlap_violations(spark, d):
    w = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("words"))
    q = w.select(F.col("id").alias("query_id"), F.array(F.col("id") + 1).alias("targets"), "words")
    return runs.overlap_violations(q, w, 5)


@query("replayed_events", "WITH p AS (SELECT n_nationkey AS probe_id, n_nationkey * 2 AS after_seq FROM nation) SELECT probe_id, s.seq FROM p JOIN (SELECT event_id AS seq FROM events WHERE event_id >= 1) s ON s.seq <= after_seq")
def replayed_events(spark, d):
    probes = table(spark, d, "nation").select(F.col("n_nationkey").alias("probe_id"), (F.col("n_nationkey") * 2).alias("after_seq"))
    return runs.replayed(table(spark, d, "events").where("event_id >= 1").select(F.col("event_id").alias("seq")), probes)
