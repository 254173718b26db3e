"""Registered queries of reports and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import components, reports, visibility
from recallspark.plans.queries import WITH
from recallspark.plans.registry import query
from recallspark.sources.tables import links, memories, table

_M = WITH.rstrip()
_CHAIN = "['/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1), namespace]"


@query("namespace_nodes", f"""{_M}, a AS (SELECT DISTINCT {_CHAIN} AS c FROM m), s AS (SELECT DISTINCT c[i] AS path, CASE WHEN i > 1 THEN c[i - 1] END AS parent_path, i AS depth FROM a, (SELECT unnest([1, 2, 3]) AS i)),
o AS (SELECT namespace AS path, count(*) AS n, max(created_at) AS last FROM m GROUP BY 1), k AS (SELECT parent_path AS path, count(*) AS n FROM s WHERE parent_path IS NOT NULL GROUP BY 1)
SELECT path, parent_path, depth, contains(path, '//') AS is_synthetic, coalesce(o.n, 0) AS memory_count, coalesce(k.n, 0) AS child_count, last AS last_activity FROM s LEFT JOIN o USING (path) LEFT JOIN k USING (path)""")
def namespace_nodes(spark, d):
    return reports.namespace_nodes(memories(spark, d))


@query("explain_miss", f"""{_M}, h AS (SELECT unnest({_CHAIN}) AS path FROM m), c AS (SELECT path, depth, (SELECT count(*) FROM h WHERE h.path = x.path) AS rows FROM (VALUES ('/p', 1), ('/p/en', 2), ('/p/en//nowhere', 3)) x(path, depth))
SELECT path, depth, rows, depth = (SELECT max(depth) FROM c WHERE rows >= 3) AS is_nearest FROM c""")
def explain_miss(spark, d):
    return reports.explain_miss(memories(spark, d), "/p/en//nowhere")


def _actions(spark, d):
    action = F.when(F.col("event_type") == "purchase", "fault").when(F.col("event_id") % 2 == 0, "archived").otherwise("pruned")
    return table(spark, d, "events").select(action.alias("action"), F.col("event_type").alias("reason"), "event_id")


_ACTIONS = "WITH e AS (SELECT CASE WHEN event_type = 'purchase' THEN 'fault' WHEN event_id % 2 = 0 THEN 'archived' ELSE 'pruned' END AS action, event_type AS reason, event_id FROM events) "


@query("eviction_summary", _ACTIONS + "SELECT action, reason, count(*) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, reason, action LIMIT 20")
def eviction_summary(spark, d):
    return reports.eviction_summary(_actions(spark, d))


@query("fault_rate", _ACTIONS + "SELECT count(*) FILTER (action = 'fault') AS faults, count(*) FILTER (action <> 'fault') AS removed, round(count(*) FILTER (action = 'fault') / count(*) FILTER (action <> 'fault'), 4) AS fault_rate FROM e")
def fault_rate(spark, d):
    return reports.fault_rate(_actions(spark, d))


@query("ledger_cap", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def ledger_cap(spark, d):
    return reports.newest(table(spark, d, "events").select("event_id"), "event_id", 1000)


@query("fully_visible", "SELECT l_suppkey::VARCHAR AS namespace FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N')")
def fully_visible(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("namespace"), F.col("l_returnflag").alias("owner"))
    return reports.fully_visible(rows, "N")


@query("reversed_links", _M + " SELECT source_id, target_id, link_type FROM l WHERE NOT (link_type = 'supersedes' AND source_id % 8 = 0)")
def reversed_links(spark, d):
    x = links(spark, d)
    return reports.reversed_links(x, x.where("source_id % 8 = 0").select("source_id", "target_id")).select("source_id", "target_id", "link_type")


@query("patched_rows", _M + ", p AS (SELECT doc_id % 100 AS id, arg_max(n_chars / 1000.0::DOUBLE, doc_id) AS importance FROM documents WHERE doc_id >= 100 GROUP BY 1) SELECT m.id, round(coalesce(p.importance, m.importance), 6) AS importance FROM m LEFT JOIN p ON m.id = p.id")
def patched_rows(spark, d):
    p = table(spark, d, "documents").where("doc_id >= 100").select((F.col("doc_id") % 100).alias("id"), F.col("doc_id").alias("seq"), (F.col("n_chars") / 1000.0).alias("importance"))
    return reports.patched(memories(spark, d), p).select("id", F.round("importance", 6).alias("importance"))


@query("leak_rates", _M + " SELECT session_id AS query_id, round(avg((NOT starts_with(namespace, '/p/en/'))::INT), 6) AS leak_rate, round(avg((archived_at IS NOT NULL)::INT), 6) AS stale_rate FROM m GROUP BY 1")
def leak_rates(spark, d):
    ranked = memories(spark, d).withColumnRenamed("session_id", "query_id")
    out = reports.leak_rates(ranked, visibility.in_scope(F.col("namespace"), "/p/en"), F.col("archived_at").isNotNull())
    return out.select("query_id", F.round("leak_rate", 6).alias("leak_rate"), F.round("stale_rate", 6).alias("stale_rate"))


@query("newest_fact", "SELECT event_id AS serial, props AS fact FROM events WHERE contains(lower(props), '77') OR contains(lower(props), '41') ORDER BY event_id DESC LIMIT 1")
def newest_fact(spark, d):
    return reports.newest_fact(table(spark, d, "events").select(F.col("event_id").alias("serial"), F.col("props").alias("fact")), ["77", "41"])


@query("gated_metrics", "WITH v AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1), b AS (SELECT DISTINCT event_type AS metric, 50.0::DOUBLE AS bound, event_type < 'l' AS low FROM events) SELECT metric, value, bound, CASE WHEN low THEN value <= bound ELSE value >= bound END AS passed FROM b JOIN v USING (metric)")
def gated_metrics(spark, d):
    e = table(spark, d, "events")
    v = e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    b = e.select(F.col("event_type").alias("metric"), F.lit(50.0).alias("bound"), (F.col("event_type") < "l").alias("lower_is_better")).distinct()
    return reports.gated(v, b)


@query("excerpts", _M + ", p AS (SELECT id, content, coalesce(least(nullif(instr(lower(content), 'ention'), 0), nullif(instr(lower(content), 'ould'), 0)), 1) AS pos FROM m) SELECT id, substring(content, greatest(1, pos - 120), 240) AS excerpt FROM p")
def excerpts(spark, d):
    return memories(spark, d).select("id", reports.excerpt(F.col("content"), ["ention", "ould"]).alias("excerpt"))


@query("raw_rank", _M + ", s AS (SELECT id, (length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 + (length(lower(content)) - length(replace(lower(content), 'an', ''))) // 2 AS score FROM m) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def raw_rank(spark, d):
    return reports.raw_rank(memories(spark, d).select("id", F.col("content").alias("text")), ["the", "an"], 50)


@query("clusters_visible", "WITH c AS (SELECT o_custkey AS cluster_id, bool_and(o_orderkey % 5 <> 0) AS ok FROM orders GROUP BY 1) SELECT cluster_id FROM c WHERE ok")
def clusters_visible(spark, d):
    o = table(spark, d, "orders")
    c = o.groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.collect_list("o_orderkey").alias("member_ids"))
    return reports.clusters_visible(c, o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"))).select("cluster_id")


@query("assertions", _M + " SELECT event_id AS memory_id, user_id AS subject, props AS value FROM events WHERE event_type = 'click' AND event_id IN (SELECT id FROM m WHERE type = 'fact') ORDER BY ts DESC, event_id LIMIT 50")
def assertions(spark, d):
    facts = table(spark, d, "events").select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("value"), F.col("ts").alias("observed_at"))
    return reports.assertions(facts, memories(spark, d).where("type = 'fact'"), "click").select("memory_id", "subject", "value")


@query("chain_keys", _M.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT source_id AS a, target_id AS b FROM l WHERE link_type = 'supersedes'), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, r) AS (SELECT a, a FROM b UNION SELECT b.b, w.r FROM w JOIN b ON b.a = w.id), c AS (SELECT id, min(r) AS component FROM w GROUP BY id),
h AS (SELECT component, arg_min(m.id, m.created_at) AS oldest FROM c JOIN m USING (id) GROUP BY 1 HAVING bool_and(state_key IS NULL)) SELECT c.id, concat('chain:', oldest) AS chain_key FROM c JOIN h USING (component)""")
def chain_keys(spark, d):
    e = links(spark, d).where("link_type = 'supersedes'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return reports.chain_keys(components.connected_components(e), memories(spark, d))


#: Props of events in several spellings, some with other keys or as text.
_SPELLED = """CASE event_id % 4 WHEN 0 THEN '{"k": ' || (event_id % 7) || ', "of": [true, null]}' WHEN 1 THEN ' { "of" : [ true , null ], "k" : ' || (event_id % 7) || '.0 }' WHEN 2 THEN '{"k": "' || (event_id % 7) || '", "of": [true, null]}' ELSE 'k=' || (event_id % 7) END"""


@query("same_assertions", """WITH f AS (SELECT event_id, user_id % 20 AS subject, event_type, ts, event_id % 7 AS k, event_id % 4 = 2 AS quoted FROM events WHERE event_id % 4 <> 3)
SELECT event_id AS memory_id, first_value(event_id) OVER (w ORDER BY ts, event_id) AS first_id, count(*) OVER (w) AS n FROM f WINDOW w AS (PARTITION BY subject, event_type, k, quoted)""")
def same_assertions(spark, d):
    facts = table(spark, d, "events").select(F.col("event_id").alias("memory_id"), (F.col("user_id") % 20).alias("subject"), F.col("event_type").alias("predicate"), F.expr(_SPELLED).alias("value"), F.col("ts").alias("observed_at"))
    return reports.same_assertions(facts)


@query("assertions_of_value", _M + """ SELECT event_id AS memory_id FROM events WHERE event_type = 'click' AND event_id % 4 < 2 AND event_id % 7 = 3 AND event_id IN (SELECT id FROM m) ORDER BY ts DESC, event_id LIMIT 50""")
def assertions_of_value(spark, d):
    facts = table(spark, d, "events").select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.expr(_SPELLED).alias("value"), F.col("ts").alias("observed_at"))
    return reports.assertions(facts, memories(spark, d), "click", '{"of": [true, null], "k": 3e0}').select("memory_id")
