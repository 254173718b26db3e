"""Registered queries of ingest, listings, promotion, credentials and further twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import archive, graph, lifecycle, reports, upkeep, visibility
from recallspark.operators.channels import entity_rows
from recallspark.plans.queries import _M, HIDDEN, _vectors
from recallspark.plans.registry import query
from recallspark.sources.tables import EPOCH, HOUR, NOW, links, memories, sessions, table
from recallspark.streaming import ledgers


@query("ingest_results", """WITH b AS (SELECT doc_id AS position, doc_id AS id, source, CASE WHEN doc_id % 41 = 0 THEN '' ELSE (doc_id % 300)::VARCHAR END AS external_id, coalesce(text, '') = '' AS blank FROM documents),
k AS (SELECT source, (doc_id % 300)::VARCHAR AS external_id, min(doc_id) + 5000000 AS was FROM documents WHERE doc_id < 100 GROUP BY 1, 2), r AS (SELECT b.*, was, external_id = '' OR blank AS bad FROM b LEFT JOIN k USING (source, external_id)),
n AS (SELECT *, row_number() OVER w AS n, first(id) OVER w AS f FROM r WINDOW w AS (PARTITION BY source, external_id, bad ORDER BY position))
SELECT position, CASE WHEN bad THEN 'rejected' WHEN was IS NOT NULL OR n > 1 THEN 'duplicate' ELSE 'ingested' END AS status, CASE WHEN NOT bad THEN coalesce(was, f) END AS id FROM n""")
def ingest_results(spark, d):
    x = table(spark, d, "documents")
    name = (F.col("doc_id") % 300).cast("string")
    batch = x.select(F.col("doc_id").alias("position"), F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 41 == 0, "").otherwise(name).alias("external_id"), F.col("text").alias("content"))
    stored = x.where("doc_id < 100").select("source", name.alias("external_id"), (F.col("doc_id") + 5_000_000).alias("id"))
    return lifecycle.ingest_results(batch, stored, ["source", "external_id"])


@query("listed_by_tag", _M + "SELECT id FROM (SELECT id FROM m ORDER BY created_at DESC, id LIMIT 20) WHERE id % 3 = 1")
def listed_by_tag(spark, d):
    m = memories(spark, d).withColumn("tags", F.array(F.concat(F.lit("T"), (F.col("id") % 3).cast("string"))))
    return lifecycle.listed(m, 20, ["t1"]).select("id")


@query("session_roster", _M + f"SELECT id, CASE WHEN length(content) > 160 THEN substr(content, 1, 160) || '…' ELSE content END AS preview FROM m ORDER BY pinned AND type = 'procedure' DESC, 0.5 * importance + CASE WHEN created_at >= {EPOCH + 900 * HOUR} - 2592000000 THEN 0.5 ELSE 0 END DESC, created_at DESC, id DESC LIMIT 20")
def session_roster(spark, d):
    return lifecycle.roster(memories(spark, d), EPOCH + 900 * HOUR).select("id", "preview")


@query("recent_bursts", _M + f"SELECT namespace, type, count(*) AS family, (max({{'p': importance, 'n': -id}})).n * -1 AS keeper FROM m WHERE created_at >= {EPOCH + 900 * HOUR} - 604800000 AND id NOT IN ({HIDDEN}) GROUP BY namespace, type, substring(content, 1, 48) HAVING count(*) >= 5")
def recent_bursts(spark, d):
    return lifecycle.burst_families(memories(spark, d), EPOCH + 900 * HOUR, hidden=visibility.superseded_ids(links(spark, d)))


@query("promoted_leaves", _M + """, r AS (SELECT namespace, id, content, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS n, count(*) OVER (PARTITION BY namespace) AS rows FROM m WHERE contains(namespace, '//'))
SELECT namespace, max(rows) AS rows, string_agg(id::VARCHAR, ',' ORDER BY n) FILTER (n <= 10) AS promoted_from FROM r WHERE rows >= 8 GROUP BY namespace""")
def promoted_leaves(spark, d):
    m = memories(spark, d)
    out = lifecycle.promotion(m, nodes=reports.namespace_nodes(m))
    return out.select("namespace", "rows", F.array_join(F.transform("promoted_from", lambda x: x.cast("string")), ",").alias("promoted_from"))


@query("backfilled_rows", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '/n' ELSE '/p' END AS namespace, CASE WHEN event_id % 3 = 0 THEN 'kept' ELSE event_type || ' is v ' || event_type || ' is v' END AS ident_text FROM events")
def backfilled_rows(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(i.alias("id"), F.when(i % 2 == 0, "/n").alias("namespace"), F.lit("/p").alias("project_path"), F.when(i % 3 == 0, "kept").alias("ident_text"), F.concat("event_type", F.lit(" is v")).alias("content"))
    return lifecycle.backfilled(e).select("id", "namespace", "ident_text")


@query("cross_owner_reads", _M + "SELECT 'u1' AS reader, id, owner FROM m WHERE id % 5 = 0 AND owner <> 'u1'")
def cross_owner_reads(spark, d):
    m = memories(spark, d)
    reads = m.where("id % 5 = 0").select(F.lit("u1").alias("reader"), "id", F.lit(NOW).alias("at"))
    return lifecycle.cross_owner_reads(reads, m).select("reader", "id", "owner")


@query("resolved_credentials", "SELECT 'secret ' || n_name AS token, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 THEN 'p' || n_nationkey END AS principal, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 AND n_nationkey % 2 = 0 THEN '/a,/b' ELSE '' END AS prefixes FROM nation")
def resolved_credentials(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    token, who = F.concat(F.lit("secret "), "n_name"), F.concat(F.lit("p"), k.cast("string"))
    stored = n.select(who.alias("principal"), F.sha2(token, 256).alias("token_hash"), F.when(k % 3 == 0, 1).alias("revoked_at"), F.when(k % 4 == 0, 5).otherwise(50).alias("expires_at"))
    grants = n.where("n_nationkey % 2 = 0").select(who.alias("principal"), F.explode(F.array(F.lit("/b"), F.lit("/a"))).alias("prefix"), F.lit("read").alias("verb"))
    return lifecycle.resolved_credentials(n.select(token.alias("token")), stored, grants, 10).select("token", "principal", F.array_join("prefixes", ",").alias("prefixes"))


@query("first_within_ttl", "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def first_within_ttl(spark, d):
    out = ledgers.first_within(table(spark, d, "events"), ["user_id", "event_type"], "1 day")
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("node_reach", _M.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT source_id AS a, target_id AS b, link_type FROM l UNION ALL SELECT target_id, source_id, link_type FROM l),
w(id, hops) AS (SELECT 50::BIGINT, 0 UNION SELECT e.b, hops + 1 FROM w JOIN e ON e.a = w.id WHERE hops < 3), f AS (SELECT id, min(hops) AS hops FROM w GROUP BY id), r AS (SELECT f.id, f.hops, e.link_type, e.a AS source_id, row_number() OVER (PARTITION BY f.id ORDER BY e.link_type, e.a) AS n FROM f JOIN e ON e.b = f.id JOIN f g ON g.id = e.a AND g.hops = f.hops - 1 WHERE f.hops > 0)
SELECT id, hops, link_type, source_id FROM r WHERE n = 1""")
def node_reach(spark, d):
    return graph.reach(links(spark, d), memories(spark, d).where("id = 50"))



@query("restored_rows", _M + """, h AS (SELECT source_id, target_id FROM l WHERE link_type = 'supersedes' AND source_id % 8 = 0), a AS (SELECT m.*, CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'failed' END AS st, id IN (SELECT target_id FROM h) AS t, id IN (SELECT source_id FROM h UNION SELECT target_id FROM h) AS e FROM m)
SELECT id, CASE WHEN NOT t THEN valid_until END AS valid_until, CASE WHEN NOT t THEN archived_at END AS archived_at, CASE WHEN e AND st IN ('done', 'pending') THEN 'skipped' ELSE st END AS adjudication_state FROM a""")
def restored_rows(spark, d):
    i = F.col("id")
    m = memories(spark, d).withColumn("adjudication_state", F.when(i % 3 == 0, "done").when(i % 3 == 1, "pending").otherwise("failed"))
    x = links(spark, d)
    return reports.restored(m, x, x.where("source_id % 8 = 0")).select("id", "valid_until", "archived_at", "adjudication_state")


@query("retrieval_events", "SELECT user_id, count(*) AS result_count, least(count(*), 50) AS kept, 2500 AS query_chars, 2000 AS stored_chars FROM events GROUP BY user_id")
def retrieval_events(spark, d):
    calls = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("result_ids")).select(F.col("user_id").cast("string").alias("tool"), F.repeat(F.lit("x"), F.lit(2500)).alias("query"), "result_ids", F.lit(1.4).alias("latency_ms"), F.lit(NOW).alias("created_at"))
    out = reports.retrieval_events(calls)
    return out.select(F.col("tool").cast("long").alias("user_id"), F.col("result_count").cast("long").alias("result_count"), F.size("result_ids").cast("long").alias("kept"), "query_chars", F.length("query").alias("stored_chars"))


@query("pruned_ledger", f"SELECT event_id AS id FROM events WHERE event_id * {HOUR} >= {4000 * HOUR - 90 * 86_400_000} ORDER BY event_id DESC LIMIT 3000")
def pruned_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * HOUR).alias("ts"))
    return reports.pruned_ledger(e, 4000 * HOUR, cap=3000).select("id")


@query("snapshot_tables", _M + f""", s AS (SELECT id, session_id FROM m WHERE id % 3 = 0 AND type IN ('fact', 'note') AND archived_at IS NULL AND id NOT IN ({HIDDEN})) SELECT 'memories' AS name, count(*) AS n FROM s
UNION ALL SELECT 'links', count(*) FROM l WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM s) UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id IN (SELECT session_id FROM s)""")
def snapshot_tables(spark, d):
    m = memories(spark, d).withColumn("shareable", F.col("id") % 3 == 0)
    tables = archive.snapshot(m, links(spark, d), entity_rows(m.limit(0)), _vectors(spark, d), sessions(spark, d), ["fact", "note"])
    rows = archive.manifest({k: tables[k] for k in ("memories", "links", "embeddings", "sessions")}, 1, "m", 64, NOW)["rows"]
    return spark.createDataFrame(list(rows.items()), "name string, n long")


@query("applied_items", "SELECT source, doc_id AS item_id FROM documents WHERE doc_id % 6 <> 0 AND NOT (source = 'src1' AND doc_id % 10 <= 4)")
def applied_items(spark, d):
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("item_id"), (F.col("doc_id") % 10).alias("generation"))
    barriers = spark.createDataFrame([("src1", 2), ("src1", 4)], "source string, generation long")
    return upkeep.forgotten(x, x.where("item_id % 6 = 0"), barriers).select("source", "item_id")
