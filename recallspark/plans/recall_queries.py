"""Registered queries of served contexts, digests, health and ledgers' summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions.text import ancestors
from recallspark.operators import digests, recall, reports, retrieval, visibility
from recallspark.plans.queries import _DISTANCE, _LEX, _M, _QUERY_VECTOR, HIDDEN, TERMS, _english, _vectors
from recallspark.plans.registry import query
from recallspark.sources.tables import EPOCH, HOUR, NOW, links, memories, table

_TRUST = f"0.5 * importance + 0.3 * least(ln(access_count + 1) / ln(100), 1) + 0.2 * exp(-greatest(({NOW} - created_at) / 86400000.0::DOUBLE, 0) / (30 * greatest(importance + 0.3 * ln(access_count + 1), 0.1)))"


def _ranked(spark, d):
    """Memories as ranked candidates of queries: by id within each remainder of ten."""
    m = memories(spark, d).withColumn("query_id", F.col("id") % 10)
    return m.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).cast("int")).where("place <= 40")


_RANKED = "r AS (SELECT * FROM (SELECT *, id % 10 AS query_id, row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS place FROM m) WHERE place <= 40)"


@query("trusted_candidates", f"{_M}, {_RANKED} SELECT query_id, id FROM r WHERE pinned OR {_TRUST} >= 0.4")
def trusted_candidates(spark, d):
    return recall.trusted(_ranked(spark, d), NOW, 0.4).select("query_id", "id")


@query("first_candidates", f"{_M}, {_RANKED} SELECT query_id, id, place FROM r")
def first_candidates(spark, d):
    r = _ranked(spark, d).select("query_id", "id", "place")
    return recall.first_of_each(r.union(r.withColumn("place", F.col("place") + 100)))


@query("without_near_duplicates", f"""{_M.replace("WITH", "WITH RECURSIVE", 1)}, {_RANKED}, p AS (SELECT id, query_id, place FROM (SELECT id, id // 25 AS query_id, row_number() OVER (PARTITION BY id // 25 ORDER BY id) AS place FROM m)),
e AS (SELECT source_id AS a, target_id AS b FROM l WHERE similarity >= 0.95 UNION SELECT target_id, source_id FROM l WHERE similarity >= 0.95),
k(query_id, place, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM p UNION ALL SELECT k.query_id, p.place, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.a = p.id AND list_contains(k.kept, e.b)) THEN k.kept ELSE list_append(k.kept, p.id) END FROM k JOIN p ON p.query_id = k.query_id AND p.place = k.place + 1)
SELECT query_id, unnest(kept) AS id FROM (SELECT query_id, kept, place, max(place) OVER (PARTITION BY query_id) AS top FROM k) WHERE place = top""")
def without_near_duplicates(spark, d):
    m = memories(spark, d).select("id", F.floor(F.col("id") / 25).alias("query_id"))
    r = m.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return recall.without_near_duplicates(r, links(spark, d)).select("query_id", "id")


@query("enriched_rows", f"""{_M}, t AS (SELECT id, pinned, {_TRUST} AS t FROM m) SELECT id, CASE WHEN pinned THEN 'pinned' WHEN t >= 0.7 THEN 'hot' WHEN t >= 0.3 THEN 'warm' ELSE 'cold' END AS tier,
  (SELECT count(*) FROM l WHERE source_id = t.id AND link_type = 'supersedes' AND confidence >= 0.8) AS supersedes, (SELECT count(*) FROM l WHERE target_id = t.id AND link_type = 'supersedes' AND confidence >= 0.8) AS superseded_by,
  (SELECT count(*) FROM l WHERE (source_id = t.id OR target_id = t.id) AND link_type = 'conflicts') AS conflicts FROM t""")
def enriched_rows(spark, d):
    return recall.with_counts(memories(spark, d), links(spark, d), NOW).select("id", "tier", "supersedes", "superseded_by", "conflicts")


@query("access_events", f"{_M} SELECT id, {NOW} AS at, 1 AS uses FROM m WHERE id % 9 = 0")
def access_events(spark, d):
    hits = memories(spark, d).where("id % 9 = 0").select("id")
    return recall.stamped(hits, NOW, mode="retrieval").union(recall.stamped(hits, NOW, mode="off", touch=True)).union(recall.stamped(hits, NOW, mode="explicit"))


_FOLD = """{name}(query_id, n, remaining, kept, chars) AS (SELECT query_id, 0::BIGINT, {room}, 0::BIGINT, 0::BIGINT FROM {start} UNION ALL SELECT f.query_id, i.n, CASE WHEN c <= remaining THEN remaining - c WHEN {cut} THEN 0 ELSE remaining END,
 kept + CASE WHEN c <= remaining OR {cut} THEN 1 ELSE 0 END, chars + CASE WHEN c <= remaining THEN c WHEN {cut} THEN remaining ELSE 0 END FROM {name} f JOIN {items} i ON i.query_id = f.query_id AND i.n = f.n + 1)"""
_LAST = "(SELECT query_id, remaining, kept FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS z FROM {0}) WHERE z = 1)"


@query("recall_pack", f"""WITH RECURSIVE mi AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text)::BIGINT AS c FROM conversations),
ti AS (SELECT query_id, n, c // 4 AS c FROM mi), b AS (SELECT DISTINCT conv_id AS query_id, (400 + conv_id % 30 * 100)::BIGINT AS budget, (conv_id % 500)::BIGINT AS d FROM conversations),
s AS (SELECT *, least(d, floor(budget * CASE WHEN budget <= 1000 THEN 0.1 WHEN budget >= 4000 THEN 0.4 ELSE 0.1 + 0.3 * (budget - 1000) / 3000 END)) AS reserve FROM b), g AS (SELECT query_id, budget, CAST(CASE WHEN d > reserve THEN reserve + 1 ELSE d END AS BIGINT) AS digest_chars FROM s),
{_FOLD.format(name="fm", room="budget - digest_chars", start="g", cut="remaining > 16", items="mi")}, gm AS (SELECT * FROM {_LAST.format("fm")}), {_FOLD.format(name="ft", room="remaining", start="gm", cut="(remaining - 1 >= 24 AND c > 0)", items="ti")}
SELECT g.query_id, g.digest_chars, gm.kept AS memories, t.kept AS topics, budget - t.remaining AS used FROM g JOIN gm USING (query_id) JOIN {_LAST.format("ft")} t USING (query_id)""")
def recall_pack(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("place"), F.length("text").alias("chars"))
    b = c.select("query_id").distinct().select("query_id", (400 + F.col("query_id") % 30 * 100).cast("int").alias("budget"), F.repeat(F.lit("x"), (F.col("query_id") % 500).cast("int")).alias("digest"))
    out = recall.packed(b, c, c.withColumn("chars", F.floor(F.col("chars") / 4)))
    return out.select("query_id", "digest_chars", F.size("memories").alias("memories"), F.size("topics").alias("topics"), "used")


def _items(spark, d):
    c = table(spark, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    kind = F.when(F.col("turn") % 3 == 0, "evidence").when(F.col("turn") % 3 == 1, "memories").otherwise("summaries")
    return c.select(F.col("conv_id").alias("query_id"), kind.alias("kind"), "place", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("chars"))


@query("assembled_sections")
def assembled_sections(spark, d):
    return recall.assembled(_items(spark, d), 1500, "qa")


@query("funnel_trace", f"""{_M}, h AS (SELECT importance AS score FROM m WHERE namespace = '/p/en//src1'), c AS (SELECT count(*) >= 3 AND max(score) >= 0.35 AS rich FROM h)
SELECT path AS namespace, depth, CASE WHEN NOT readable THEN 'withheld' WHEN rich THEN 'skipped' ELSE 'guide_only' END AS action FROM (VALUES ('/p', 1, true), ('/p/en', 2, false)) x(path, depth, readable), c""")
def funnel_trace(spark, d):
    h = memories(spark, d).where("namespace = '/p/en//src1'").select("namespace", F.col("importance").alias("score"))
    a = spark.createDataFrame([("/p", 1, True), ("/p/en", 2, False)], "path string, depth int, readable boolean")
    return recall.funnel(h, a)


@query("guide_excerpts", f"""{_M}, s AS (SELECT namespace, id AS place, content AS text, list_min(list_filter([instr(lower(content), 'the'), instr(lower(content), 'ment')], lambda x: x > 0)) AS pos FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY place) AS n FROM s WHERE pos IS NOT NULL) SELECT namespace, 'cluster' AS kind, substr(text, greatest(pos - 120, 1), 240) AS excerpt FROM r WHERE n <= 2""")
def guide_excerpts(spark, d):
    s = memories(spark, d).select("namespace", F.lit("cluster").alias("kind"), F.col("id").alias("place"), F.col("content").alias("text"))
    return recall.guide_excerpts(s, ["the", "ment"])


@query("cue_hits", f"{_M}, a AS (SELECT id, CASE WHEN id % 6 = 0 THEN 1 ELSE 2 END AS k FROM m WHERE id % 2 = 0) SELECT m.id, type, CASE WHEN k = 1 THEN 'src/a.py' ELSE 'a.py' END AS matched FROM a JOIN m USING (id) WHERE type IN ('decision', 'gotcha', 'pattern', 'procedure') AND archived_at IS NULL ORDER BY k, m.id LIMIT 3")
def cue_hits(spark, d):
    names = recall.cue_identifiers("/repo/src/a.py", "/repo")[1:]
    m = memories(spark, d)
    lists = [(n, m.where(f"id % {k} = 0").select("id", F.col("id").alias("place"))) for n, k in zip(names, (6, 2))]
    return recall.cue(lists, m)


@query("archive_rank", f"{_M} SELECT id, round(0.001 * (id % 100) + 0.35 * importance + CASE WHEN type = 'gotcha' OR type = 'procedure' THEN 0.25 ELSE 0 END + CASE WHEN pinned THEN 0.25 ELSE 0 END, 6) AS strength FROM m ORDER BY strength DESC, created_at DESC, id LIMIT 30")
def archive_rank(spark, d):
    m = memories(spark, d).withColumn("bm25", (F.col("id") % 100) * 0.001)
    return recall.archive_rank(m, 30).select("id", F.round("strength", 6).alias("strength"))


@query("archive_search", f"{_M}, v AS (SELECT vec_id AS id, {_DISTANCE} AS d FROM embeddings) SELECT id FROM m WHERE id NOT IN ({HIDDEN}) AND id IN (SELECT id FROM v WHERE 1 - d * d / 2 >= -20 ORDER BY d, id LIMIT 10)")
def archive_search(spark, d):
    m = memories(spark, d)
    none = m.select("id", F.lit(1.0).alias("bm25")).limit(0)
    return recall.archive_search(m, none, retrieval.nearest(_vectors(spark, d), _QUERY_VECTOR, 40), visibility.superseded_ids(links(spark, d)), least_cosine=-20.0)


_LINES = "p AS (SELECT namespace, list('- [' || type || '] ' || content ORDER BY created_at, id) AS l FROM m WHERE pinned GROUP BY 1)"
_KEEP = "list_reduce(list_prepend({'used': 0, 'kept': 0, 'full': false}, list_transform(l, lambda x: {'used': length(x), 'kept': 0, 'full': false})), lambda a, x: CASE WHEN a.full OR a.used + x.used + CASE WHEN a.kept > 0 THEN 1 ELSE 0 END > 2000 - length(chr(10) || '…(' || len(l) || ' more)') THEN {'used': a.used, 'kept': a.kept, 'full': true} ELSE {'used': a.used + x.used + CASE WHEN a.kept > 0 THEN 1 ELSE 0 END, 'kept': a.kept + 1, 'full': false} END).kept"


@query("scope_digests", f"{_M}, {_LINES}, q AS (SELECT namespace, l, array_to_string(l, chr(10)) AS w, {_KEEP} AS k FROM p) SELECT namespace, CASE WHEN length(w) <= 2000 THEN w ELSE substr(array_to_string(l[1:k], chr(10)) || chr(10) || '…(' || (len(l) - k) || ' more)', 1, 2000) END AS content FROM q")
def scope_digests(spark, d):
    return digests.digests(memories(spark, d)).select("namespace", "content")


@query("changed_digests", f"{_M} SELECT DISTINCT namespace FROM m WHERE pinned AND namespace NOT LIKE '/p/en/%'")
def changed_digests(spark, d):
    fresh = digests.digests(memories(spark, d))
    return digests.changed(fresh, fresh.where("namespace LIKE '/p/en/%'")).select("namespace")


_NAV_KEEP = _KEEP.replace("2000", "1200")


@query("nav_digests", f"""{_M}, n AS (SELECT DISTINCT unnest([regexp_extract(namespace, '^(/p/[a-z]+)', 1), namespace]) AS path, unnest(['/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1)]) AS parent FROM m), c AS (SELECT n.*, (SELECT count(*) FROM m WHERE namespace = n.path) AS k FROM n),
x AS (SELECT namespace AS path, 0 AS kind, row_number() OVER (PARTITION BY namespace ORDER BY created_at, id) AS n, '- [' || type || '] ' || substring(trim(string_split(regexp_replace(content, '[.!?]', chr(1), 'g'), chr(1))[1], ' '), 1, 120) AS line FROM m WHERE pinned
UNION ALL SELECT * FROM (SELECT namespace, 1, row_number() OVER (PARTITION BY namespace ORDER BY id) AS n, '[topic] ' || trim(substring(content, 1, 60), ' ') FROM m WHERE id % 17 = 0) WHERE n <= 5
UNION ALL SELECT * FROM (SELECT parent, 3, row_number() OVER (PARTITION BY parent ORDER BY k DESC, path) AS n, '[child] ' || path || ' (' || k || ')' FROM c) WHERE n <= 8),
q AS (SELECT path, l, array_to_string(l, chr(10)) AS w, {_NAV_KEEP} AS k FROM (SELECT path, list(line ORDER BY kind, n) AS l FROM x GROUP BY path)) SELECT path, CASE WHEN length(w) <= 1200 THEN w ELSE substr(array_to_string(l[1:k], chr(10)) || chr(10) || '…(' || (len(l) - k) || ' more)', 1, 1200) END AS digest FROM q""")
def nav_digests(spark, d):
    m = memories(spark, d)
    topics = m.where("id % 17 = 0").select("namespace", F.col("id").alias("place"), F.substring("content", 1, 60).alias("summary"))
    return digests.nav_digests(m, topics, reports.namespace_nodes(m))


@query("upserted_clusters", f"{_M}, f AS (SELECT namespace AS key, id AS x FROM m), s AS (SELECT id % 40 AS old, id AS x FROM m WHERE id % 3 = 0) SELECT key, (SELECT min(old) FROM s JOIN f g ON g.x = s.x WHERE g.key = f.key) AS id, count(*) AS members FROM f GROUP BY key")
def upserted_clusters(spark, d):
    m = memories(spark, d)
    found = m.groupBy(F.col("namespace").alias("key")).agg(F.collect_list("id").alias("member_ids"))
    stored = m.where("id % 3 = 0").groupBy((F.col("id") % 40).alias("k")).agg(F.collect_list("id").alias("member_ids")).withColumnRenamed("k", "id")
    return digests.upserted_clusters(found, stored).select("key", "id", F.size("member_ids").alias("members"))


@query("retrieval_summary", "SELECT count(*) AS logged, count(*) FILTER (event_id % 5 = 0) AS empty, count(*) FILTER (event_type = 'error') AS weak, round(avg(value), 1) AS avg_latency_ms, round(avg(event_id % 7), 1) AS avg_dropped, count(*) FILTER (event_id % 2 = 0) AS queries_logged FROM events")
def retrieval_summary(spark, d):
    e = table(spark, d, "events")
    rows = e.select((F.col("event_id") % 5).alias("result_count"), (F.col("event_type") == "error").alias("weak"), F.col("value").alias("latency_ms"), (F.col("event_id") % 7).alias("dropped"), F.when(F.col("event_id") % 2 == 0, "q").alias("query"))
    return digests.retrieval_summary(rows)


@query("scope_health", f"""{_M}, n AS (SELECT namespace AS path, count(*) AS memory_count FROM m GROUP BY 1), g AS (SELECT namespace AS path, CASE WHEN max(id) % 2 = 0 THEN max(created_at) ELSE max(created_at) // 1000 END AS u FROM m WHERE pinned GROUP BY 1)
SELECT path, memory_count, memory_count < 3 AS thin, u IS NULL AS missing_digest, coalesce({EPOCH + 1200 * HOUR} - CASE WHEN u < 1000000000000 THEN u * 1000 ELSE u END > 604800000, false) AS stale_digest FROM n LEFT JOIN g USING (path)""")
def scope_health(spark, d):
    m = memories(spark, d)
    last = F.max("created_at")
    dg = m.where("pinned").groupBy("namespace").agg(F.when(F.max("id") % 2 == 0, last).otherwise(F.floor(last / 1000)).alias("updated_at")).withColumn("content", F.lit("x"))
    nodes = m.groupBy(F.col("namespace").alias("path")).agg(F.count(F.lit(1)).alias("memory_count"))
    return digests.health(nodes, dg, EPOCH + 1200 * HOUR)


@query("job_status", "SELECT o_orderstatus AS status, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY 1, 2")
def job_status(spark, d):
    return digests.job_status(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type")))


@query("outbox_status", """WITH r AS (SELECT event_type AS op, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'queued' ELSE 'dead' END AS state, event_id AS created_at, CASE WHEN event_id % 11 = 0 THEN 'e' || event_id END AS error FROM events)
SELECT op, state, n, oldest_unfinished, last_error FROM (SELECT op, state, count(*) AS n FROM r GROUP BY 1, 2) JOIN (SELECT op, min(created_at) FILTER (state NOT IN ('done', 'dead')) AS oldest_unfinished, max_by(error, created_at) FILTER (error IS NOT NULL) AS last_error FROM r GROUP BY 1) USING (op)""")
def outbox_status(spark, d):
    i = F.col("event_id")
    state = F.when(i % 3 == 0, "done").when(i % 3 == 1, "queued").otherwise("dead")
    return digests.outbox_status(table(spark, d, "events").select(i.alias("id"), F.col("event_type").alias("op"), state.alias("state"), i.alias("created_at"), i.alias("updated_at"), F.when(i % 11 == 0, F.concat(F.lit("e"), i.cast("string"))).alias("error")))


@query("slot_keys", f"{_M} SELECT namespace, state_key FROM (SELECT namespace, state_key, row_number() OVER (PARTITION BY namespace ORDER BY max(valid_from) DESC, state_key) AS n FROM m WHERE state_key IS NOT NULL GROUP BY 1, 2) WHERE n <= 5")
def slot_keys(spark, d):
    return digests.slot_keys(memories(spark, d), 5).select("namespace", "state_key")


@query("child_roster", f"{_M}, c AS (SELECT namespace AS path, regexp_extract(namespace, '^(/p/[a-z]+)', 1) AS parent_path, count(*) AS memory_count FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY memory_count DESC, path) AS n FROM c) SELECT parent_path, path, memory_count FROM r WHERE n <= 12")
def child_roster(spark, d):
    return digests.child_roster(reports.namespace_nodes(memories(spark, d)).where("depth = 3")).select("parent_path", "path", "memory_count")


@query("evicted_vectors", "SELECT vec_id AS key FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id % 50 DESC, vec_id DESC) AS n FROM embeddings) WHERE n > 100")
def evicted_vectors(spark, d):
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") % 50).alias("last_used_at"), F.col("vec_id").alias("created_at"))
    return digests.evicted_vectors(c, 100)


@query("cached_vectors", "SELECT sha256('m' || chr(0) || text) AS key, doc_id % 2 = 0 AS hit FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def cached_vectors(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    cache = docs.where("doc_id % 2 = 0").select(F.sha2(F.concat_ws("\0", F.lit("m"), "text"), 256).alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    return digests.cached_vectors(docs, cache, "m").select("key", F.col("embedding").isNotNull().alias("hit"))


@query("distinct_scopes", f"{_M} SELECT 'owners' AS name, count(DISTINCT owner) AS n FROM m UNION ALL SELECT 'namespaces', count(DISTINCT namespace) FROM m UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM m")
def distinct_scopes(spark, d):
    row = memories(spark, d).agg(F.count_distinct("owner").alias("owners"), F.count_distinct("namespace").alias("namespaces"), F.count_distinct("session_id").alias("sessions"))
    return row.unpivot([], ["owners", "namespaces", "sessions"], "name", "n")


@query("recall_channel", f"""{_M.replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT id, id // 25 AS query_id, row_number() OVER (PARTITION BY id // 25 ORDER BY id) AS place FROM m WHERE (visibility IS NULL OR visibility <> 'personal' OR owner = 'u1') AND (pinned OR {_TRUST} >= 0.3)),
e AS (SELECT source_id AS a, target_id AS b FROM l WHERE similarity >= 0.95 UNION SELECT target_id, source_id FROM l WHERE similarity >= 0.95),
k(query_id, place, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM p UNION ALL SELECT k.query_id, p.place, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.a = p.id AND list_contains(k.kept, e.b)) THEN k.kept ELSE list_append(k.kept, p.id) END FROM k JOIN p ON p.query_id = k.query_id AND p.place = k.place + 1)
SELECT query_id, unnest(kept) AS id, unnest(range(1, len(kept) + 1)) AS place FROM (SELECT query_id, kept, place, max(place) OVER (PARTITION BY query_id) AS top FROM k) WHERE place = top""")
def recall_channel(spark, d):
    m = memories(spark, d)
    ranked = m.select("id", F.floor(F.col("id") / 25).alias("query_id"), F.col("id").alias("place"))
    out = recall.channel(ranked.union(ranked.withColumn("place", F.col("place") + 1_000_000)), m, links(spark, d), NOW, caller="u1", least_trust=0.3)
    return out.select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("full_context", "SELECT conv_id AS session_id, turn AS place FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS used FROM conversations) WHERE used <= 900")
def full_context(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    return recall.full_context(c, 900).select("session_id", "place")


@query("task_briefs", f"""WITH i AS (SELECT user_id AS task_id, event_type AS kind, event_id AS first_seq, '- [' || event_type || '] ' || props AS line FROM events WHERE event_id % 4 <> 0),
q AS (SELECT task_id, l, array_to_string(l, chr(10)) AS w, {_KEEP.replace("2000", "300")} AS k FROM (SELECT task_id, list(line ORDER BY kind, first_seq) AS l FROM i GROUP BY 1)) SELECT task_id, CASE WHEN length(w) <= 300 THEN w ELSE substr(array_to_string(l[1:k], chr(10)) || chr(10) || '…(' || (len(l) - k) || ' more)', 1, 300) END AS brief FROM q""")
def task_briefs(spark, d):
    i = F.col("event_id")
    items = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("kind"), i.alias("first_seq"), F.col("props").alias("text"), F.when(i % 4 == 0, "done").alias("status"))
    return recall.briefs(items, 300)


@query("covered_scopes", f"{_M} SELECT id, CASE WHEN starts_with(namespace, '/p/en/') THEN '/p/en,' || namespace ELSE '' END AS scopes FROM m")
def covered_scopes(spark, d):
    return memories(spark, d).select("id", F.array_join(visibility.covered(ancestors(F.col("namespace")), ["/p/en"]), ",").alias("scopes"))


@query("folded_scope", f"{_M} SELECT id FROM m WHERE starts_with(lower(namespace), '/p/en//')")
def folded_scope(spark, d):
    return memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/P/EN", fold=True)).select("id")


@query("reranked_search", f"{_M}, {_LEX}, c AS (SELECT id, relevance AS fts, 0 AS v FROM lex), s AS (SELECT m.id, {1 / (1 - 0.35)} * (0.2 * fts + 0.15 * exp(-greatest(({NOW} - coalesce(last_accessed, created_at)) / 86400000.0::DOUBLE, 0) / (365 * greatest(importance + 0.3 * ln(access_count + 1), 0.1))) + 0.1 * least(ln(access_count + 1) / ln(100), 1) + 0.2 * importance) AS score, fts FROM m JOIN c USING (id)), "
    "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, fts DESC, id) AS n FROM s) SELECT id, round(0.4 * CASE WHEN n <= 20 THEN least(greatest(0.5 + (id % 10 / 10.0 - 0.5) * 2, 0), 1) ELSE 0.5 END + 0.6 * score, 5) AS score FROM r ORDER BY 0.4 * CASE WHEN n <= 20 THEN least(greatest(0.5 + (id % 10 / 10.0 - 0.5) * 2, 0), 1) ELSE 0.5 END + 0.6 * score DESC, fts DESC, id LIMIT 15")
def reranked_search(spark, d):
    m = memories(spark, d)
    lists = {"fts": retrieval.lexical_search(_english(spark, d), list(TERMS))}
    scores = m.select("id", (F.col("id") % 10 / 10).alias("rerank"))
    return retrieval.fuse(m, lists, None, NOW, 15, rerank=scores, alpha=0.4).select("id", F.round("score", 5).alias("score"))
