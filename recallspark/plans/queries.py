"""The registered queries of the reference operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import scoring, text
from recallspark.operators import components, evaluation, graph, lifecycle, retrieval, visibility
from recallspark.plans.registry import query
from recallspark.sources.tables import EPOCH, HOUR, LINKS_SQL, MEMORIES_SQL, NOW, links, memories, table
from recallspark.streaming import ledgers

WITH = f"WITH m AS ({MEMORIES_SQL}), l AS ({LINKS_SQL}) ".replace("AS STRING", "AS VARCHAR")
HIDDEN = "SELECT target_id FROM l WHERE link_type = 'supersedes' AND confidence >= 0.8"
AS_OF = EPOCH + 300 * HOUR
TERMS = ("the", "of", "ention")


@query("point_read", WITH + "SELECT id, namespace, type, importance FROM m WHERE id = 42")
def point_read(spark, d):
    return memories(spark, d).where("id = 42").select("id", "namespace", "type", "importance")


@query("list_memories", WITH + f"SELECT id, created_at FROM m WHERE (namespace = '/p/en' OR starts_with(namespace, '/p/en/')) AND archived_at IS NULL AND id NOT IN ({HIDDEN}) AND type = 'note' ORDER BY created_at DESC, id LIMIT 20")
def list_memories(spark, d):
    m = memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en"))
    return visibility.current(m, links(spark, d)).where("type = 'note'").orderBy(F.desc("created_at"), "id").limit(20).select("id", "created_at")


@query("scope_subtree", WITH + "SELECT id, namespace FROM m WHERE namespace = '/p/en//src1' OR starts_with(namespace, '/p/en//src1/')")
def scope_subtree(spark, d):
    return memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en//src1")).select("id", "namespace")


@query("visible_rows", WITH + "SELECT id FROM m WHERE visibility IS NULL OR visibility <> 'personal' OR owner = 'u1'")
def visible_rows(spark, d):
    return memories(spark, d).where(visibility.visible_to("u1", F.col("visibility"), F.col("owner"))).select("id")


@query("granted_rows", WITH + "SELECT namespace, count(*) AS n FROM m WHERE starts_with(namespace, '/p/de/') OR namespace = '/p/fr//src1' GROUP BY namespace")
def granted_rows(spark, d):
    return memories(spark, d).where(visibility.granted(F.col("namespace"), ["/p/de", "/p/fr//src1"])).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("current_rows", WITH + f"SELECT id FROM m WHERE archived_at IS NULL AND id NOT IN ({HIDDEN})")
def current_rows(spark, d):
    return visibility.current(memories(spark, d), links(spark, d)).select("id")


@query("current_scoped", WITH + f"SELECT id FROM m WHERE starts_with(namespace, '/p/en/') AND archived_at IS NULL AND id NOT IN ({HIDDEN} AND source_id IN (SELECT id FROM m WHERE starts_with(namespace, '/p/en/')))")
def current_scoped(spark, d):
    return visibility.current(memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en")), links(spark, d), scoped=True).select("id")


@query("as_of_rows", WITH + f"SELECT id FROM m WHERE valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until >= {AS_OF}) AND archived_at IS NULL AND id NOT IN ({HIDDEN} AND coalesce(judged_at, created_at) <= {AS_OF})")
def as_of_rows(spark, d):
    return visibility.current(memories(spark, d), links(spark, d), as_of=AS_OF).select("id")


@query("before_rows", WITH + f"SELECT id FROM m WHERE valid_from <= {AS_OF} AND archived_at IS NULL AND id NOT IN ({HIDDEN})")
def before_rows(spark, d):
    return visibility.current(memories(spark, d), links(spark, d), before=AS_OF).select("id")


@query("scope_statistics", WITH + "SELECT namespace, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM m GROUP BY namespace")
def scope_statistics(spark, d):
    return memories(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("document_frequency", WITH + r"SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM m) GROUP BY t")
def document_frequency(spark, d):
    terms = F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("term")
    return memories(spark, d).select(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_TF = ", ".join(f"10.0 * len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_SPLIT = r"[^\p{L}\p{N}]+"
_BM25 = f"""tok AS (SELECT id, length(content) AS dl, regexp_split_to_array(lower(strip_accents(content)), '{_SPLIT}') AS t FROM m WHERE starts_with(namespace, '/p/en/')),
tf AS (SELECT id, dl, {_TF} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM tf),
sc AS (SELECT id, dl, {", ".join(f"tf{i}" for i in range(len(TERMS)))}, {" + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))} AS bm25,
  {" + ".join(f"(tf{i} > 0)::INT" for i in range(len(TERMS)))} AS matched FROM tf, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))})"""
#: A scope's list ranks its shortest rows, up to the window; by coverage, those of each term.
_SHARE = " UNION ALL ".join(f"(SELECT id FROM sc WHERE tf{i} > 0 ORDER BY dl, id LIMIT {retrieval.SCOPED_WINDOW})" for i in range(len(TERMS)))
_LEX = f"""{_BM25}, fit AS (SELECT *, max(bm25) OVER () AS top FROM (SELECT * FROM sc WHERE matched = {len(TERMS)} OR (SELECT max(matched) FROM sc) < {len(TERMS)} ORDER BY dl, id LIMIT {retrieval.SCOPED_WINDOW})),
lex AS (SELECT id, (bm25 / {len(TERMS)}) / (1 + bm25 / {len(TERMS)}) AS relevance FROM fit WHERE top / {len(TERMS)} >= {retrieval.LEAST_BM25}
UNION ALL SELECT id, count(*) / {len(TERMS)} FROM ({_SHARE}) WHERE coalesce((SELECT max(bm25) FROM fit), 0) / {len(TERMS)} < {retrieval.LEAST_BM25} GROUP BY id)"""
_M = WITH.rstrip()


def _english(spark, d):
    return memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en"))


@query("bm25_scoped", f"{_M}, {_BM25} SELECT id, round(bm25, 6) AS bm25, matched FROM sc")
def bm25_scoped(spark, d):
    return retrieval.scoped_bm25(_english(spark, d), list(TERMS)).select("id", F.round("bm25", 6).alias("bm25"), "matched")


@query("lexical_search", f"{_M}, {_LEX} SELECT id, round(relevance, 6) AS relevance FROM lex")
def lexical_search(spark, d):
    return retrieval.lexical_search(_english(spark, d), list(TERMS)).select("id", F.round("relevance", 6).alias("relevance"))


_QUERY_VECTOR = [1.0 if i % 2 else -0.5 for i in range(64)]
_DISTANCE = f"sqrt(list_sum(list_transform(list_zip(embedding, {_QUERY_VECTOR}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"
_VEC = f"vec AS (SELECT vec_id AS id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, id LIMIT 50)"
_SCOPED_VEC = f"vec AS (SELECT vec_id AS id, {_DISTANCE} AS distance FROM embeddings WHERE vec_id IN (SELECT id FROM m WHERE starts_with(namespace, '/p/en/')) ORDER BY distance, id LIMIT 50)"


@query("nearest_vectors", f"WITH {_VEC} SELECT id, round(distance, 6) AS distance FROM vec")
def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest(v, _QUERY_VECTOR, 50).select("id", F.round("distance", 6).alias("distance"))


def _fused(parts: str, weights: dict[str, float]) -> str:
    """SQL of the fused score over ``c`` (id, fts, v)."""
    recency = f"exp(-greatest(({NOW} - coalesce(last_accessed, created_at)) / 86400000.0::DOUBLE, 0) / (365 * greatest(importance + 0.3 * ln(access_count + 1), 0.1)))"
    w = weights
    return f"""{parts} SELECT m.id, round({w["fts"]} * fts + {w["vec"]} * v + {w["recency"]} * {recency} + {w["access"]} * least(ln(access_count + 1) / ln(100), 1) + {w["importance"]} * importance, 6) AS score,
  round(({w["fts"]} * fts + {w["vec"]} * v) / {w["fts"] + w["vec"]}, 6) AS relevance FROM m JOIN c ON m.id = c.id ORDER BY score DESC, m.id LIMIT 20"""


_PARTS = f"""{_M}, {_LEX}, {_SCOPED_VEC}, c AS (SELECT coalesce(lex.id, vec.id) AS id, coalesce(relevance, 0) AS fts,
  coalesce(least(greatest(1 - distance * distance / 2, 0), 1), 0) AS v FROM lex FULL JOIN vec ON lex.id = vec.id)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("hybrid_search", _fused(_PARTS, scoring.SEMANTIC_WEIGHTS))
def hybrid_search(spark, d):
    m = _english(spark, d)
    out = retrieval.fuse(m, {"fts": retrieval.lexical_search(m, list(TERMS))}, retrieval.nearest(_vectors(spark, d), _QUERY_VECTOR, 50, m), NOW, 20)
    return out.select("id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


_PHRASE = rf"""ph AS (SELECT id, length(content) AS dl, contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(content)), '{_SPLIT}'), lambda x: x <> ''), ' ') || ' ', ' in the ') AS hit FROM m WHERE starts_with(namespace, '/p/en/')),
ps AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (hit) AS df FROM ph),
pb AS (SELECT id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * 10 * 2.2 / (10 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM ph, ps WHERE hit ORDER BY dl, id LIMIT {retrieval.SCOPED_WINDOW}),
plex AS (SELECT id, CASE WHEN (SELECT max(s) FROM pb) >= 1e-3 THEN s / (1 + s) ELSE 1 END AS relevance FROM pb)"""


@query("phrase_search", f"{_M}, {_PHRASE} SELECT id, round(relevance, 6) AS relevance FROM plex")
def phrase_search(spark, d):
    return retrieval.lexical_search(_english(spark, d), ["in", "the"], phrase=True).select("id", F.round("relevance", 6).alias("relevance"))


@query("expanded_search", _fused(f"""{_M}, {_LEX}, {_PHRASE}, c AS (SELECT id, sum(relevance) / 2 AS fts, 0 AS v FROM (SELECT id, relevance FROM lex UNION ALL SELECT id, relevance FROM plex) GROUP BY id)""", retrieval.shared_out(scoring.WEIGHT_PROFILES["temporal"])))
def expanded_search(spark, d):
    m = _english(spark, d)
    lists = {"fts": retrieval.lexical_search(m, list(TERMS)), "fts:phrase": retrieval.lexical_search(m, ["in", "the"], phrase=True), "ident": m.select("id", F.lit(0.0).alias("relevance")).limit(0)}
    out = retrieval.fuse(m, lists, None, NOW, 20, kind="temporal")
    return out.select("id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("auto_links", """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))) AS distance FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM p WHERE distance < 1.2) SELECT DISTINCT unnest([query_id, id]) AS source_id, unnest([id, query_id]) AS target_id, round(greatest(1 - distance * distance / 2, 0), 6) AS similarity FROM r WHERE n <= 20""")
def auto_links(spark, d):
    v = _vectors(spark, d)
    return graph.auto_links(v, v.where("id % 50 = 0"), below=1.2).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@query("trust_tiers", _M + f""", s AS (SELECT id, pinned, 0.5 * importance + 0.3 * least(ln(access_count + 1) / ln(100), 1)
  + 0.2 * exp(-greatest(({NOW} - created_at) / 86400000.0::DOUBLE, 0) / (30 * greatest(importance + 0.3 * ln(access_count + 1), 0.1))) AS t FROM m)
SELECT id, round(t, 6) AS trust, CASE WHEN pinned THEN 'pinned' WHEN t >= 0.7 THEN 'hot' WHEN t >= 0.3 THEN 'warm' ELSE 'cold' END AS tier FROM s""")
def trust_tiers(spark, d):
    m = memories(spark, d).withColumn("t", scoring.trust(NOW, F.col("importance"), F.col("access_count"), F.col("created_at")))
    return m.select("id", F.round("t", 6).alias("trust"), scoring.tier(F.col("t"), F.col("pinned")).alias("tier"))


@query("link_counts", _M + "SELECT id, count(*) AS degree, count(*) FILTER (link_type = 'conflicts') AS conflicts FROM (SELECT source_id AS id, link_type FROM l UNION ALL SELECT target_id, link_type FROM l) GROUP BY id")
def link_counts(spark, d):
    x = links(spark, d)
    both = x.select(F.col("source_id").alias("id"), "link_type").union(x.select("target_id", "link_type"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("link_type") == "conflicts").alias("conflicts"))


@query("exact_duplicates", _M + "SELECT (min({'c': created_at, 'i': id})).i AS keeper, count(*) AS copies, max(importance) AS importance FROM m GROUP BY namespace, type, content HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return lifecycle.exact_duplicates(memories(spark, d))


@query("burst_families", _M + f"SELECT namespace, type, count(*) AS family, (max({{'p': importance, 'n': -id}})).n * -1 AS keeper FROM m WHERE created_at >= {EPOCH + 2000 * HOUR} - 7776000000 GROUP BY namespace, type, substring(content, 1, 4) HAVING count(*) >= 2")
def burst_families(spark, d):
    return lifecycle.burst_families(memories(spark, d), EPOCH + 2000 * HOUR, days=90, prefix=4, least=2)


@query("state_history", _M + "SELECT id, namespace, state_key, valid_from, lead(valid_from) OVER w AS closed_at, lead(valid_from) OVER w IS NULL AS is_head FROM m WHERE state_key IS NOT NULL WINDOW w AS (PARTITION BY namespace, state_key ORDER BY valid_from, id)")
def state_history(spark, d):
    return lifecycle.state_history(memories(spark, d))


@query("state_at", _M + f"SELECT namespace, state_key, (max({{'v': valid_from, 'c': created_at, 'i': id}})).i AS id FROM m WHERE state_key IS NOT NULL AND valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until >= {AS_OF}) GROUP BY namespace, state_key")
def state_at(spark, d):
    return lifecycle.state_at(memories(spark, d), AS_OF)


@query("scope_roll_up", _M + """, a AS (SELECT namespace, unnest(['/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1), namespace]) AS path, access_count, created_at FROM m)
SELECT path, count(*) AS rows, count(*) FILTER (access_count = 0) AS never_accessed, max(created_at) AS last_activity FROM a GROUP BY path""")
def scope_roll_up(spark, d):
    return lifecycle.roll_up(memories(spark, d))


@query("promoted_patterns", _M + """, r AS (SELECT namespace, content, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS n, count(*) OVER (PARTITION BY namespace) AS rows FROM m)
SELECT namespace, max(rows) AS rows, string_agg(substring(content, 1, 160), ' | ' ORDER BY n) AS extract FROM r WHERE n <= 3 AND rows >= 8 GROUP BY namespace""")
def promoted_patterns(spark, d):
    return lifecycle.promotion(memories(spark, d)).drop("promoted_from")


@query("idle_sessions", _M + f"SELECT session_id, max(created_at) AS last FROM m GROUP BY session_id HAVING max(created_at) < {EPOCH + 970 * HOUR} - 43200000")
def idle_sessions(spark, d):
    return lifecycle.idle_sessions(memories(spark, d), EPOCH + 970 * HOUR)


@query("ingest_once", "WITH b AS (SELECT doc_id % 300 AS external_id, source, doc_id AS position FROM documents), f AS (SELECT external_id, source, min(position) AS position FROM b GROUP BY 1, 2) SELECT external_id, source, position FROM f WHERE (external_id, source) NOT IN (SELECT doc_id, source FROM documents WHERE doc_id < 100)")
def ingest_once(spark, d):
    docs = table(spark, d, "documents")
    batch = docs.select((F.col("doc_id") % 300).alias("external_id"), "source", F.col("doc_id").alias("position"))
    stored = docs.where("doc_id < 100").select(F.col("doc_id").alias("external_id"), "source")
    return lifecycle.new_items(batch, stored, ["external_id", "source"]).select("external_id", "source", "position")


@query("usage_by_type", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / count(*), 2) AS hit_rate, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def usage_by_type(spark, d):
    hits = F.count_if(F.col("value") > 50)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.round(hits / F.count(F.lit(1)), 2).alias("hit_rate"), F.round(F.sum("value"), 2).alias("total"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_disc(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"))


@query("daily_ledger", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_ledger(spark, d):
    out = ledgers.windowed_counts(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    out = ledgers.sessions(table(spark, d, "events"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


@query("top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 50")
def top_users(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(50)


@query("newest_rows", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def newest_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("event_id", "user_id")


@query("one_hop", _M + ", e AS (SELECT * FROM (SELECT target_id AS id, similarity, link_type FROM l WHERE source_id = 20 UNION ALL SELECT source_id, similarity, link_type FROM l WHERE target_id = 20) ORDER BY similarity DESC, id, link_type LIMIT 10) SELECT id, max(similarity) AS similarity FROM e GROUP BY id")
def one_hop(spark, d):
    return graph.neighbours(links(spark, d), 20, 10).select("id", "similarity")


@query("graph_walk", _M.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT source_id AS a, target_id AS b FROM l UNION SELECT target_id, source_id FROM l),
w(id, hops) AS (SELECT 50::BIGINT, 0 UNION SELECT e.b, hops + 1 FROM w JOIN e ON e.a = w.id WHERE hops < 3) SELECT id, min(hops) AS hops FROM w WHERE id <> 50 GROUP BY id""")
def graph_walk(spark, d):
    return graph.walk(links(spark, d), 50, 3).select("id", "hops")


@query("link_components", _M.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT source_id AS a, target_id AS b FROM l WHERE similarity >= 0.9 AND link_type = 'semantic'), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, r) AS (SELECT a, a FROM b UNION SELECT b.b, w.r FROM w JOIN b ON b.a = w.id) SELECT id, min(r) AS component FROM w GROUP BY id""")
def link_components(spark, d):
    e = links(spark, d).where("similarity >= 0.9 AND link_type = 'semantic'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return components.connected_components(e)


_STEP = """r{i} AS (SELECT coalesce(q.id, s.id) AS id, 0.15 * coalesce(s.mass, 0) + 0.85 * coalesce(q.m, 0) AS rank FROM (SELECT t.b AS id, sum(r.rank * t.p) AS m FROM r{j} r JOIN t ON t.a = r.id GROUP BY t.b) q FULL JOIN s ON s.id = q.id)"""


def rank_sql(rounds: int = 20, near: bool = False) -> str:
    """Random walks that restart at two seeds, a fixed number of rounds; with ``near`` within three hops."""
    base = ", e AS MATERIALIZED (SELECT a, b, max(w) AS w FROM (SELECT source_id AS a, target_id AS b, greatest(similarity, 0) AS w FROM l UNION ALL SELECT target_id, source_id, greatest(similarity, 0) FROM l) GROUP BY 1, 2){near}, z AS (SELECT a, sum(w) AS s, count(*) AS n FROM {edges} e GROUP BY a), t AS MATERIALIZED (SELECT e.a, e.b, CASE WHEN s > 0 THEN w / s ELSE 1 / n END AS p FROM {edges} e JOIN z ON z.a = e.a), s AS (SELECT id, 0.5::DOUBLE AS mass FROM m WHERE id IN (3, 77)), r0 AS (SELECT id, mass AS rank FROM s)"
    steps = ", ".join(_STEP.format(i=i, j=i - 1).replace(" AS (SELECT coalesce", " AS MATERIALIZED (SELECT coalesce", 1) for i in range(1, rounds + 1))
    within = ", h(id, n) AS (SELECT id, 0 FROM m WHERE id IN (3, 77) UNION SELECT e.b, n + 1 FROM h JOIN e ON e.a = h.id WHERE n < 3), o AS MATERIALIZED (SELECT * FROM e WHERE a IN (SELECT id FROM h) AND b IN (SELECT id FROM h))"
    base = base.replace("{near}", within if near else "").replace("{edges}", "o" if near else "e")
    return f"{_M.replace('WITH', 'WITH RECURSIVE', 1)}{base}, {steps} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("personalised_rank", rank_sql())
def personalised_rank(spark, d):
    seeds = memories(spark, d).where("id IN (3, 77)").select("id")
    return graph.personalised_rank(links(spark, d), seeds).select("id", F.round("rank", 9).alias("rank"))


_RUN = "WITH r AS (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), q AS (SELECT user_id AS query_id, event_id AS doc_id FROM events WHERE event_type = 'purchase')"


def _run(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.row_number().over(w).alias("rank"))
    return ranked, e.where("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"))


@query("ranked_metrics", _RUN + """, h AS (SELECT q.query_id, count(*) AS n, count(r.rank) AS f, min(r.rank) AS best, coalesce(sum(1 / log2(r.rank + 1)), 0) AS dcg FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND r.rank <= 10 GROUP BY 1)
SELECT query_id, round(f / n, 6) AS recall, round(f / 10, 6) AS precision, round(coalesce(1 / best, 0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM h""")
def ranked_metrics(spark, d):
    out = evaluation.ranked_metrics(*_run(spark, d))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


@query("threshold_sweep", """WITH p AS (SELECT least(floor(l_discount * 1000 + 1e-9), 99) AS c, l_returnflag = 'R' AS y FROM lineitem), g AS (SELECT unnest(range(50, 100)) AS t)
SELECT CAST(t AS INT) AS t, count(*) FILTER (c >= t AND y) AS tp, count(*) FILTER (c >= t AND NOT y) AS fp, count(*) FILTER (c < t AND y) AS fn,
  round(2 * count(*) FILTER (c >= t AND y) / (2 * count(*) FILTER (c >= t AND y) + count(*) FILTER (c >= t AND NOT y) + count(*) FILTER (c < t AND y)), 6) AS f1 FROM g, p GROUP BY t""")
def threshold_sweep(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").alias("positive"))
    return evaluation.threshold_sweep(p).select("t", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("frontier", "WITH s AS (SELECT p_brand AS system, round(avg(p_size), 6) AS accuracy, round(avg(p_retailprice), 6) AS cost FROM part GROUP BY 1) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost))")
def frontier(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("system")).agg(F.round(F.avg("p_size"), 6).alias("accuracy"), F.round(F.avg("p_retailprice"), 6).alias("cost"))
    return evaluation.frontier(s)


@query("holm_correction", "WITH s AS (SELECT n_name AS label, (n_nationkey % 7 + 1) / 200.0 AS p FROM nation), r AS (SELECT label, p, row_number() OVER (ORDER BY p, label) AS r, count(*) OVER () AS m FROM s) SELECT label, CAST(p AS DOUBLE) AS p, round(CAST(least(max((m - r + 1) * p) OVER (ORDER BY p, label ROWS UNBOUNDED PRECEDING), 1) AS DOUBLE), 9) AS adjusted FROM r")
def holm_correction(spark, d):
    s = table(spark, d, "nation").select(F.col("n_name").alias("label"), ((F.col("n_nationkey") % 7 + 1) / 200.0).cast("double").alias("p"))
    return evaluation.holm(s).select("label", "p", F.round("adjusted", 9).alias("adjusted"))


@query("mcnemar", "WITH s AS (SELECT n_nationkey AS k, (n_nationkey % 9)::BIGINT AS b, (n_nationkey % 4)::BIGINT AS c FROM nation) SELECT k, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: factorial((b + c)::INT)::DOUBLE / factorial(i::INT)::DOUBLE / factorial((b + c - i)::INT)::DOUBLE)) / pow(2, b + c), 1.0) END, 9) AS p FROM s")
def mcnemar(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 9).cast("long").alias("b"), (F.col("n_nationkey") % 4).cast("long").alias("c"))
    return s.withColumn("p", F.round(evaluation.mcnemar_exact(F.col("b"), F.col("c")), 9))


@query("system_aggregates", "SELECT l_returnflag AS system, l_linestatus AS kind, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")
def system_aggregates(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("kind"), "l_discount")
    return x.groupingSets([("system",), ("system", "kind")], "system", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("context_windows", """WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn % 5 = 0), w AS (SELECT conv_id, unnest(range(turn - 1, turn + 2)) AS turn, turn AS hit FROM h)
SELECT c.conv_id, c.turn, min(abs(c.turn - w.hit)) AS distance FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn = w.turn GROUP BY 1, 2""")
def context_windows(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    w = c.where("turn % 5 = 0").select("conv_id", F.col("turn").alias("hit"), F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return c.join(w, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min(F.abs(F.col("turn") - F.col("hit"))).alias("distance"))


@query("roster_cut", """WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn FROM r WHERE used <= 900 OR n = 1""")
def roster_cut(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used"), F.count(F.lit(1)).over(w).alias("n"))
    return c.where("used <= 900 OR n = 1").select("conv_id", "turn")


@query("budget_pack", """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f(conv_id, n, remaining, kept) AS (SELECT conv_id, n, CASE WHEN c <= 600 THEN 600 - c ELSE 600 END, c <= 600 FROM o WHERE n = 1
UNION ALL SELECT o.conv_id, o.n, CASE WHEN c <= remaining THEN remaining - c ELSE remaining END, c <= remaining FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT f.conv_id, o.turn AS id FROM f JOIN o USING (conv_id, n) WHERE kept""")
def budget_pack(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "turn", F.length("text").alias("chars"))
    return retrieval.pack_within_budget(c, 600, "conv_id", ["turn"]).select("conv_id", "id")


@query("normalized_identifiers", r"""SELECT event_id, trim(lower(concat_ws(' ', regexp_replace(regexp_replace(regexp_replace(props, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), regexp_replace(regexp_replace(props, '[_-]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))) AS ident FROM events WHERE event_id % 10 = 0""".replace(" WHERE event_id % 10 = 0", ""))
def normalized_identifiers(spark, d):
    return table(spark, d, "events").select("event_id", text.normalize_identifiers(F.col("props")).alias("ident"))


@query("first_sentences", _M + "SELECT id, substring(trim(string_split(regexp_replace(content, '[.!?]', chr(1), 'g'), chr(1))[1], ' '), 1, 120) AS summary FROM m")
def first_sentences(spark, d):
    return memories(spark, d).select("id", text.first_sentence(F.col("content")).alias("summary"))


@query("token_estimates", _M + "SELECT id, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens FROM m")
def token_estimates(spark, d):
    return memories(spark, d).select("id", scoring.token_estimate(F.col("content")).cast("long").alias("tokens"))


@query("unfinished_pairs", "SELECT o_custkey AS id FROM orders GROUP BY 1 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def unfinished_pairs(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query("context_roster", _M + f"SELECT id, round(0.5 * importance + CASE WHEN created_at >= {EPOCH + 900 * HOUR} - 2592000000 THEN 0.5 ELSE 0 END, 6) AS rank FROM m ORDER BY pinned AND type = 'procedure' DESC, rank DESC, created_at DESC LIMIT 25")
def context_roster(spark, d):
    rank = F.round(0.5 * F.col("importance") + F.when(F.col("created_at") >= EPOCH + 900 * HOUR - 2_592_000_000, 0.5).otherwise(0.0), 6)
    m = memories(spark, d).withColumn("rank", rank)
    return m.orderBy(F.desc(F.col("pinned") & (F.col("type") == "procedure")), F.desc("rank"), F.desc("created_at")).limit(25).select("id", "rank")
