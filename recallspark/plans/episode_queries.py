"""Registered queries of episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import scoring
from recallspark.operators import episodes as ep
from recallspark.plans.registry import query
from recallspark.sources.tables import CITATIONS_SQL, EPISODES_SQL, EPOCH, HOUR, SESSIONS_SQL, citations, episodes, sessions

_W = f"WITH e AS ({EPISODES_SQL}), s AS ({SESSIONS_SQL}), c AS ({CITATIONS_SQL})".replace("AS STRING", "AS VARCHAR")
_NOW = EPOCH + 1500 * HOUR
_READ = f"(visibility IS NULL OR visibility <> 'personal' OR owner = 'u1') AND source_state = 'current' AND (expires_at IS NULL OR expires_at > {_NOW})"
_SCOPED = f"r AS (SELECT * FROM e WHERE (namespace = '/p/c1' OR starts_with(namespace, '/p/c1/')) AND {_READ})"
_TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn_index, 2147483647), occurred_at NULLS FIRST, id) - 1 AS position, min(occurred_at) OVER (PARTITION BY session_id) AS started FROM r)"


def _readable(spark, d):
    return ep.readable(episodes(spark, d), "/p/c1", "u1", _NOW)


@query("readable_episodes", f"{_W}, {_SCOPED} SELECT id FROM r")
def readable_episodes(spark, d):
    return _readable(spark, d).select("id")


@query("episode_selection", f"{_W} SELECT id FROM e WHERE source = 'chat' AND occurred_at < {EPOCH + 60 * HOUR} AND (expires_at <= {_NOW} OR (retention = 'session' AND session_id IN (SELECT id FROM s WHERE ended_at IS NOT NULL)))")
def episode_selection(spark, d):
    return ep.selected(episodes(spark, d), sessions(spark, d), _NOW, source="chat", before=EPOCH + 60 * HOUR, expired=True, session_ended=True).select("id")


@query("episode_sweep", f"{_W}, g AS (SELECT id FROM e WHERE expires_at <= {_NOW} OR (retention = 'session' AND session_id IN (SELECT id FROM s WHERE ended_at IS NOT NULL))) SELECT 'episodes' AS \"table\", count(*) AS deleted FROM g UNION ALL SELECT 'memory_episodes', count(*) FROM c WHERE episode_id IN (SELECT id FROM g)")
def episode_sweep(spark, d):
    return ep.swept(episodes(spark, d), sessions(spark, d), citations(spark, d), _NOW)[2]


@query("session_turns", f"{_W}, {_SCOPED}, {_TURNS} SELECT id, session_id, position, started FROM t")
def session_turns(spark, d):
    return ep.session_turns(_readable(spark, d)).select("id", "session_id", F.col("position").cast("long").alias("position"), "started")


@query("cited_evidence", f"{_W} SELECT memory_id, episode_id, external_id, row_number() OVER (PARTITION BY memory_id ORDER BY occurred_at NULLS FIRST, episode_id, span_start NULLS FIRST) AS place FROM c JOIN e ON e.id = c.episode_id")
def cited_evidence(spark, d):
    return ep.cited(citations(spark, d), episodes(spark, d)).select("memory_id", "episode_id", "external_id", F.col("place").cast("long").alias("place"))


@query("inherited_evidence", f"{_W}, x AS (SELECT DISTINCT memory_id // 2 AS memory_id, episode_id, span_start FROM c WHERE memory_id <> memory_id // 2 AND episode_id IN (SELECT id FROM e WHERE source_state = 'current')) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.memory_id = x.memory_id AND c.episode_id = x.episode_id AND coalesce(c.span_start, -1) = coalesce(x.span_start, -1))")
def inherited_evidence(spark, d):
    c = citations(spark, d)
    derived = c.select(F.floor(F.col("memory_id") / 2).alias("memory_id"), F.col("memory_id").alias("from_id")).distinct()
    return ep.inherited(c, derived, episodes(spark, d)).select("memory_id", "episode_id", "span_start")


@query("task_evidence", f"{_W}, x AS (SELECT task_id + 100 AS memory_id, id AS episode_id FROM e WHERE source_state = 'current') SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.memory_id = x.memory_id AND c.episode_id = x.episode_id AND c.span_start IS NULL)")
def task_evidence(spark, d):
    e = episodes(spark, d)
    tasks = e.select("task_id", (F.col("task_id") + 100).alias("memory_id")).distinct()
    return ep.linked_by_task(tasks, e, citations(spark, d)).select("memory_id", "episode_id")


_LEXICAL = r"""k AS (SELECT id, session_id, occurred_at, length(content) AS dl, list_filter(regexp_split_to_array(lower(strip_accents(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM r),
f AS (SELECT *, 10.0 * len(list_filter(t, lambda x: x = 'the')) AS a, 10.0 * len(list_filter(t, lambda x: x = 'and')) AS b FROM k),
st AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f),
w AS (SELECT f.* FROM f WHERE a > 0 AND b > 0 ORDER BY dl, id LIMIT 50),
sc AS (SELECT id, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m)) AS bm FROM w, st),
cov AS (SELECT id, count(*) / 2.0 AS rel FROM ((SELECT id FROM f WHERE a > 0 ORDER BY dl, id LIMIT 50) UNION ALL (SELECT id FROM f WHERE b > 0 ORDER BY dl, id LIMIT 50)) GROUP BY id),
lx AS (SELECT id, CAST((bm / 2) / (1 + bm / 2) AS DOUBLE) AS rel FROM sc WHERE (SELECT max(bm) FROM sc) / 2 >= 1e-3 UNION ALL SELECT id, CAST(rel AS DOUBLE) FROM cov WHERE coalesce((SELECT max(bm) FROM sc), 0) / 2 < 1e-3)"""
_FUSE = scoring.SEMANTIC_WEIGHTS
_REST = 1 / (1 - _FUSE["vec"])
_HITS = f"{_LEXICAL}, h AS (SELECT lx.id, round({_REST} * (0.2 * rel + 0.15 * exp(-greatest({_NOW} - coalesce(occurred_at, {_NOW}), 0) / 86400000.0::DOUBLE / (365 * 0.5)) + 0.2 * 0.5), 6) AS score FROM lx JOIN r ON r.id = lx.id ORDER BY score DESC, lx.id LIMIT 10)"


def _hits(spark, d):
    return ep.search(_readable(spark, d), ["the", "and"], _NOW, 10).select("id", F.round("score", 6).alias("score"))


@query("episode_search", f"{_W}, {_SCOPED}, {_HITS} SELECT round(score, 4) AS score FROM h")
def episode_search(spark, d):
    return _hits(spark, d).select(F.round("score", 4).alias("score"))


@query("episode_context", f"""{_W}, {_SCOPED}, {_TURNS}, h AS (SELECT id, session_id, position, id % 3 AS query_id, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS rank FROM t WHERE position = 1 AND session_id % 5 = 0),
n AS (SELECT query_id, session_id, unnest(range(greatest(position - 1, 0), position + 2)) AS position, rank FROM h), u AS (SELECT query_id, n.session_id, n.position, min(rank) AS rank FROM n JOIN t ON t.session_id = n.session_id AND t.position = n.position GROUP BY 1, 2, 3)
SELECT query_id, u.session_id, '[' || coalesce(strftime(make_timestamp(min(started) * 1000), '%Y-%m-%d %H:%M utc'), 'undated') || ']' || chr(10) || string_agg(content, chr(10) ORDER BY u.position) AS text FROM u JOIN t ON t.session_id = u.session_id AND t.position = u.position GROUP BY 1, 2""")
def episode_context(spark, d):
    turns = ep.session_turns(_readable(spark, d))
    hits = turns.where("position = 1 AND session_id % 5 = 0").select((F.col("id") % 3).alias("query_id"), "id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1)
    return ep.context(hits, turns, 10_000_000).select("query_id", "session_id", "text")
