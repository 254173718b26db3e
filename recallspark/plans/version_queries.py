"""Registered queries of versions, histories and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.operators import graph, reports, retrieval, versions, visibility
from recallspark.operators.channels import entity_rows
from recallspark.plans.queries import _DISTANCE, _M, _QUERY_VECTOR, AS_OF, HIDDEN, _vectors, rank_sql
from recallspark.plans.registry import query
from recallspark.sources.tables import CITATIONS_SQL, EPOCH, HOUR, citations, links, memories

_R = _M.replace("WITH", "WITH RECURSIVE", 1)
_BOTH = "b AS (SELECT source_id AS a, target_id AS b FROM l WHERE link_type = 'supersedes' {0} UNION SELECT target_id, source_id FROM l WHERE link_type = 'supersedes' {0})"


def _closure(seed: str, extra: str = "") -> str:
    return f"{_R}, {_BOTH.format(extra)}, x(seed, id) AS (SELECT id, id FROM m WHERE {seed} UNION SELECT x.seed, b.b FROM x JOIN b ON b.a = x.id)"


@query("chain_closure", f"{_closure('id IN (44, 120, 205)', f'AND coalesce(judged_at, created_at) <= {AS_OF}')} SELECT seed, id FROM x")
def chain_closure(spark, d):
    return graph.closure(links(spark, d), memories(spark, d).where("id IN (44, 120, 205)"), as_of=AS_OF)


@query("revision_history", f"{_closure('id = 64')} SELECT m.id, created_at FROM x JOIN m ON m.id = x.id ORDER BY created_at, m.id LIMIT 50")
def revision_history(spark, d):
    return graph.history(memories(spark, d), links(spark, d), 64)[0].select("id", "created_at")


@query("revision_links", f"{_closure('id = 64')} SELECT source_id, target_id FROM l WHERE link_type = 'supersedes' AND source_id IN (SELECT id FROM x) AND target_id IN (SELECT id FROM x)")
def revision_links(spark, d):
    return graph.history(memories(spark, d), links(spark, d), 64)[1].select("source_id", "target_id")


def _revisions(spark, d):
    return links(spark, d).where("link_type = 'supersedes'").withColumn("revision", F.lit(1))


@query("chain_depths", f"{_R}, b AS (SELECT source_id AS a, min(target_id) AS t FROM l WHERE link_type = 'supersedes' GROUP BY 1), x(id, pos, depth) AS (SELECT a, t, 2 FROM b UNION ALL SELECT x.id, b.t, depth + 1 FROM x JOIN b ON b.a = x.pos WHERE depth <= 100) SELECT id, max(depth) AS depth FROM x GROUP BY id")
def chain_depths(spark, d):
    return graph.chain_depth(_revisions(spark, d))


@query("duplicate_groups", f"""{_R}, p AS (SELECT source_id AS a, target_id AS b, similarity AS s FROM (SELECT target_id AS source_id, source_id AS target_id, similarity FROM l WHERE similarity > 0.95) ORDER BY s DESC, a, b LIMIT 50),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), x(id, r) AS (SELECT a, a FROM u UNION SELECT u.b, x.r FROM x JOIN u ON u.a = x.id), g AS (SELECT id, min(r) AS c FROM x GROUP BY id),
k AS (SELECT c, (max({{'w': importance * (access_count + 1), 'n': -m.id}})).n * -1 AS representative FROM g JOIN m USING (id) GROUP BY c)
SELECT g.id, representative, coalesce(max(s), 0.95) AS similarity FROM g JOIN k USING (c) LEFT JOIN (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p) q ON q.a = g.id AND q.b = representative WHERE g.id <> representative GROUP BY 1, 2""")
def duplicate_groups(spark, d):
    x = links(spark, d).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "similarity")
    return graph.duplicate_groups(memories(spark, d), x)


@query("scoped_walk", f"""{_R}, n AS (SELECT id FROM m WHERE type <> 'gotcha'), e AS (SELECT source_id AS a, target_id AS b FROM l UNION SELECT target_id, source_id FROM l), f AS (SELECT * FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)),
w(id, hops) AS (SELECT 52::BIGINT, 0 UNION SELECT f.b, hops + 1 FROM w JOIN f ON f.a = w.id WHERE hops < 4) SELECT id, min(hops) AS hops FROM w WHERE id <> 52 AND id IN (SELECT id FROM m WHERE archived_at IS NULL) AND id NOT IN ({HIDDEN}) GROUP BY id""")
def scoped_walk(spark, d):
    n = memories(spark, d).where("type <> 'gotcha'")
    x = links(spark, d)
    return graph.walk(x, 52, 4, nodes=n, shown=visibility.current(n, x)).select("id", "hops")


@query("reachable_rank", rank_sql(near=True))
def reachable_rank(spark, d):
    seeds = memories(spark, d).where("id IN (3, 77)").select("id")
    return graph.personalised_rank(links(spark, d), seeds, reach=3).select("id", F.round("rank", 9).alias("rank"))


_EDITS = f"e AS (SELECT id, id + 1000000 AS new_id, concat('new ', content) AS content, {AS_OF} + id AS t FROM m WHERE id % 10 = 3)"


@query("revised_rows", f"{_M}, {_EDITS} SELECT m.id, importance, m.valid_from, coalesce(valid_until, t) AS valid_until, length(m.content) AS chars FROM m LEFT JOIN e USING (id) UNION ALL SELECT new_id, importance, t, NULL, length(e.content) FROM m JOIN e USING (id)")
def revised_rows(spark, d):
    m = memories(spark, d)
    edits = m.where("id % 10 = 3").select("id", (F.col("id") + 1_000_000).alias("new_id"), F.concat(F.lit("new "), "content").alias("content"), (F.col("id") + AS_OF).alias("at"))
    return versions.revised(m, _revisions(spark, d), edits)[0].select("id", "importance", "valid_from", "valid_until", F.length("content").alias("chars"))


@query("revision_edges", f"{_M}, {_EDITS} SELECT new_id AS source_id, id AS target_id, CASE WHEN id IN (SELECT source_id FROM l WHERE link_type = 'supersedes') THEN 2 ELSE 1 END AS revision, t AS judged_at FROM e")
def revision_edges(spark, d):
    m = memories(spark, d)
    edits = m.where("id % 10 = 3").select("id", (F.col("id") + 1_000_000).alias("new_id"), "content", (F.col("id") + AS_OF).alias("at"))
    return versions.revised(m, _revisions(spark, d), edits)[1].select("source_id", "target_id", "revision", "judged_at")


@query("advanced_heads", f"""{_M}, w AS (SELECT DISTINCT namespace, state_key, max(id) OVER (PARTITION BY namespace, state_key) AS new_id FROM m WHERE state_key IS NOT NULL),
h AS (SELECT new_id, m.id, row_number() OVER (PARTITION BY new_id ORDER BY valid_from DESC, m.id) AS n FROM m JOIN w USING (namespace, state_key) WHERE valid_until IS NULL AND archived_at IS NULL AND m.id <> new_id) SELECT new_id AS source_id, id AS target_id, {AS_OF} AS judged_at FROM h WHERE n = 1""")
def advanced_heads(spark, d):
    m = memories(spark, d)
    writes = m.where("state_key IS NOT NULL").groupBy("namespace", "state_key").agg(F.max("id").alias("id")).withColumn("at", F.lit(AS_OF))
    return versions.advanced(m, writes)[1].select("source_id", "target_id", "judged_at")


@query("deleted_cascade", f"""{_M}, c AS ({CITATIONS_SQL}), g AS (SELECT id FROM m WHERE id % 4 = 1), k AS (SELECT session_id AS id, id AS x FROM m), q AS (SELECT id FROM k WHERE x NOT IN (SELECT id FROM g) GROUP BY id HAVING count(*) >= 2)
SELECT 'memories' AS name, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'links', count(*) FROM l WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'citations', count(*) FROM c WHERE memory_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'clusters', count(*) FROM q UNION ALL SELECT 'audit', count(*) FROM g""")
def deleted_cascade(spark, d):
    m = memories(spark, d)
    clusters = m.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(m["id"])).alias("member_ids"))
    out = versions.deleted(m.where("id % 4 = 1"), m, links(spark, d), entity_rows(m.limit(0)), citations(spark, d), clusters)
    parts = [out[k].agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k in ("memories", "links", "citations", "clusters", "audit")]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union


@query("merged_rows", f"""{_M}, t AS (SELECT *, ['t' || (id % 3), 's'] AS tags FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY namespace, type, content ORDER BY created_at, id) AS n FROM t),
g AS (SELECT namespace, type, content, max(importance) AS best, (min({{'c': created_at, 'i': id, 'k': state_key}}) FILTER (state_key IS NOT NULL)).k AS k FROM t GROUP BY 1, 2, 3),
x AS (SELECT namespace, type, content, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM t GROUP BY 1, 2, 3)
SELECT r.id, CASE WHEN n = 1 THEN best ELSE importance END AS importance, CASE WHEN n = 1 THEN coalesce(state_key, k) ELSE state_key END AS state_key, array_to_string(CASE WHEN n = 1 THEN x.tags ELSE r.tags END, ',') AS tags
FROM r JOIN g USING (namespace, type, content) JOIN x USING (namespace, type, content) WHERE n = 1 OR pinned""")
def merged_rows(spark, d):
    m = memories(spark, d).withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), F.lit("s")))
    return versions.merged(m).select("id", "importance", "state_key", F.array_join("tags", ",").alias("tags"))


@query("consolidation_order", f"{_M}, a AS (SELECT DISTINCT unnest(['/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1), namespace]) AS path, unnest([1, 2, 3]) AS depth FROM m) SELECT path, 4 - depth AS round FROM a")
def consolidation_order(spark, d):
    return versions.consolidation_order(reports.namespace_nodes(memories(spark, d))).select("path", F.col("round").cast("long").alias("round"))


@query("embedding_claims", f"{_M}, s AS (SELECT id, created_at FROM m WHERE id % 3 = 0 ORDER BY created_at, id LIMIT 20) SELECT m.id, CASE WHEN m.id IN (SELECT id FROM s) THEN CASE WHEN m.id IN (SELECT vec_id FROM embeddings) THEN 'fresh' ELSE 'error' END WHEN m.id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS embed_state FROM m")
def embedding_claims(spark, d):
    m = memories(spark, d).withColumn("embed_state", F.when(F.col("id") % 3 == 0, "stale").otherwise("fresh"))
    due = versions.embeddings_due(m, 20, EPOCH + HOUR).select("id", F.col("embed_state").alias("_s"))
    rows = m.join(due, "id", "left").withColumn("embed_state", F.coalesce("_s", "embed_state")).drop("_s")
    return versions.embedded(rows, _vectors(spark, d), 64).select("id", "embed_state")


@query("contradiction_candidates", f"""{_M}, v AS (SELECT vec_id AS id, {_DISTANCE} AS d FROM embeddings ORDER BY d, id LIMIT 20), w AS (SELECT id, greatest(1 - d * d / 2, 0) AS vec FROM v WHERE 1 - d * d / 2 >= -20),
f AS (SELECT id, row_number() OVER (ORDER BY length(content), id) - 1 AS rank FROM m WHERE starts_with(namespace, '/p/en/') QUALIFY rank < 20), b AS (SELECT coalesce(w.id, f.id) AS id, vec, rank FROM w FULL JOIN f ON w.id = f.id)
SELECT id, round(0.6 * coalesce(vec, 0) + 0.4 * CASE WHEN rank IS NULL THEN 0 ELSE greatest(0, 1 - rank / 20.0::DOUBLE) END + CASE WHEN vec IS NOT NULL AND rank IS NOT NULL THEN 0.2 ELSE 0 END, 6) AS score FROM b ORDER BY score DESC, id LIMIT 10""")
def contradiction_candidates(spark, d):
    subject = F.lit(1).alias("subject")
    v = retrieval.nearest(_vectors(spark, d), _QUERY_VECTOR, 20).select(subject, "id", "distance")
    m = memories(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en")).orderBy(F.length("content"), "id").limit(20)
    f = m.select(subject, "id", (F.row_number().over(Window.orderBy(F.length("content"), "id")) - 1).alias("rank"))
    return graph.contradiction_candidates(f, v, least_cosine=-20.0).select("id", F.round("score", 6).alias("score"))

