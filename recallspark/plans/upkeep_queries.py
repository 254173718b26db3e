"""Registered queries of channels, allocation, upkeep, archives, answers and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import answers, entities, json_values, scoring, text
from recallspark.operators import allocation, archive, channels, evaluation, upkeep, visibility
from recallspark.plans.queries import HIDDEN, WITH
from recallspark.plans.registry import query
from recallspark.plans.shipping import ensure_on_executors
from recallspark.sources.tables import EPOCH, HOUR, NOW, links, memories, table

_M = WITH.rstrip()
_WORDS = ("the", "ention")
_NORM = r"trim(lower(concat_ws(' ', regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), regexp_replace(regexp_replace({0}, '[_-]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))))"


def _bm25_sql(rows: str, terms: tuple[str, ...], hit: str) -> str:
    """CTEs: rows (id, text) scored by the scope's statistics, the best row of each id."""
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: {hit.format(w)})) * 1.0::DOUBLE AS tf{i}" for i, w in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    return f"""tk AS (SELECT id, length(text) AS dl, regexp_split_to_array(text, '[^a-z0-9]+') AS t FROM ({rows})), tf AS (SELECT id, dl, {tf} FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(DISTINCT id) FILTER (tf{i} > 0) AS df{i}" for i in n)} FROM tf),
sc AS (SELECT id, {score} AS bm25, {" + ".join(f"(tf{i} > 0)::INT" for i in n)} AS matched FROM tf, st WHERE {" OR ".join(f"tf{i} > 0" for i in n)}),
be AS (SELECT id, (max({{'m': matched, 'b': bm25}})).b AS bm25, max(matched) AS matched FROM sc GROUP BY id),
fit AS (SELECT * FROM be WHERE matched = {len(terms)} OR (SELECT max(matched) FROM be) < {len(terms)})
SELECT id, matched, round(bm25, 6) AS bm25 FROM fit ORDER BY fit.bm25 DESC, id LIMIT 50"""


@query("identifier_search", f"{_M}, {_bm25_sql('SELECT id, ' + _NORM.format('content') + ' AS text FROM m', _WORDS, chr(120) + " = '{0}'")}")
def identifier_search(spark, d):
    return channels.identifier_search(memories(spark, d), list(_WORDS)).select("id", "matched", F.round("bm25", 6).alias("bm25"))


_RULES_SQL = ", ".join(
    "list_transform(regexp_extract_all(content, '{}', {}), lambda x: {{'t': trim(x), 'k': '{}'}})".format(p.replace("'", "''"), g, k) for k, p, g in entities.ENTITY_RULES
)
_NAMED = f"""nm AS (SELECT id, created_at, flatten([{_RULES_SQL}]) AS f FROM m), ne AS (SELECT id, created_at, list_filter(f, lambda e: e.t <> '') AS f FROM nm),
un AS (SELECT id, created_at, unnest(f) AS e, generate_subscripts(f, 1) AS i FROM ne),
fi AS (SELECT id, created_at, lower(e.t) AS key, arg_min(e.t, i) AS entity_text, arg_min(e.k, i) AS entity_type, min(i) AS i FROM un GROUP BY ALL),
nd AS (SELECT id AS memory_id, entity_text, entity_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS p FROM fi) WHERE p <= 30)"""


@query("entity_rows", f"{_M}, {_NAMED} SELECT memory_id, entity_text, entity_type FROM nd")
def entity_rows(spark, d):
    return channels.entity_rows(memories(spark, d)).select("memory_id", "entity_text", "entity_type")


@query("entity_search", f"{_M}, {_NAMED}, {_bm25_sql('SELECT memory_id AS id, ' + _NORM.format('entity_text') + ' AS text FROM nd', ('ac', 'o'), "starts_with(x, '{0}')")}")
def entity_search(spark, d):
    return channels.entity_search(channels.entity_rows(memories(spark, d)), ["ac", "o"]).select("id", "matched", F.round("bm25", 6).alias("bm25"))


_CHECKS = " ".join("WHEN regexp_matches(content, '{}') THEN 'secrets'".format(p.replace("'", "''")) for p in text.SECRET_SHAPES.values())
_ABSENT = " OR ".join("regexp_matches(content, '{}')".format(p.replace("'", "''")) for p in text.ABSENCE_CLAIMS)


@query("admission", f"""{_M}, a AS (SELECT id, namespace, type, content, length(regexp_replace(regexp_replace(content, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9]', '', 'g')) AS n FROM m),
e AS (SELECT l.*, t.namespace FROM l JOIN m s ON s.id = source_id JOIN m t ON t.id = target_id WHERE s.namespace = t.namespace),
g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e WHERE source_id <> target_id) GROUP BY 1),
b AS (SELECT namespace, type, substring(content, 1, 48) AS prefix, arg_min(id, (NOT pinned, -importance, -access_count, -coalesce(degree, 0), created_at, id)) AS keeper FROM m LEFT JOIN g USING (id)
  WHERE created_at >= {EPOCH + 900 * HOUR} - 604800000 AND archived_at IS NULL AND content IS NOT NULL AND id NOT IN (SELECT target_id FROM e WHERE link_type = 'supersedes' AND confidence >= 0.8) GROUP BY 1, 2, 3 HAVING count(*) >= 5),
r AS (SELECT id, CASE {_CHECKS} END AS secret, coalesce(n, 0) = 0 OR length(content) > 24000 AS junk, n < 8 AS thin, NOT regexp_matches(content, '\\d|`') AND ({_ABSENT}) AS absent, keeper
  FROM a LEFT JOIN b ON b.namespace = a.namespace AND b.type = a.type AND b.prefix = substring(content, 1, 48)),
f AS (SELECT *, CASE WHEN secret IS NOT NULL THEN 'secrets' WHEN junk THEN 'junk' WHEN keeper IS NOT NULL THEN 'burst' END AS refused, list_filter([CASE WHEN thin THEN 'junk' END, CASE WHEN absent THEN 'negative-result' END], lambda x: x IS NOT NULL) AS w FROM r)
SELECT id, coalesce(refused, w[1]) AS rule, CASE WHEN refused IS NOT NULL THEN 'reject' WHEN len(w) > 0 THEN 'warn' ELSE 'allow' END AS action, CASE WHEN refused = 'burst' THEN keeper END AS existing_id, CASE WHEN refused IS NULL THEN array_to_string(w, '|') ELSE '' END AS warnings FROM f""")
def admission(spark, d):
    m = memories(spark, d)
    out = upkeep.admitted(m, m, links(spark, d), EPOCH + 900 * HOUR)
    return out.select("id", "rule", "action", "existing_id", F.array_join("warnings", "|").alias("warnings"))


@query("query_kinds", "SELECT conv_id, turn, CASE " + " ".join("WHEN regexp_matches(text, '{}') THEN '{}'".format(p, k) for k, p in text.ARCHETYPES.items()) + " ELSE 'semantic' END AS kind FROM conversations")
def query_kinds(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.query_kind(F.col("text")).alias("kind"))


@query("retention_scores", _M + f""", g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM l UNION ALL SELECT target_id FROM l WHERE source_id <> target_id) GROUP BY id)
SELECT id, round(0.4 * importance + 0.2 * least(ln(access_count + 1) / ln(50), 1) + 0.1 * exp(-greatest({NOW} - coalesce(last_accessed, created_at), 0) / 86400000.0::DOUBLE / 30) + 0.15 * least(coalesce(degree, 0) / 8.0::DOUBLE, 1) + 0.15, 6) AS score FROM m LEFT JOIN g USING (id)""")
def retention_scores(spark, d):
    x = memories(spark, d).join(upkeep.degrees(links(spark, d)), "id", "left")
    s = scoring.retention(NOW, F.col("importance"), F.col("access_count"), F.col("last_accessed"), F.col("created_at"), F.coalesce("degree", F.lit(0)), F.lit(0))
    return x.select("id", s.alias("score"))


def _ranked(spark, d):
    return memories(spark, d).join(upkeep.degrees(links(spark, d)).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


# rows of a group one by one, in order of use: each joins the most similar leader so far, or leads
_LCP = "len(list_filter(range(1, least(length(p.content), length(x.content)) + 1), lambda i: p.content[1:i] = x.content[1:i]))"
_NEAR = f"CASE WHEN p.content = x.content THEN 1.0 ELSE {_LCP} / greatest(length(p.content), length(x.content)) END"


@query("lexical_families", _M.replace("WITH", "WITH RECURSIVE", 1) + f""", g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM l UNION ALL SELECT target_id FROM l WHERE source_id <> target_id) GROUP BY id),
p AS (SELECT m.id, coalesce(content, '') AS content, dense_rank() OVER (ORDER BY namespace, type, substring(coalesce(content, ''), 1, 48)) AS grp,
  row_number() OVER (PARTITION BY namespace, type, substring(coalesce(content, ''), 1, 48) ORDER BY pinned DESC, importance DESC, access_count DESC, coalesce(degree, 0) DESC, created_at, m.id) AS n FROM m LEFT JOIN g ON m.id = g.id),
s AS (SELECT p.grp, p.n, x.n AS earlier, {_NEAR} AS near FROM p JOIN p x ON x.grp = p.grp AND x.n < p.n),
k(grp, n, leaders) AS (SELECT DISTINCT grp, 0::BIGINT, []::BIGINT[] FROM p UNION ALL
  SELECT k.grp, k.n + 1, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.grp = k.grp AND s.n = k.n + 1 AND near >= 0.95 AND list_contains(k.leaders, s.earlier)) THEN k.leaders ELSE list_append(k.leaders, k.n + 1) END
  FROM k JOIN p ON p.grp = k.grp AND p.n = k.n + 1),
c AS (SELECT s.grp, s.n, s.earlier, near FROM s JOIN k ON k.grp = s.grp AND k.n = s.n WHERE near >= 0.95 AND list_contains(k.leaders, s.earlier) AND NOT list_contains(k.leaders, s.n)
  UNION ALL SELECT grp, n, n, 1.0 FROM k WHERE list_contains(leaders, n)),
b AS (SELECT grp, n, arg_min(earlier, {{'s': -near, 'e': earlier}}) AS e, max(near) AS near FROM c GROUP BY 1, 2)
SELECT p.id, h.id AS keeper, round(near, 6) AS similarity, count(*) OVER (PARTITION BY h.id) - 1 AS siblings FROM b JOIN p ON p.grp = b.grp AND p.n = b.n JOIN p h ON h.grp = b.grp AND h.n = b.e""")
def lexical_families(spark, d):
    return upkeep.lexical_families(_ranked(spark, d)).select("id", "keeper", F.round("similarity", 6).alias("similarity"), "siblings")


@query("prefix_families", _M + """, g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM l UNION ALL SELECT target_id FROM l WHERE source_id <> target_id) GROUP BY id)
SELECT m.id, first_value(m.id) OVER (w ORDER BY pinned DESC, importance DESC, access_count DESC, coalesce(degree, 0) DESC, created_at, m.id) AS keeper, count(*) OVER (w) - 1 AS siblings
FROM m LEFT JOIN g ON m.id = g.id WINDOW w AS (PARTITION BY namespace, type, substring(coalesce(content, ''), 1, 48))""")
def prefix_families(spark, d):
    return upkeep.lexical_families(_ranked(spark, d), whole_prefix=True).select("id", "keeper", "siblings")


_CURRENT = "cur AS (SELECT m.*, coalesce(g.degree, 0) AS degree, coalesce(g.won, 0) AS won FROM m LEFT JOIN g USING (id) WHERE archived_at IS NULL AND id NOT IN (SELECT target_id FROM l WHERE link_type = 'supersedes' AND confidence >= 0.8))"
_DEGREES = "g AS (SELECT id, count(*) AS degree, sum(w) AS won FROM (SELECT source_id AS id, (link_type = 'supersedes' AND coalesce(confidence >= 0.8, false))::INT AS w FROM l UNION ALL SELECT target_id, 0 FROM l WHERE source_id <> target_id) GROUP BY id)"
_WORTH = f"round(greatest(0, least(1, 0.4 * importance + 0.2 * least(ln(access_count + 1) / ln(50), 1) + 0.1 * exp(-greatest({NOW} - coalesce(last_accessed, created_at), 0) / 86400000.0::DOUBLE / 30) + 0.15 * least(degree / 8, 1) + 0.15)), 6)"
_TRUST_SQL = f"0.5 * importance + 0.3 * least(ln(access_count + 1) / ln(100), 1) + 0.2 * exp(-greatest(({NOW} - created_at) / 86400000.0::DOUBLE, 0) / (30 * greatest(importance + 0.3 * ln(access_count + 1), 0.1)))"


@query("retention_plan", f"""{_M}, {_DEGREES}, {_CURRENT}, f AS (SELECT *, first_value(id) OVER (w ORDER BY pinned DESC, importance DESC, access_count DESC, degree DESC, created_at, id) AS keeper, count(*) OVER (w) - 1 AS siblings, count(*) OVER () AS n, {_WORTH} AS score, {_TRUST_SQL} AS t FROM cur WINDOW w AS (PARTITION BY namespace, type, substring(coalesce(content, ''), 1, 48))),
p AS (SELECT id, CASE WHEN t >= 0.7 THEN 'hot' WHEN t >= 0.3 THEN 'warm' ELSE 'cold' END AS tier, score, CASE WHEN n < 500 THEN 'corpus_too_small' WHEN pinned THEN 'pinned' WHEN id % 17 = 0 THEN 'shareable' WHEN id % 19 = 0 THEN 'promotion' WHEN won > 0 THEN 'adjudication_winner' WHEN t >= 0.7 THEN 'hot_tier' WHEN siblings = 0 OR id = keeper THEN 'non_redundant' WHEN {NOW} - coalesce(last_accessed, created_at) < 14 * 86400000 THEN 'recently_used' WHEN score >= 0.35 THEN 'above_threshold' ELSE 'low_retention' END AS reason FROM f)
SELECT id, tier, reason, round(score, 4) AS score FROM p""")
def retention_plan(spark, d):
    x = links(spark, d)
    rows = visibility.current(_ranked(spark, d), x).withColumn("shareable", F.col("id") % 17 == 0).withColumn("origin", F.when(F.col("id") % 19 == 0, "promotion"))
    plan = upkeep.retention_plan(rows.drop("degree"), x, upkeep.lexical_families(rows, whole_prefix=True), NOW)
    return plan.select("id", "tier", "reason", F.round("score", 4).alias("score"))


@query("adjudicated_links", _M + f""", v AS (SELECT doc_id AS s, doc_id - 7 AS t, CASE doc_id % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'updates' WHEN 2 THEN 'duplicate' ELSE 'unrelated' END AS r, (doc_id % 101) / 100.0::DOUBLE AS c FROM documents WHERE doc_id >= 7),
h AS (SELECT *, CASE r WHEN 'contradicts' THEN 0.8 WHEN 'updates' THEN 0.9 WHEN 'duplicate' THEN 0.95 END::DOUBLE AS lim FROM v), k AS (SELECT s AS source_id, t AS target_id, CASE WHEN c >= lim THEN 'supersedes' ELSE 'conflicts' END AS link_type, c AS confidence FROM h JOIN m ON m.id = t WHERE NOT pinned AND lim IS NOT NULL AND (c >= lim OR c >= 0.4))
SELECT * FROM k WHERE (source_id, target_id, link_type) NOT IN (SELECT (source_id, target_id, link_type) FROM l)""")
def adjudicated_links(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "contradicts").when(F.col("doc_id") % 4 == 1, "updates").when(F.col("doc_id") % 4 == 2, "duplicate").otherwise("unrelated")
    v = table(spark, d, "documents").where("doc_id >= 7").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") - 7).alias("target_id"), kind.alias("relation"), ((F.col("doc_id") % 101) / 100.0).alias("confidence"), F.lit(None).cast("double").alias("similarity"))
    return upkeep.adjudicated(v, memories(spark, d), links(spark, d), NOW).select("source_id", "target_id", "link_type", "confidence")


@query("task_items", "SELECT user_id AS task_id, event_type AS kind, event_id % 5 AS item_id, arg_max(props, event_id) AS text, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY 1, 2, 3")
def task_items(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (F.col("event_id") % 5).alias("item_id"), F.col("props").alias("text"), F.lit(None).cast("string").alias("status"))
    return upkeep.task_state(e).drop("status")


@query("purged_rows", _M.replace("WITH", "WITH RECURSIVE", 1) + ", c(id) AS (SELECT 15::BIGINT UNION SELECT source_id FROM c JOIN l ON l.target_id = c.id) SELECT id FROM m WHERE id NOT IN (SELECT id FROM c)")
def purged_rows(spark, d):
    edges = links(spark, d).select(F.col("target_id").alias("parent"), F.col("source_id").alias("child"))
    return upkeep.purge(memories(spark, d), edges, memories(spark, d).where("id = 15")).select("id")


@query("archive_rows", _M + f""" SELECT id, regexp_replace(regexp_replace(content, '/Users/[^/\\s"''`]+', '~', 'g'), '/home/[^/\\s"''`]+', '~', 'g') AS content FROM m WHERE id % 3 = 0 AND type IN ('fact', 'note') AND archived_at IS NULL AND id NOT IN ({HIDDEN})""")
def archive_rows(spark, d):
    rows, _ = archive.export(memories(spark, d).withColumn("shareable", F.col("id") % 3 == 0), links(spark, d), ["fact", "note"])
    return rows.select("id", "content")


def _units(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    return c.select(F.floor(F.col("conv_id") / 8).alias("query_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), (F.col("turn") * 7 + F.col("conv_id") * 3).alias("rank"), "role", F.length("text").alias("chars"))


_UNITS = "u AS (SELECT floor(conv_id / 8)::BIGINT AS query_id, conv_id AS session_id, turn AS position, turn * 7 + conv_id * 3 AS rank, role, length(text) AS chars, 1.0::DOUBLE / (1 + turn * 7 + conv_id * 3) / greatest(1, length(text)) AS dens FROM conversations WHERE text IS NOT NULL)"
_ORDERS = {
    "rank-greedy": "min(rank) OVER (PARTITION BY query_id, session_id), session_id, position",
    "breadth-first": "row_number() OVER (PARTITION BY query_id, session_id ORDER BY dens DESC, position), dens DESC, rank, position, session_id",
    "statements-first": "CASE WHEN role = 'user' THEN 0 ELSE 1 END, rank, position, session_id",
}


def _order_sql(policy: str) -> str:
    first, rest = _ORDERS[policy].split(", ", 1) if policy == "statements-first" else _ORDERS[policy].rsplit("), ", 1)
    first = first if policy == "statements-first" else first + ")"
    return f"WITH {_UNITS}, o AS (SELECT *, {first} AS lead FROM u) SELECT query_id, session_id, position, row_number() OVER (PARTITION BY query_id ORDER BY lead, {rest}) AS place FROM o"


for _policy in allocation.POLICIES:

    @query(f"allocation_{_policy.replace('-', '_')}", _order_sql(_policy))
    def _allocation(spark, d, policy=_policy):
        return allocation.ordered(_units(spark, d), policy).select("query_id", "session_id", "position", "place")


@query("allocation_bought", f"""WITH RECURSIVE o AS ({_order_sql("rank-greedy").replace("SELECT query_id, session_id, position, row", "SELECT query_id, session_id, position, chars, row")}),
b(query_id, place, used, opened, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, CAST([] AS BIGINT[]), false FROM o
UNION ALL SELECT o.query_id, o.place, CASE WHEN used + cost <= 1500 THEN used + cost ELSE used END, CASE WHEN used + cost <= 1500 AND NOT list_contains(opened, session_id) THEN list_append(opened, session_id) ELSE opened END, used + cost <= 1500
FROM (SELECT b.*, o.place AS p2, o.session_id, o.chars + 1 + CASE WHEN list_contains(opened, o.session_id) THEN 0 ELSE 20 + CASE WHEN len(opened) > 0 THEN 2 ELSE 0 END END AS cost FROM b JOIN o ON o.query_id = b.query_id AND o.place = b.place + 1) x JOIN o ON o.query_id = x.query_id AND o.place = x.p2)
SELECT o.query_id, o.session_id, o.position FROM b JOIN o USING (query_id, place) WHERE b.kept""".replace("x JOIN o", "x JOIN (SELECT query_id, place FROM o) o").replace("WITH RECURSIVE o AS (WITH", "WITH RECURSIVE o AS (WITH"))
def allocation_bought(spark, d):
    return allocation.bought(allocation.ordered(_units(spark, d)), 1500, 20).select("query_id", "session_id", "position")


@query("answer_scores")
def answer_scores(spark, d):
    ensure_on_executors(spark)
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(answers.answer_score("text", "truth", (F.col("turn") % 4 + 1).cast("int")), 6).alias("score"))


@query("canonical_props", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS json, NULL::VARCHAR AS fault FROM events""")
def canonical_props(spark, d):
    ensure_on_executors(spark)
    schema = {"type": "object", "additionalProperties": {}}
    return table(spark, d, "events").select("event_id", json_values.canonical_json("props").alias("json"), json_values.schema_fault(F.col("props"), schema).alias("fault"))


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 4000).cast("int").alias("a"), (F.col("s_suppkey") % 2).alias("b"))
    return evaluation.paired_bootstrap(s)


