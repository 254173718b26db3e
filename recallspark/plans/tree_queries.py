"""The query of tree consolidation: a fold over the levels of the scope tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import digests, reports
from recallspark.plans.queries import _M
from recallspark.plans.recall_queries import _KEEP, _LINES
from recallspark.plans.registry import query
from recallspark.sources.tables import memories

_FITS = "list_reduce(list_prepend({'used': 0, 'kept': 0, 'full': false}, list_transform(l, lambda x: {'used': length(x), 'kept': 0, 'full': false})), lambda a, x: CASE WHEN a.full OR a.used + x.used + CASE WHEN a.kept > 0 THEN 1 ELSE 0 END + 24 > 1200 THEN {'used': a.used, 'kept': a.kept, 'full': true} ELSE {'used': a.used + x.used + CASE WHEN a.kept > 0 THEN 1 ELSE 0 END, 'kept': a.kept + 1, 'full': false} END).kept"
_TRIMMED = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _level(depth: int) -> str:
    """CTEs of the digests of one level, from the source lines and the digests of the level below."""
    told = f"""UNION ALL SELECT parent, 3, n, CASE WHEN len(t) = 0 THEN ['[child ' || path || '] (no digest yet)'] ELSE list_concat(['[child ' || path || '] ' || t[1]], list_transform(t[2:], lambda x: '  ' || x)) END
FROM (SELECT c.parent, c.path, c.n, {_TRIMMED.format("d.digest")} AS t FROM c JOIN d{depth + 1} d USING (path))"""
    return f"""s{depth} AS (SELECT * FROM o {told if depth < 3 else ""}), g{depth} AS (SELECT path, flatten(list(lines ORDER BY kind, n)) AS l FROM s{depth} GROUP BY 1),
k{depth} AS (SELECT path, l, array_to_string(l, chr(10)) AS w, {_FITS} AS k FROM g{depth}),
d{depth} AS (SELECT t.path, t.depth, coalesce(CASE WHEN length(w) <= 1200 THEN w WHEN k = 0 THEN substr(l[1], 1, 1199) || '…' ELSE substr(array_to_string(l[1:k], chr(10)) || chr(10) || '…(' || (len(l) - k) || ' more)', 1, 1200) END, '') AS digest FROM t LEFT JOIN k{depth} USING (path) WHERE t.depth = {depth})"""


@query("consolidated_digests", f"""{_M}, {_LINES}, q AS (SELECT namespace, l, array_to_string(l, chr(10)) AS w, {_KEEP} AS k FROM p),
pd AS (SELECT namespace, CASE WHEN length(w) <= 2000 THEN w ELSE substr(array_to_string(l[1:k], chr(10)) || chr(10) || '…(' || (len(l) - k) || ' more)', 1, 2000) END AS content FROM q),
t AS (SELECT DISTINCT unnest(['/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1), namespace]) AS path, unnest([NULL, '/p', regexp_extract(namespace, '^(/p/[a-z]+)', 1)]) AS parent, unnest([1, 2, 3]) AS depth FROM m),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY path) AS n FROM t WHERE parent IS NOT NULL) WHERE n <= 8),
o AS (SELECT namespace AS path, 0 AS kind, 1 AS n, {_TRIMMED.format("content")} AS lines FROM pd
UNION ALL SELECT namespace, 1, n, ['[topic] ' || s] FROM (SELECT namespace, trim(substring(content, 1, 60), ' ') AS s, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id) AS n FROM m WHERE id % 17 = 0 AND trim(substring(content, 1, 60), ' ') <> '') WHERE n <= 5
UNION ALL SELECT namespace, 2, n, ['[pattern] ' || substring(trim(string_split(content, chr(10))[1], ' '), 1, 160)] FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, created_at DESC, id) AS n FROM m WHERE id % 29 = 0) WHERE n <= 4),
{_level(3)}, {_level(2)}, {_level(1)} SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3""")
def consolidated_digests(spark, d):
    m = memories(spark, d).withColumn("origin", F.when(F.col("id") % 29 == 0, "promotion"))
    topics = m.where("id % 17 = 0").select("namespace", F.substring("content", 1, 60).alias("summary"), F.col("created_at").alias("updated_at"), "id")
    return digests.consolidated(m, topics, reports.namespace_nodes(m), "/p").select("path", F.col("depth").cast("long").alias("depth"), "digest")
