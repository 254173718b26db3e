"""Queries of assembled turn memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.operators import turn_assembly
from recallspark.plans.registry import query
from recallspark.sources.tables import EPOCH, HOUR, table

WORDS, HITS, BUDGET = ("the", "and", "in", "er", "la"), 12, 1500

_TURNS = f"t AS (SELECT conv_id AS session_id, turn, role, text, CASE WHEN conv_id % 9 <> 0 THEN {EPOCH} + conv_id * {HOUR} END AS created_at FROM conversations)"
_HITS = "h AS (" + " UNION ALL ".join(
    f"(SELECT {q} AS query_id, session_id, turn, row_number() OVER (ORDER BY (length(text) - length(replace(text, '{w}', ''))) DESC, session_id, turn) - 1 AS rank FROM t WHERE contains(text, '{w}') ORDER BY rank LIMIT {HITS})" for q, w in enumerate(WORDS)
) + ")"
_COVERED = """e AS (SELECT session_id, max(turn) AS last FROM t GROUP BY 1), x AS (SELECT query_id, h.session_id, rank, unnest(range(greatest(turn - 1, 0), least(turn + 1, last) + 1)) AS turn FROM h JOIN e USING (session_id)),
v AS (SELECT query_id, session_id, turn, min(rank) AS rank FROM x GROUP BY 1, 2, 3),
r AS (SELECT query_id, v.session_id, v.turn, rank, created_at, role || ': ' || text AS line, '[' || coalesce(strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H:%M utc'), 'undated') || ']' AS header, min(rank) OVER (PARTITION BY query_id, v.session_id) AS best FROM v JOIN t ON t.session_id = v.session_id AND t.turn = v.turn),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, created_at NULLS LAST, session_id, turn) AS i FROM r)"""
# closed: a group ends with the line before; its length, and two characters after other groups, are then used
_FOLD = f"""f AS (SELECT query_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'g': 0::BIGINT, 'k': -1::BIGINT, 'n': 0::BIGINT, 'm': 0::BIGINT, 'kept': []::BIGINT[]}},
  list({{'u': length(header)::BIGINT, 'g': i::BIGINT, 'k': session_id::BIGINT, 'n': length(line)::BIGINT, 'm': 0::BIGINT, 'kept': []::BIGINT[]}} ORDER BY i)),
  lambda a, x: CASE WHEN (a.u + CASE WHEN a.k <> x.k AND a.m > 0 THEN a.n + CASE WHEN a.g > 0 THEN 2 ELSE 0 END ELSE 0 END) + (CASE WHEN a.k <> x.k THEN x.u ELSE a.n END + 1 + x.n) + CASE WHEN a.g + CASE WHEN a.k <> x.k AND a.m > 0 THEN 1 ELSE 0 END > 0 THEN 2 ELSE 0 END <= {BUDGET}
  THEN {{'u': a.u + CASE WHEN a.k <> x.k AND a.m > 0 THEN a.n + CASE WHEN a.g > 0 THEN 2 ELSE 0 END ELSE 0 END, 'g': a.g + CASE WHEN a.k <> x.k AND a.m > 0 THEN 1 ELSE 0 END, 'k': x.k, 'n': CASE WHEN a.k <> x.k THEN x.u ELSE a.n END + 1 + x.n, 'm': CASE WHEN a.k <> x.k THEN 0 ELSE a.m END + 1, 'kept': list_append(a.kept, x.g)}}
  ELSE {{'u': a.u + CASE WHEN a.k <> x.k AND a.m > 0 THEN a.n + CASE WHEN a.g > 0 THEN 2 ELSE 0 END ELSE 0 END, 'g': a.g + CASE WHEN a.k <> x.k AND a.m > 0 THEN 1 ELSE 0 END, 'k': x.k, 'n': CASE WHEN a.k <> x.k THEN x.u ELSE a.n END, 'm': CASE WHEN a.k <> x.k THEN 0 ELSE a.m END, 'kept': a.kept}} END).kept AS kept FROM n GROUP BY 1),
b AS (SELECT n.query_id, session_id, any_value(created_at) AS created_at, any_value(header) || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM n JOIN f ON f.query_id = n.query_id AND list_contains(f.kept, n.i) GROUP BY 1, 2)"""
_WITH = f"WITH {_TURNS}, {_HITS}, {_COVERED}, {_FOLD}"


def _hits(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text", F.when(F.col("conv_id") % 9 != 0, EPOCH + F.col("conv_id") * HOUR).alias("created_at"))
    best = []
    for q, word in enumerate(WORDS):
        n = F.length("text") - F.length(F.replace(F.col("text"), F.lit(word), F.lit("")))
        top = t.where(F.contains("text", F.lit(word))).orderBy(F.desc(n), "session_id", "turn").limit(HITS).select("session_id", "turn", n.alias("n"))
        best.append(top.select(F.lit(q).alias("query_id"), "session_id", "turn", (F.row_number().over(Window.orderBy(F.desc("n"), "session_id", "turn")) - 1).alias("rank")))  # of one query's hits
    return reduce(lambda a, b: a.union(b), best), t


@query("turn_context", f"{_WITH} SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at NULLS LAST, session_id) AS block, text FROM b")
def turn_context(spark, d):
    hits, turns = _hits(spark, d)
    return turn_assembly.blocks(turn_assembly.assembled_turns(hits, turns, BUDGET))


@query("turn_context_summary", f"""{_WITH}, s AS (SELECT query_id, count(DISTINCT session_id) AS all_sessions FROM v GROUP BY 1)
SELECT query_id, coalesce(sum(length(text) + 2)::BIGINT - 2, 0) AS used_chars, count(text) AS sessions_served, coalesce(sum(turns), 0)::BIGINT AS turns_served, any_value(all_sessions) - count(text) AS skipped_sessions FROM s LEFT JOIN b USING (query_id) GROUP BY 1""")
def turn_context_summary(spark, d):
    hits, turns = _hits(spark, d)
    return turn_assembly.summary(hits, turns, turn_assembly.assembled_turns(hits, turns, BUDGET))
