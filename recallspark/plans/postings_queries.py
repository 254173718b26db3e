"""Queries over the postings table: two weighted columns, batches, best matches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallspark.operators import retrieval, visibility
from recallspark.operators.postings import FIELDS, PostingsIndex
from recallspark.plans.queries import TERMS, WITH
from recallspark.plans.registry import query
from recallspark.plans.scratch import Scratch
from recallspark.sources.tables import memories

_TAGGED = WITH.rstrip() + ", g AS (SELECT *, concat('[\"', type, '\",\"', substring(content, 1, 20), '\"]') AS tags FROM m)"
_TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tagged(spark, d):
    return memories(spark, d).withColumn("tags", F.concat(F.lit('["'), "type", F.lit('","'), F.substring("content", 1, 20), F.lit('"]')))


def _index(docs) -> PostingsIndex:
    return PostingsIndex.create(docs, f"{Scratch.of(docs.sparkSession).root}/postings-{uuid.uuid4().hex}", buckets=8)


def _scores(source: str, terms=TERMS) -> str:
    """SQL of (id, bm25, matched, dl) of ``source`` by the scope's statistics, content weighing 10 and tags 5."""
    counts = ", ".join(f"len(list_filter(t{j}, lambda x: x = '{w}')) AS tf{i}_{j}" for i, w in enumerate(terms) for j in range(2))
    any_ = [f"(tf{i}_0 + tf{i}_1 > 0)" for i in range(len(terms))]
    part = lambda i, j, w: f"{w} * tf{i}_{j} * 2.2 / ({w} * tf{i}_{j} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * ({part(i, 0, 10.0)} + {part(i, 1, 5.0)})" for i in range(len(terms)))
    return f"""tok AS (SELECT id, length(content) + length(tags) AS dl, {_TOKENS.format("content")} AS t0, {_TOKENS.format("tags")} AS t1 FROM {source}),
tf AS (SELECT id, dl, {counts} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER ({a}) AS df{i}" for i, a in enumerate(any_))} FROM tf),
sc AS (SELECT id, dl, {score} AS bm25, {" + ".join(f"{a}::INT" for a in any_)} AS matched FROM tf, st WHERE {" OR ".join(any_)})"""


_SCOPE = "(SELECT * FROM g WHERE starts_with(namespace, '/p/en/'))"
_FREQUENCIES = """SELECT term, count(*) AS df, sum(c0)::BIGINT AS content, sum(c1)::BIGINT AS tags FROM (
SELECT id, term, count(*) FILTER (f = 0) AS c0, count(*) FILTER (f = 1) AS c1 FROM (SELECT id, 0 AS f, unnest({}) AS term FROM {} UNION ALL SELECT id, 1, unnest({}) FROM {}) GROUP BY id, term) GROUP BY term"""


def _frequencies(source: str) -> str:
    return _FREQUENCIES.format(_TOKENS.format("content"), source, _TOKENS.format("tags"), source)


@query("postings_table", f"{_TAGGED} {_frequencies('g')}")
def postings_table(spark, d):
    return _index(tagged(spark, d)).frequencies()


@query("postings_batches", f"""{_TAGGED}, h AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'changed ' || content ELSE content END AS content, tags FROM g WHERE id % 5 <> 0) {_frequencies('h')}""")
def postings_batches(spark, d):
    """Half of the documents, then the others and changes of some, then deletions; merged at the end."""
    docs = tagged(spark, d).select("id", "content", "tags")
    index = _index(docs.where("id % 2 = 0"))
    changed = docs.withColumn("content", F.when(F.col("id") % 7 == 0, F.concat(F.lit("changed "), "content")).otherwise(F.col("content")))
    index.add(changed.where("id % 2 = 1 or id % 7 = 0"), docs.where("id % 10 = 0"))
    index.add(docs.limit(0), docs.where("id % 5 = 0"))
    index.compact()
    return index.frequencies()


@query("bm25_two_columns", f"{_TAGGED}, {_scores(_SCOPE)} SELECT id, round(bm25, 6) AS bm25, matched FROM sc")
def bm25_two_columns(spark, d):
    m = tagged(spark, d)
    c = _index(m).count(list(TERMS), m.where(visibility.in_scope(F.col("namespace"), "/p/en")))
    return c.hits.select("id", F.round(c.bm25, 6).alias("bm25"), c.matched.alias("matched"))


@query("lexical_two_columns", f"""{_TAGGED}, {_scores(_SCOPE)}, fit AS (SELECT * FROM sc WHERE matched = {len(TERMS)} OR (SELECT max(matched) FROM sc) < {len(TERMS)} ORDER BY dl, id LIMIT {retrieval.SCOPED_WINDOW})
SELECT id, round((bm25 / {len(TERMS)}) / (1 + bm25 / {len(TERMS)}), 6) AS relevance FROM fit WHERE (SELECT max(bm25) FROM fit) / {len(TERMS)} >= {retrieval.LEAST_BM25}""")
def lexical_two_columns(spark, d):
    m = tagged(spark, d).where(visibility.in_scope(F.col("namespace"), "/p/en"))
    out = retrieval.lexical_search(m, list(TERMS), FIELDS)
    return out.select("id", F.round("relevance", 6).alias("relevance"))


@query("best_matches", f"{_TAGGED}, {_scores('g', ('ention', 'thand', 'gotcha'))} SELECT id, round(bm25, 6) AS bm25 FROM sc ORDER BY sc.bm25 DESC, id LIMIT 50")
def best_matches(spark, d):
    index = _index(tagged(spark, d))
    return index.best(["ention", "thand", "gotcha"], 50).select("id", F.round("bm25", 6).alias("bm25"))
