"""Text functions and searches over the texts of the given tables, whole; SQL computes each anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import entities, text
from recallspark.functions.entities import ENTITY_STOPWORDS
from recallspark.functions.text import ARCHIVE_STOPWORDS
from recallspark.operators import recall, retrieval, visibility
from recallspark.plans.queries import _LEX, _M, _QUERY_VECTOR, _SCOPED_VEC, HIDDEN, TERMS, _english, _vectors
from recallspark.plans.registry import query
from recallspark.sources import readers
from recallspark.sources.tables import links, memories, table

_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("state_keys_of_turns", r"SELECT conv_id, turn, CASE WHEN length(k) BETWEEN 1 AND 200 THEN k END AS key FROM (SELECT conv_id, turn, lower(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS k FROM conversations)")
def state_keys_of_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.state_key(F.col("text")).alias("key"))


@query("archive_tokens_of_turns", rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1), lambda t: length(t) >= 2 AND t NOT IN ({_quoted(ARCHIVE_STOPWORDS)})) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:12], '|') AS words FROM w""")
def archive_tokens_of_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.archive_tokens(F.col("text")), "|").alias("words"))


@query("entity_terms_of_texts", rf"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(w, lambda t: t NOT IN ({_quoted(ENTITY_STOPWORDS)})) AS p FROM a), s AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE w END AS s FROM p), l AS (SELECT doc_id, s, list_filter(s, lambda t: length(t) >= 3) AS l FROM s)
SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(l) > 0 THEN l ELSE s END)), '|') AS terms FROM l""")
def entity_terms_of_texts(spark, d):
    terms = entities.entity_terms(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(terms), "|").alias("terms"))


@query("rare_tokens_of_neighbours", f"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
SELECT a.doc_id, array_to_string(list_sort(list_filter(list_intersect(a.t, b.t), lambda x: length(x) >= 4 AND x NOT IN ('that', 'with', 'dass', 'para'))), '|') AS shared FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def rare_tokens_of_neighbours(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    out = text.shared_rare_tokens(F.col("text"), F.col("other"), ["that", "with", "dass", "para"])
    return a.join(b, "doc_id").select("doc_id", F.array_join(F.array_sort(out), "|").alias("shared"))


@query("scope_mentions_of_texts", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS english, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])ein($|[^A-Za-z0-9_])') AS german FROM documents")
def scope_mentions_of_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.mentions(F.col("text"), "the").alias("english"), text.mentions(F.col("text"), "ein").alias("german"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


@query("answers_in_texts", f"WITH p AS (SELECT doc_id, {_PLAIN.format('text')} AS p FROM documents WHERE lang = 'en') SELECT doc_id, contains(p, 'of that') OR contains(p, 'in it') OR contains(p, 'ed and') AS hit FROM p")
def answers_in_texts(spark, d):
    answers = F.array(F.array(F.lit("Of that!"), F.lit("in the it")), F.array(F.lit("ed, and")))
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", text.exact_match(F.col("text"), answers).alias("hit"))


@query("quoted_terms_of_turns", r"""WITH q AS (SELECT conv_id, turn, regexp_replace(text, '([a-zA-Z]+) ([a-zA-Z]+)', '"\1" "" \2', 'g') AS q FROM conversations),
t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(q, '"((?:[^"]|"")*)"', 1), lambda x: replace(x, '""', '"')), lambda x: x <> '') AS t FROM q)
SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS terms FROM t""")
def quoted_terms_of_turns(spark, d):
    q = F.regexp_replace("text", "([a-zA-Z]+) ([a-zA-Z]+)", '"$1" "" $2')
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.quoted_terms(q), "|").alias("terms"))


@query("line_chunks_whole", """WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), c(doc_id, n, used, k) AS (SELECT doc_id, 1, length(l[1]), 1 FROM s UNION ALL
SELECT c.doc_id, n + 1, CASE WHEN used + 1 + length(l[n + 1]) <= 500 THEN used + 1 + length(l[n + 1]) ELSE length(l[n + 1]) END, CASE WHEN used + 1 + length(l[n + 1]) <= 500 THEN k ELSE k + 1 END FROM c JOIN s ON s.doc_id = c.doc_id WHERE n < len(l))
SELECT c.doc_id, k::BIGINT AS chunk, sha256(string_agg(l[n], chr(10) ORDER BY n)) AS chunk_sha256 FROM c JOIN s ON s.doc_id = c.doc_id GROUP BY 1, 2""")
def line_chunks_whole(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    chunks = docs.select("doc_id", F.posexplode(text.line_chunks(F.col("text"), 500)).alias("i", "c"))
    return chunks.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), F.sha2(F.col("c").cast("binary"), 256).alias("chunk_sha256"))


@query("fact_pool_of_turns", r"SELECT turn AS serial, regexp_extract(l, '^\s*(.*)$', 1) AS fact FROM (SELECT turn, unnest(string_split(text, chr(10))[1:1]) AS l FROM conversations) WHERE regexp_extract(l, '^\s*(.*)$', 1) <> ''")
def fact_pool_of_turns(spark, d):
    """Each turn's first line, numbered, among its other lines."""
    c = table(spark, d, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(". "), "text").alias("context"))
    return readers.fact_pool(c)


_BM = f"{_M}, {_LEX}, h AS (SELECT id, bm25, matched FROM sc WHERE matched = {len(TERMS)} OR (SELECT max(matched) FROM sc) < {len(TERMS)})"


def _matches(spark, d):
    c = retrieval.count_terms(_english(spark, d), list(TERMS))
    rows = c.hits.where(c.matched == c.terms) if c.most == c.terms else c.hits
    return rows.select("id", c.bm25.alias("bm25"))


@query("archive_rank_of_matches", f"{_BM} SELECT m.id, round(bm25 + 0.35 * importance + CASE WHEN type = 'gotcha' OR type = 'procedure' THEN 0.25 ELSE 0 END + CASE WHEN pinned THEN 0.25 ELSE 0 END, 6) AS strength FROM m JOIN h USING (id) ORDER BY bm25 + 0.35 * importance + CASE WHEN type = 'gotcha' OR type = 'procedure' THEN 0.25 ELSE 0 END + CASE WHEN pinned THEN 0.25 ELSE 0 END DESC, created_at DESC, id LIMIT 30")
def archive_rank_of_matches(spark, d):
    hits = memories(spark, d).join(_matches(spark, d), "id")
    return recall.archive_rank(hits, 30).select("id", F.round("strength", 6).alias("strength"))


@query("archive_search_of_matches", f"{_BM}, a AS (SELECT m.id FROM m JOIN h USING (id) WHERE m.id NOT IN ({HIDDEN}) ORDER BY bm25 + 0.35 * importance + CASE WHEN type = 'gotcha' OR type = 'procedure' THEN 0.25 ELSE 0 END + CASE WHEN pinned THEN 0.25 ELSE 0 END DESC, created_at DESC, m.id LIMIT 10) SELECT id FROM a")
def archive_search_of_matches(spark, d):
    near = retrieval.nearest(_vectors(spark, d), _QUERY_VECTOR, 40)
    return recall.archive_search(memories(spark, d), _matches(spark, d), near, visibility.superseded_ids(links(spark, d)))


@query("cue_hits_of_matches", rf"""{_M}, t AS (SELECT id, type, archived_at, content, {_TOKENS.format('content')} AS t FROM m),
a AS (SELECT id, 1 AS k, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM m WHERE contains(content, 'ing the ')), b AS (SELECT id, 2 AS k, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM m WHERE contains(content, 'the ')),
u AS (SELECT id, min({{'k': k, 'place': place}}) AS o FROM (SELECT * FROM (SELECT * FROM a ORDER BY place LIMIT 200) UNION ALL SELECT * FROM (SELECT * FROM b ORDER BY place LIMIT 200)) GROUP BY id)
SELECT m.id, type, CASE WHEN o.k = 1 THEN 'ing the ' ELSE 'the ' END AS matched FROM u JOIN m USING (id) WHERE type IN ('decision', 'gotcha', 'pattern', 'procedure') AND archived_at IS NULL ORDER BY o LIMIT 3""")
def cue_hits_of_matches(spark, d):
    m, lists = memories(spark, d), []
    for name in ("ing the ", "the "):
        top = m.where(F.contains("content", F.lit(name))).orderBy(F.desc("created_at"), "id").limit(200).select("id", "created_at")
        # later memories have smaller places
        lists.append((name, top.select("id", F.struct((-F.col("created_at")).alias("c"), F.col("id").alias("i")).alias("place"))))
    return recall.cue(lists, m)


@query("recall_of_search", f"""{_M}, {_LEX}, {_SCOPED_VEC}, c AS (SELECT coalesce(lex.id, vec.id) AS id, coalesce(relevance, 0) AS fts FROM lex FULL JOIN vec ON lex.id = vec.id),
p AS (SELECT 0 AS query_id, c.id, row_number() OVER (ORDER BY fts DESC, c.id) AS place FROM c JOIN m USING (id) WHERE (visibility IS NULL OR visibility <> 'personal' OR owner = 'u1'))
SELECT query_id::BIGINT AS query_id, id, place FROM p""")
def recall_of_search(spark, d):
    """Candidates of a fused search, served to a caller; no link of the view reaches the bound of near-duplicates here."""
    m = _english(spark, d)
    lists = {"fts": retrieval.lexical_search(m, list(TERMS))}
    near = retrieval.nearest(_vectors(spark, d), _QUERY_VECTOR, 50, m)
    found = retrieval.candidates(lists, near).select(F.lit(0).cast("long").alias("query_id"), "id", F.struct((-F.col("fts")).alias("f"), F.col("id").alias("i")).alias("place"))
    far = links(spark, d).where("similarity < 0.95")
    return recall.channel(found, m, far, 0, caller="u1").select("query_id", "id", F.col("place").cast("long").alias("place"))
