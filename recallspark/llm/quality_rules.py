"""Quality rules: one table of thresholds, compiled into a single Spark projection.

Each rule names a measure of the text and the interval that a kept text must lie in. Measures and
verdicts are built-in expressions only, so that no row leaves the JVM. A text is rejected by the
first rule (in table order) whose measure lies outside its interval.

Defined results: null text counts as empty; empty and blank texts have zero for every measure and
fail the base rule; further columns of the input are ignored, so clashing names do no harm; repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import SPACE_RUN, SPACES

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are this der die und das von zu ist den mit sich des auf ein dem auch "
    "de la le et les des en un du une que est pour qui dans el y los se del las por con no para al lo como"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """A kept text has ``low <= measure <= high``."""

    name: str
    measure: str
    low: float
    high: float


#: Production thresholds. Ratios are of words, of characters or of lines with a word.
RULES = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 25.0),
    Rule("symbols_per_word", "symbols_per_word", 0.0, 0.2),
    Rule("shouting", "upper_ratio", 0.0, 0.5),
    Rule("few_stop_words", "n_stop_words", 1, float("inf")),
    Rule("duplicate_lines", "dup_line_ratio", 0.0, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", 0.0, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", 0.0, 0.3),
    Rule("repeated_words", "repeat_word_ratio", 0.0, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the row itself as ``row``, the counts and ratios that rules refer to."""
    keep = [F.col(id_col).alias("doc_id"), F.struct("*").alias("row")]
    t = F.coalesce(F.col(text_col), F.lit(""))
    compact = F.translate(F.col("t"), SPACES, "")
    a = docs.select(*keep, t.alias("t"))
    a = a.select(
        "doc_id",
        "row",
        F.length(compact).alias("word_chars"),
        F.length("t").alias("n_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        F.filter(F.split("t", SPACE_RUN), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    # windows of three words by hash and place, sorted: equal windows stand side by side
    n = F.size("words")
    windows = F.sort_array(
        F.transform(
            F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
        )
    )
    a = a.select("*", n.alias("n_words"), F.size("lines").alias("n_lines"), windows.alias("ws"))
    twice = F.filter("ws", lambda x, k: (F.get("ws", k - 1)["h"] == x["h"]) | (F.get("ws", k + 1)["h"] == x["h"]))
    a = a.select("*", F.transform(twice, lambda x: x["i"]).alias("hit"))
    covered = F.size(F.array_distinct(F.concat("hit", F.transform("hit", lambda i: i + 1), F.transform("hit", lambda i: i + 2))))
    lower = F.translate  # only A-Z are folded
    upper_az, lower_az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    stop = F.size(F.filter("words", lambda w: lower(w, upper_az, lower_az).isin(STOP_WORDS)))
    a = a.select(
        "doc_id",
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        stop.cast("long").alias("n_stop_words"),
        "n_upper",
        "n_lines",
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis"),
    )
    return a.select(
        "*",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the first rule that the row's measures break, or null."""
    tests = []
    for r in rules:
        outside = F.col(r.measure) < r.low
        if r.high != float("inf"):
            outside = outside | (F.col(r.measure) > r.high)
        tests.append(F.when(outside, F.lit(r.name)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, the first broken rule and the verdict ``kept`` of every row."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measures(docs, id_col, text_col)
        .withColumn("base_failed", base)
        .withColumn("broken_rule", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull())
    )


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that pass all rules.

    A filter would be pushed below the projections, each measure then being computed anew wherever
    the predicate names it. The row mark can't be moved, so it holds the filter above them.
    """
    judged = quality_rules(docs).withColumn("mark", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("mark") >= 0)).select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_cte(source: str, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of a SELECT with op4's columns over ``source`` (doc_id, text)."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = " OR ".join(f"{r.measure} < {r.low}" + ("" if r.high == float("inf") else f" OR {r.measure} > {r.high}") for r in rules) or "false"
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t FROM {source}
), b AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{ws}+'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{ws}+', '', 'g') <> '') AS lines FROM a
), c AS (
  SELECT *, len(words) AS n_words,
         list_transform(range(0, greatest(len(words) - 2, 0)), lambda i: {{'w': words[i+1:i+3], 'i': i}}) AS win FROM b
), e AS (
  SELECT doc_id, u.w AS w, u.i AS i, count(*) OVER (PARTITION BY doc_id, u.w) AS k FROM c, unnest(win) AS x(u)
), f AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM e, (VALUES (0), (1), (2)) AS v(d) WHERE k > 1 GROUP BY doc_id
), g AS (
  SELECT c.doc_id, c.n_words, length(regexp_replace(t, '{ws}+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(f.n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({stop}))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*\x{{2022}}]\s'))) AS n_bullets,
         len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%' || chr(8230))) AS n_ellipsis
  FROM c LEFT JOIN f USING (doc_id)
), h AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbols_per_word,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0.0 END AS bullet_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0.0 END AS ellipsis_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_word_ratio,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM g
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({broken})) AS kept FROM h"""


ORACLE_SQL = oracle_cte("documents")
