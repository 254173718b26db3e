"""Evaluation runs: scored queries, costs, averages by kind, comparisons of systems and configurations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import scoring
from recallspark.operators import evaluation, visibility
from recallspark.plans.scratch import Scratch

#: lists' lengths that are measured, and questions below which a comparison is thin.
KS, LOW_N = (1, 5, 10), 30


def token_cost(served: DataFrame, group: str = "query_id", text: str = "content") -> DataFrame:
    """Characters, estimated tokens and tokens a character of what each query was served."""
    chars, tokens = F.sum(F.length(text)), F.sum(scoring.token_estimate(F.col(text)))
    return served.groupBy(group).agg(chars.alias("chars"), tokens.alias("tokens"), F.when(chars > 0, tokens / chars).otherwise(0.0).alias("tokens_per_char"))


def scored_queries(queries: DataFrame, ranked: DataFrame, limit: int = 10) -> DataFrame:
    """One row per query: recall, precision and nDCG at each k, reciprocal rank, leaks, stale hits, cost and
    the rank of the latest target, to three places.

    ``queries``: query_id, kind, namespace, targets, forbidden (arrays), latest_target, subtree.
    ``ranked``: query_id, id, rank (from 1), namespace, content.
    """
    hits = ranked.where(F.col("rank") <= limit)
    q = queries.select("query_id", "kind", F.col("namespace").alias("_ns"), "targets", "forbidden", "latest_target", "subtree")
    rows = hits.join(q, "query_id")
    good = F.array_contains("targets", F.col("id"))
    inside = (F.col("namespace") == F.col("_ns")) | (F.col("subtree") & F.col("namespace").startswith(F.concat("_ns", F.lit("/"))))
    stale = F.array_contains("forbidden", F.col("id"))
    gain = 1 / F.log2(F.col("rank") + 1)
    at = lambda c, k: F.when(good & (F.col("rank") <= k), c)
    parts = [F.count(at(F.lit(1), k)).alias(f"_h{k}") for k in KS] + [F.sum(at(gain, k)).alias(f"_g{k}") for k in KS]
    per = rows.groupBy("query_id").agg(
        *parts,
        F.min(at(F.col("rank"), limit)).alias("_first"),
        F.avg((~inside).cast("double")).alias("_leak"),
        F.avg(stale.cast("double")).alias("_stale"),
        F.sum(F.length("content")).alias("served_chars"),
        F.sum(scoring.token_estimate(F.col("content"))).alias("served_tokens"),
        F.min(F.when(F.col("id") == F.col("latest_target"), F.col("rank"))).alias("latest_rank"),
    )
    n = F.size("targets")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = q.join(per, "query_id", "left")
    figures: list[Column] = []
    for k in KS:
        found = F.coalesce(F.col(f"_h{k}"), F.lit(0))
        figures += [F.when(n > 0, F.round(found / n, 3)).otherwise(0.0).alias(f"recall_{k}"), F.round(found / k, 3).alias(f"precision_{k}"), F.when(n > 0, F.round(zero(F.col(f"_g{k}")) / ideal(k), 3)).otherwise(0.0).alias(f"ndcg_{k}")]
    return out.select("query_id", "kind", n.alias("targets"), *figures, F.round(zero(1 / F.col("_first")), 3).alias("mrr"), F.round(zero(F.col("_leak")), 3).alias("leak_rate"), F.round(zero(F.col("_stale")), 3).alias("stale_rate"), F.coalesce("served_chars", F.lit(0)).alias("served_chars"), F.coalesce("served_tokens", F.lit(0)).alias("served_tokens"), "latest_rank")


def averages(details: DataFrame, by: str | None = "kind") -> DataFrame:
    """Means of the figures over queries, overall or by kind, and tokens a character and a query."""
    names = [c for c in details.columns if c.split("_")[0] in ("recall", "precision", "ndcg", "mrr", "leak", "stale")]
    rows = details.groupBy(*([by] if by else []))
    chars, tokens, n = F.sum("served_chars"), F.sum("served_tokens"), F.count(F.lit(1))
    return rows.agg(n.alias("queries"), *[F.round(F.avg(c), 3).alias(c) for c in names], F.round(F.when(chars > 0, tokens / chars).otherwise(0.0), 3).alias("tokens_per_char"), F.round(tokens / n, 3).alias("tokens_per_query"))


def confidence_by_relation(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def candidate_recall(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of labelled pairs (subject, id, relation) that candidates (subject, id) hold, by relation."""
    hit = candidates.select("subject", "id", F.lit(1).alias("_hit")).distinct()
    rows = pairs.join(hit, ["subject", "id"], "left")
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 3).alias("recall"))


def reader_aggregates(rows: DataFrame) -> DataFrame:
    """Accuracy, recall and tokens by reader and question type, and by reader."""
    return rows.groupingSets([("reader",), ("reader", "question_type")], "reader", "question_type").agg(
        F.count(F.lit(1)).alias("questions"), F.count("correct").alias("graded"), F.round(F.avg(F.col("correct").cast("double")), 3).alias("accuracy"), F.round(F.avg("tokens"), 3).alias("tokens"))


def common_questions(rows: DataFrame) -> DataFrame:
    """Questions that every system has a grade for."""
    graded = rows.where("correct IS NOT NULL").select("system", "question_id").distinct()
    systems = graded.select("system").distinct().count()
    return graded.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == systems).select("question_id")


def paired(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(question_id, side): questions of both systems, or of one only."""
    a = rows.where((F.col("system") == left) & F.col("correct").isNotNull()).select("question_id", F.lit(True).alias("l")).distinct()
    b = rows.where((F.col("system") == right) & F.col("correct").isNotNull()).select("question_id", F.lit(True).alias("r")).distinct()
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "only_left").otherwise("only_right")
    return a.join(b, "question_id", "full_outer").select("question_id", side.alias("side"))


def compared(rows: DataFrame, by_type: bool = False) -> DataFrame:
    """Each pair of systems over the questions that all have: accuracies, wins on either side, exact
    McNemar p, its Holm adjustment, and whether the questions are few."""
    scratch = Scratch.of(rows.sparkSession)
    rows = scratch.save(rows.select("system", "question_id", "question_type", "correct"))  # read four times
    common = rows.join(common_questions(rows), "question_id", "left_semi").select("system", "question_id", "question_type", F.col("correct").cast("int").alias("c"))
    key = ["question_type"] if by_type else []
    a = common.select("question_id", *key, F.col("system").alias("left"), F.col("c").alias("cl"))
    b = common.select("question_id", F.col("system").alias("right"), F.col("c").alias("cr"))
    pairs = a.join(b, "question_id").where(F.col("left") < F.col("right"))  # systems are few
    out = pairs.groupBy(*key, "left", "right").agg(F.count(F.lit(1)).alias("n"), F.avg("cl").alias("accuracy_left"), F.avg("cr").alias("accuracy_right"), F.count_if(F.col("cl") > F.col("cr")).alias("only_left"), F.count_if(F.col("cr") > F.col("cl")).alias("only_right"))
    out = out.withColumn("p", evaluation.mcnemar_exact(F.col("only_left"), F.col("only_right"))).withColumn("low_n", F.col("n") < LOW_N)
    out = scratch.save(out)  # few rows, which the adjustment reads as well
    label = F.concat_ws(" vs ", "left", "right") if not by_type else F.concat_ws(" vs ", "left", "right", "question_type")
    adjusted = evaluation.holm(out.select(label.alias("label"), "p")).select("label", "adjusted")
    return out.withColumn("label", label).join(adjusted, "label").drop("label")


def identity_conflicts(rows: DataFrame, fields: list[str], interventions: tuple[str, ...] = ()) -> DataFrame:
    """(system, field, verdict): fields in which a run disagrees with itself, differs from the first system,
    can't be told (null throughout), or differs as an intended intervention."""
    first = rows.agg(F.min("system")).first()[0]
    parts = []
    for f in fields:
        v = rows.groupBy("system").agg(F.count_distinct(f).alias("_n"), F.min(F.col(f).cast("string")).alias("_v"))
        base = v.where(F.col("system") == first).select(F.col("_v").alias("_b"))
        base = base.first()
        want = F.lit(base[0] if base else None)
        differs = F.lit("intervention" if f in interventions else "differs")
        verdict = F.when(F.col("_n") > 1, "disagrees").when(F.col("_n") == 0, "unverified").when(want.isNotNull() & (F.col("_v") != want), differs)
        parts.append(v.select("system", F.lit(f).alias("field"), verdict.alias("verdict")).where("verdict IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def config_deltas(blocks: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Every figure (config, metric, value) against the baseline's, to three places."""
    base = blocks.where(F.col("config") == baseline).select("metric", F.col("value").alias("baseline"))
    rows = blocks.where(F.col("config") != baseline).join(base, "metric")
    return rows.select("config", "metric", "baseline", "value", F.round(F.col("value") - F.col("baseline"), 3).alias("delta"))


def state_accuracy(probes: DataFrame, answers: DataFrame) -> DataFrame:
    """Accuracy by kind of probe (probe_id, kind, expected), share answered, and share of answers that are
    another value of the slot. ``answers``: probe_id, value, other."""
    rows = probes.join(answers, "probe_id", "left")
    right = F.col("value").eqNullSafe(F.col("expected"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg(right.cast("double")), 3).alias("accuracy"), F.round(F.avg(F.col("value").isNotNull().cast("double")), 3).alias("coverage"), F.round(F.avg(F.coalesce(F.col("other"), F.lit(False)).cast("double")), 3).alias("stale_rate"))


def guide_violations(guides: DataFrame, bodies: DataFrame, root: str) -> DataFrame:
    """(namespace, excerpt, violation): guides that quote a memory's body, or lie outside the tree."""
    out = guides.where(~visibility.in_scope(F.col("namespace"), root)).select("namespace", "excerpt", F.lit("out of tree").alias("violation"))
    leak = guides.join(bodies.select(F.col("content").alias("excerpt")).distinct(), "excerpt", "left_semi").select("namespace", "excerpt", F.lit("leak").alias("violation"))
    return out.union(leak)


def continuity(cases: DataFrame) -> DataFrame:
    """A verdict for each case (case_id, arm, family, expected, served, forbidden, used, budget).

    Nothing served where something is due fails, a forbidden id fails, a budget overrun fails; a case
    without expectation passes only if nothing forbidden was served; a case whose budget can't hold the
    answer is excluded.
    """
    missing = F.size(F.array_except("expected", "served"))
    wrong = F.size(F.array_intersect("served", "forbidden"))
    over = F.coalesce(F.col("used") > F.col("budget"), F.lit(False))
    verdict = F.when(F.coalesce("insufficient", F.lit(False)), "excluded").when(F.col("served").isNull(), "failed").when((missing > 0) | (wrong > 0) | over, "failed").otherwise("passed")
    return cases.select("case_id", "arm", "family", verdict.alias("verdict"), missing.alias("missing"), wrong.alias("wrong"))


def continuity_summary(scored: DataFrame) -> DataFrame:
    """Passed over scored cases of every arm, and of every family in it; excluded ones don't count."""
    counts = scored.groupingSets([("arm",), ("arm", "family")], "arm", "family").agg(F.count_if(F.col("verdict") == "passed").alias("passed"), F.count_if(F.col("verdict") != "excluded").alias("scored"), F.count_if(F.col("verdict") == "excluded").alias("excluded"))
    return counts.withColumn("rate", F.when(F.col("scored") > 0, F.round(F.col("passed") / F.col("scored"), 3)))


def overlap_violations(queries: DataFrame, memories: DataFrame, most: int = 0) -> DataFrame:
    """(query_id, id, shared): targets of paraphrase queries that share more words with them than allowed.

    Both tables have ``words`` (array); ``queries`` also has targets."""
    q = queries.select("query_id", F.explode("targets").alias("id"), F.col("words").alias("_q"))
    return q.join(memories.select("id", "words"), "id").select("query_id", "id", F.size(F.array_intersect("_q", "words")).alias("shared")).where(F.col("shared") > most)


def replayed(events: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, seq): the events, numbered from 1, that each probe (probe_id, after_seq) may know of; an
    event after the checkpoint reaches no probe."""
    reach = probes.where("after_seq >= 1").select("probe_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("after_seq").cast("bigint"))).alias("seq"))
    return events.select("seq").join(reach, "seq").select("probe_id", "seq")


def corpus_hash(rows: DataFrame, columns: list[str]) -> str:
    """A digest of all rows that doesn't depend on their order: of the sorted digests of rows in buckets.

    Only one number for each of 4096 buckets reaches the driver."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    bucket = F.substring("h", 1, 3)
    parts = rows.select(digest.alias("h")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30))).alias("s"))
    return hashlib.sha256("\n".join(f"{r.b} {r.n} {r.x} {r.s}" for r in sorted(parts.collect())).encode()).hexdigest()
