"""Retrieval metrics and paired statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall@k, precision@k, reciprocal rank and nDCG@k with binary gains."""
    hits = relevant.join(ranked.where(F.col("rank") <= k), ["query_id", "doc_id"], "left")
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("rank").alias("found"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select(
        "query_id",
        (F.col("found") / F.col("n")).alias("recall"),
        (F.col("found") / k).alias("precision"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


#: ln m! less (m + 1/2) ln m - m + ln sqrt(2 pi), for m from 1 to 15; a series gives what comes after.
_STIRLING = [math.lgamma(m + 1) - ((m + 0.5) * math.log(m) - m + 0.5 * math.log(2 * math.pi)) for m in range(1, 16)]


def _log_share(n: Column, k: Column) -> Column:
    """ln of the binomial (n over k) / 2**n for 0 < k < n, without large parts that cancel out."""

    def rest(m: Column) -> Column:
        x = 1 / m
        series = x * (1 / 12 - x * x * (1 / 360 - x * x * (1 / 1260 - x * x / 1680)))
        return F.coalesce(F.get(F.array(*map(F.lit, _STIRLING)), F.least(m, F.lit(16.0)).cast("int") - 1), series)

    return F.log(n / (2 * math.pi * k * (n - k))) / 2 - k * F.log(2 * k / n) - (n - k) * F.log(2 * (n - k) / n) + rest(n) - rest(k) - rest(n - k)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts: the binomial tail, as multiples of its largest term.

    Terms fall faster than exp(-2 d d / n) with their distance d from it: those left out are 1e-50 of the sum at most,
    which no double can hold beside it. So time grows with the root of the counts, and none with the rows.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    largest = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.exp(_log_share(n, k)))
    near = F.least(k, F.ceil(8 * F.sqrt(n)) + 40).cast("bigint")
    steps = F.when(near >= 1, F.sequence(F.lit(1).cast("bigint"), near)).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, d: Column) -> Column:
        term = acc["term"] * (k - d + 1) / (n - k + d)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * largest * whole, F.lit(1.0)))


def holm(tests: DataFrame) -> DataFrame:
    """(label, p, adjusted): step-down correction over a report's tests."""
    by = Window.orderBy("p", "label")
    m = Window.partitionBy(F.lit(1))
    ranked = tests.select("label", "p", F.row_number().over(by).alias("r"), F.count(F.lit(1)).over(m).alias("m"))
    return ranked.select("label", "p", F.least(F.max((F.col("m") - F.col("r") + 1) * F.col("p")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)).alias("adjusted"))


def frontier(systems: DataFrame) -> DataFrame:
    """Systems that no other beats in accuracy or cost without losing in the other: those of the best
    accuracy at their cost that no cheaper one reaches. Only distinct costs meet in one window."""
    best = systems.groupBy("cost").agg(F.max("accuracy").alias("_best"))
    cheaper = F.max("_best").over(Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    bound = best.select("cost", "_best", cheaper.alias("_cheaper"))
    good = (F.col("accuracy") == F.col("_best")) & (F.col("_cheaper").isNull() | (F.col("_cheaper") < F.col("accuracy")))
    return systems.join(bound, "cost").where(good).select(*systems.columns)


def threshold_sweep(pairs: DataFrame, low: int = 50, high: int = 99) -> DataFrame:
    """Counts and F1 of (confidence, positive) at each hundredth, from one pass and running sums."""
    spark = pairs.sparkSession
    level = F.least(F.floor(F.col("confidence") * 100 + 1e-9), F.lit(high)).cast("int")
    bins = pairs.groupBy(level.alias("t")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    grid = spark.range(0, high + 1).select(F.col("id").cast("int").alias("t"))
    up = Window.orderBy(F.desc("t"))
    total = Window.partitionBy(F.lit(1))
    c = grid.join(bins, "t", "left").select("t", F.sum(F.coalesce("p", F.lit(0))).over(up).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(up).alias("fp"), F.sum(F.coalesce("p", F.lit(0))).over(total).alias("all"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("all") - F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("all") - F.col("tp"))).otherwise(0.0)
    return c.where(F.col("t") >= low).select("t", "tp", "fp", (F.col("all") - F.col("tp")).alias("fn"), f1.alias("f1"))


def stream_seed(seed: int, label: str) -> int:
    """32-bit FNV-1a of ``label:seed``, so that measures don't share a stream."""
    h = 2166136261
    for ch in f"{label}:{seed}":
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def uniform(seed: int, first: int, n: int):
    """Draws ``first`` to ``first + n`` of mulberry32: its state only counts up, so any stretch stands alone."""
    import numpy as np

    mask = np.uint64(0xFFFFFFFF)
    s = (np.uint64(seed) + (np.arange(first + 1, first + n + 1, dtype=np.uint64) & mask) * np.uint64(0x6D2B79F5)) & mask
    t = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & mask
    t = ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask) ^ t
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


def paired_bootstrap(pairs: DataFrame, seed: int = 1, label: str = "delta", resamples: int = 10_000, alpha: float = 0.05, most_pairs: int = 1 << 20) -> DataFrame:
    """(n, delta, ci_low, ci_high) of the mean of a - b over pairs (id, a, b), resampled by pair.

    Resamples are spread over tasks. Pairs are an evaluation's questions; beyond ``most_pairs`` of them
    (8 MB) this raises. Without pairs all figures are 0.
    """
    import numpy as np

    spark = pairs.sparkSession
    rows = pairs.orderBy("id").select(F.col("id"), (F.col("a").cast("double") - F.col("b").cast("double")).alias("d")).limit(most_pairs + 1).toArrow()
    deltas = np.nan_to_num(rows.column("d").to_numpy(zero_copy_only=False).astype(float))
    n = len(deltas)
    if n > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs")
    if n == 0:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "n long, delta double, ci_low double, ci_high double")
    start = stream_seed(seed, label)
    shared = spark.sparkContext.broadcast(deltas)

    def run(batches):
        own = shared.value
        for pdf in batches:
            means = []
            for r in pdf["id"].to_numpy():
                pick = np.minimum(n - 1, np.floor(uniform(start, int(r) * n, n) * n).astype(np.int64))
                means.append(own[pick].sum() / n)
            pdf["m"] = means
            yield pdf[["m"]]

    samples = spark.range(resamples).mapInPandas(run, "m double")
    return samples.agg(F.lit(n).cast("long").alias("n"), F.lit(float(deltas.mean())).alias("delta"), F.percentile("m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high"))
