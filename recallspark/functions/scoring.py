"""Ranking, trust and decay scores as Column expressions; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

#: Weights of lexical, vector, recency, access and importance signals by query kind.
SEMANTIC_WEIGHTS = {"fts": 0.2, "vec": 0.35, "recency": 0.15, "access": 0.1, "importance": 0.2}
WEIGHT_PROFILES = {
    "temporal": {"fts": 0.10, "vec": 0.15, "recency": 0.50, "access": 0.10, "importance": 0.15},
    "lookup": {"fts": 0.45, "vec": 0.15, "recency": 0.10, "access": 0.15, "importance": 0.15},
    "semantic": SEMANTIC_WEIGHTS,
    "frequentist": {"fts": 0.10, "vec": 0.15, "recency": 0.10, "access": 0.45, "importance": 0.20},
    "aggregation": SEMANTIC_WEIGHTS,
}


def recency(now: int, created: Column, accessed: Column, importance: Column, access_count: Column, scale_days: float = 365.0) -> Column:
    """Forgetting curve: slower with importance and use."""
    days = F.greatest((F.lit(now) - F.coalesce(accessed, created)) / F.lit(float(DAY_MS)), F.lit(0.0))
    strength = F.greatest(importance + 0.3 * F.log(access_count + 1), F.lit(0.1))
    return F.exp(-days / (scale_days * strength))


def access_prior(access_count: Column) -> Column:
    return F.least(F.log(access_count + 1) / F.log(F.lit(100.0)), F.lit(1.0))


def bm25_relevance(bm25: Column, terms: Column | int) -> Column:
    """Saturates a positive BM25 sum; 0 where it is none."""
    p = bm25 / terms
    return F.when(p.isNull() | F.isnan(p) | (p <= 0), F.lit(0.0)).otherwise(p / (1 + p))


def distance_relevance(distance: Column) -> Column:
    """Cosine of unit vectors at this Euclidean distance, clamped to 0..1."""
    return F.least(F.greatest(1 - distance * distance / 2, F.lit(0.0)), F.lit(1.0))


def scoped_idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def rerank_blend(score: Column, rerank: Column, alpha: float) -> Column:
    """Stretches a reranker's score around one half and mixes it in; rows without one count as neutral."""
    stretched = F.least(F.greatest(0.5 + (F.coalesce(rerank, F.lit(0.5)) - 0.5) * 2, F.lit(0.0)), F.lit(1.0))
    return alpha * stretched + (1 - alpha) * score


def trust(now: int, importance: Column, access_count: Column, created: Column) -> Column:
    age = F.greatest((F.lit(now) - created) / F.lit(float(DAY_MS)), F.lit(0.0))
    strength = F.greatest(importance + 0.3 * F.log(access_count + 1), F.lit(0.1))
    return 0.5 * importance + 0.3 * access_prior(access_count) + 0.2 * F.exp(-age / (30.0 * strength))


def tier(score: Column, pinned: Column) -> Column:
    return F.when(pinned, "pinned").when(score >= 0.7, "hot").when(score >= 0.3, "warm").otherwise("cold")


def digest_share(budget: Column) -> Column:
    """Share of a character budget that a digest may take: 10 % to 1,000, rising to 40 % at 4,000."""
    return F.when(budget <= 1000, 0.1).when(budget >= 4000, 0.4).otherwise(0.1 + 0.3 * (budget - 1000) / 3000.0)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def retention(now: int, importance: Column, access_count: Column, accessed: Column, created: Column, degree: Column, duplicate_claims: Column) -> Column:
    """How much a memory is worth keeping: importance, use, recency, links and uniqueness, to six places."""
    days = F.greatest(F.lit(now) - F.coalesce(accessed, created), F.lit(0)) / F.lit(float(DAY_MS))
    unique = F.when(duplicate_claims == 0, 1.0).when(duplicate_claims == 1, 0.5).otherwise(0.0)
    used = F.least(F.log(access_count + 1) / F.log(F.lit(50.0)), F.lit(1.0))
    score = 0.4 * importance + 0.2 * used + 0.1 * F.exp(-days / 30.0) + 0.15 * F.least(degree / 8.0, F.lit(1.0)) + 0.15 * unique
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6)
