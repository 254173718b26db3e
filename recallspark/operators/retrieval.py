"""Lexical, vector and fused retrieval, and context packed into character budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import scoring
from recallspark.functions.text import folded, token_count, tokens
from recallspark.plans.scratch import Scratch

K1, B, CONTENT_WEIGHT, TAG_WEIGHT = 1.2, 0.75, 10.0, 5.0
#: Rows of a scope that a list ranks, and candidates of an unscoped list for each result, at least.
SCOPED_WINDOW, OVER_FETCH, LEAST_FETCH = 2000, 5, 50
#: BM25 for each term below which a list is ranked by coverage.
LEAST_BM25 = 1e-3


def over_fetch(k: int) -> int:
    return max(OVER_FETCH * k, LEAST_FETCH)


@dataclass
class Counted:
    """Rows that hold any of the terms (id, dl, tf0_0, ... by term and field), and the scope's statistics."""

    hits: DataFrame
    terms: int
    weights: tuple[float, ...]
    rows: int
    mean: float
    df: list[int]
    most: int

    def holds(self, term: int) -> Column:
        return F.greatest(*[F.col(f"tf{term}_{j}") for j in range(len(self.weights))], F.lit(0.0)) > 0

    @property
    def matched(self) -> Column:
        return sum((self.holds(i).cast("int") for i in range(self.terms)), F.lit(0))

    def term_bm25(self, term: int) -> Column:
        """Lengths are characters; a field's weight multiplies its counts before saturation."""
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(self.mean or 1.0))
        idf = scoring.scoped_idf(F.lit(float(self.rows)), F.lit(float(self.df[term])))
        tf = [w * F.col(f"tf{term}_{j}") for j, w in enumerate(self.weights)]
        return idf * sum((x * (K1 + 1) / (x + norm) for x in tf), F.lit(0.0))

    @property
    def bm25(self) -> Column:
        return sum((self.term_bm25(i) for i in range(self.terms)), F.lit(0.0))


def count_names(terms: int, fields: int) -> list[str]:
    return [f"tf{i}_{j}" for i in range(terms) for j in range(fields)]


def counted(hits: DataFrame, terms: int, weights: tuple[float, ...], rows: int, mean: float | None, by_key: DataFrame | None = None) -> Counted:
    """Document frequencies of written hits, in one aggregation."""
    c = Counted(hits, terms, weights, rows, float(mean or 0), [], 0)
    each = (hits if by_key is None else by_key).agg(*[F.count_if(c.holds(i)) for i in range(terms)], F.max(c.matched)).first()
    c.df, c.most = [int(x) for x in each[:terms]], int(each[terms] or 0)
    return c


def each_once(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns later filters and projections read and don't compute again."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def count_terms(rows: DataFrame, terms: list[str], fields: dict[str, float] | None = None, prefix: bool = False, phrase: bool = False, key: str = "id") -> Counted:
    """Counts terms in one pass over the texts; the scope is what the caller passes.

    ``fields``: weights of text columns. Only rows with hits are written, and a second pass, over lengths
    alone, counts the scope. With ``phrase`` the terms count once, where they follow each other in a field.
    Document frequencies count keys.
    """
    fields = fields or {"content": CONTENT_WEIGHT}

    def counts_of(text: str) -> list[Column]:
        if phrase:
            joined = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
            return [joined.contains(" " + " ".join(terms) + " ").cast("double")]
        return [token_count(F.col(text), w, prefix).cast("double") for w in terms]

    # rows come out of generators, below which no filter goes: texts and counts are computed once for each row
    rows = each_once(rows.select(F.col(key).alias("id"), *[F.coalesce(F.col(f), F.lit("")).alias(f"x{j}") for j, f in enumerate(fields)]))
    length = sum((F.length(f"x{j}") for j in range(len(fields))), F.lit(0))
    found = rows if phrase else each_once(rows.select("id", length.cast("double").alias("dl"), *[folded(F.col(f"x{j}")).alias(f"x{j}") for j in range(len(fields))]))
    dl = length.cast("double").alias("dl") if phrase else F.col("dl")
    n = 1 if phrase else len(terms)
    names = count_names(n, len(fields))
    found = each_once(found.select("id", dl, *[c.alias(f"tf{i}_{j}") for j in range(len(fields)) for i, c in enumerate(counts_of(f"x{j}"))]))
    found = found.where(F.greatest(*map(F.col, names), F.lit(0.0), F.lit(0.0)) > 0)
    hits = Scratch.of(rows.sparkSession).save(found)
    size, mean = rows.agg(F.count(F.lit(1)), F.avg(length)).first()
    by_key = hits.groupBy("id").agg(*[F.max(c).alias(c) for c in names]) if key != "id" else None
    return counted(hits, n, tuple(fields.values()), size, mean, by_key)


def scoped_bm25(memories: DataFrame, terms: list[str], fields: dict[str, float] | None = None) -> DataFrame:
    """(id, bm25, matched): rows that hold any term, scored by the scope's own statistics."""
    c = count_terms(memories, terms, fields)
    return c.hits.select("id", c.bm25.alias("bm25"), c.matched.alias("matched"))


def relevance(c: Counted, window: int = SCOPED_WINDOW, scoped: bool = True) -> DataFrame:
    """(id, relevance, bm25), at most ``window`` rows: those with all terms; where nothing has all and there are more than two, any.

    Of more rows than the window a scope's shortest count, or without scope the best. Where all idf are at
    their floor, or nothing fits, relevance is the share of terms in whose own window a row lies. Each
    window is a top-k that tasks take before anything is gathered.
    """
    fitting = c.hits
    if c.most == c.terms:
        fitting = fitting.where(c.matched == c.terms)
    elif c.terms <= 2:
        fitting = fitting.limit(0)

    def bounded(rows: DataFrame, score: Column) -> DataFrame:
        order = F.col("dl") if scoped else F.desc("s")
        top = rows.withColumn("s", score).orderBy(order, "id").limit(window)
        return top.where(F.col("dl").isNotNull()).drop("s")  # holds later projections above the limit, so that it stays a top-k

    scored = bounded(fitting, c.bm25).select("id", c.bm25.alias("bm25"))
    top = scored.agg(F.max("bm25")).first()[0] or 0.0
    if top / max(1, c.terms) >= LEAST_BM25:
        return scored.select("id", scoring.bm25_relevance(F.col("bm25"), c.terms).alias("relevance"), "bm25")
    lists = [bounded(c.hits.where(c.holds(i)), c.term_bm25(i)).select("id") for i in range(c.terms)]
    both = lists[0] if lists else c.hits.limit(0).select("id")
    for one in lists[1:]:
        both = both.union(one)
    return both.groupBy("id").agg((F.count(F.lit(1)) / max(1, c.terms)).alias("relevance")).withColumn("bm25", F.lit(None).cast("double"))


def lexical_search(memories: DataFrame, terms: list[str], fields: dict[str, float] | None = None, phrase: bool = False, window: int = SCOPED_WINDOW, scoped: bool = True) -> DataFrame:
    """(id, relevance) of one lexical list."""
    return relevance(count_terms(memories, terms, fields, phrase=phrase), window, scoped).select("id", "relevance")


def nearest(vectors: DataFrame, query: list[float], k: int, scope: DataFrame | None = None) -> DataFrame:
    """(id, distance): the k nearest by Euclidean distance, exactly; ties go to the smaller id.

    The scope's ids are chosen first, so that rows outside never take a place.
    """
    if scope is not None:
        vectors = vectors.join(scope.select("id"), "id", "left_semi")
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", scoring.l2_distance(F.col("embedding"), target).alias("distance")).orderBy("distance", "id").limit(k)


def candidates(lists: dict[str, DataFrame], vector: DataFrame | None) -> DataFrame:
    """(id, fts, vec, place): lexical lists (id, relevance) averaged, and the vector list (id, distance).

    Of each lexical list the best rows count, up to the window of a scope, which tasks cut before ranks are given.
    Lists named ``ident`` or ``entity`` that found nothing don't dilute the others. ``place`` orders
    candidates by the first list that has them and their rank there.
    """
    used = {k: v for k, v in lists.items() if k.split(":")[0] not in ("ident", "entity") or not v.isEmpty()}
    parts = []
    for i, rows in enumerate(used.values()):
        w = Window.orderBy(F.desc("relevance"), "id")
        parts.append(rows.orderBy(F.desc("relevance"), "id").limit(SCOPED_WINDOW).select("id", (F.col("relevance") / max(1, len(used))).alias("fts"), F.lit(0.0).alias("vec"), F.struct(F.lit(i).alias("list"), F.row_number().over(w).alias("rank")).alias("place")))
    if vector is not None:
        w = Window.orderBy("distance", "id")
        parts.append(vector.select("id", F.lit(0.0).alias("fts"), scoring.distance_relevance(F.col("distance")).alias("vec"), F.struct(F.lit(len(used)).alias("list"), F.row_number().over(w).alias("rank")).alias("place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("id").agg(F.sum("fts").alias("fts"), F.max("vec").alias("vec"), F.min("place").alias("place"))


def shared_out(weights: dict[str, float]) -> dict[str, float]:
    """Weights where there are no vectors: theirs goes to the others in proportion."""
    rest = sum(v for k, v in weights.items() if k != "vec")
    return {k: 0.0 if k == "vec" else v * (rest + weights["vec"]) / rest for k, v in weights.items()}


def fuse(memories: DataFrame, lists: dict[str, DataFrame], vector: DataFrame | None, now: int, k: int, kind: str = "semantic", least: float | None = None, rerank: DataFrame | None = None, alpha: float = 0.5, top_n: int = 20) -> DataFrame:
    """The k best candidates: id, score, relevance, the share of each signal, and the reason (the largest).

    Weights follow the query's kind; ties go to the earlier candidate. ``rerank`` (id, rerank) is mixed
    into the ``top_n`` best, all others counting as neutral.
    """
    weights = scoring.WEIGHT_PROFILES[kind]
    if vector is None or vector.isEmpty():
        weights, vector = shared_out(weights), None
    rows = memories.join(candidates(lists, vector), "id")
    signals = {
        "fts": F.col("fts"),
        "vec": F.col("vec"),
        "recency": scoring.recency(now, F.col("created_at"), F.col("last_accessed"), F.col("importance"), F.col("access_count")),
        "access": scoring.access_prior(F.col("access_count")),
        "importance": F.col("importance"),
    }
    rows = rows.select("id", "place", *[(weights[name] * x).alias(f"s_{name}") for name, x in signals.items()])
    total = sum((F.col(f"s_{name}") for name in signals), F.lit(0.0))
    evidence = weights["fts"] + weights["vec"]
    rows = rows.withColumn("score", total).withColumn("relevance", (F.col("s_fts") + F.col("s_vec")) / evidence)
    top = F.greatest(*[F.col(f"s_{name}") for name in signals])
    rows = rows.withColumn("reason", F.coalesce(*[F.when(F.col(f"s_{name}") == top, F.lit(name)) for name in signals]))
    if rerank is not None:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "place"))  # candidates of one query
        near = rows.withColumn("_n", rank).join(rerank.select("id", "rerank"), "id", "left")
        given = F.when(F.col("_n") <= top_n, F.col("rerank"))
        rows = near.withColumn("score", scoring.rerank_blend(F.col("score"), given, alpha)).drop("_n", "rerank")
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "place").limit(k).drop("place")


def pack_within_budget(ranked: DataFrame, budget: int, group: str, order: list[str], length: str = "chars") -> DataFrame:
    """Rows kept within a character budget for each group: greedily in order, passing over what doesn't fit.

    The lists are those of a query's results, bounded by its limit.
    """
    entry = F.struct(*order, F.col(length).alias("chars"), F.col("id").alias("id"))
    lists = ranked.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("kept"))
    fold = F.aggregate("items", start, lambda acc, x: F.when(x["chars"] <= acc["left"], F.struct((acc["left"] - x["chars"]).cast("long").alias("left"), F.concat(acc["kept"], F.array(x["id"].cast("long"))).alias("kept"))).otherwise(acc))
    return lists.select(group, fold.alias("r")).select(group, F.posexplode("r.kept").alias("place", "id"))
