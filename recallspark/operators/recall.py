"""From ranked candidates to a served context: trust, near-duplicates, reasons, digest, topics, sections.

Lists are a query's candidates, bounded by its limit; several queries are handled at once by ``group``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import scoring
from recallspark.operators import visibility
from recallspark.operators.digests import cut_lines

#: Similarity of near-duplicates, characters below which a cut memory, topic or item is dropped.
NEAR_DUPLICATE, LEAST_MEMORY, LEAST_TOPIC, LEAST_ITEM = 0.95, 16, 24, 16

#: Sections, their shares and limits, of the named recipes.
RECIPES = {
    "default": {"sections": {"memories": (0.6, 10), "summaries": (0.4, 8)}, "carry": False},
    "session-priming": {"sections": {"working": (0.3, 2), "state": (0.2, 5), "summaries": (0.25, 6), "memories": (0.25, 6)}, "carry": False},
    "qa": {"sections": {"evidence": (0.9, 12), "memories": (0.1, 12), "summaries": (0.0, 4)}, "carry": True},
}


def first_of_each(rows: DataFrame, group: str = "query_id") -> DataFrame:
    """Each id once in a query, at its first place."""
    w = Window.partitionBy(group, "id").orderBy("place")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trusted(rows: DataFrame, now: int, least: float) -> DataFrame:
    """Rows whose trust reaches the floor; pinned ones always do."""
    trust = scoring.trust(now, F.col("importance"), F.col("access_count"), F.col("created_at"))
    return rows.where(F.col("pinned") | (trust >= least)) if least > 0 else rows


def without_near_duplicates(ranked: DataFrame, links: DataFrame, group: str = "query_id") -> DataFrame:
    """Rows that have no link of at least 0.95 to a kept row before them, decided from the first place on."""
    close = links.where(F.col("similarity") >= NEAR_DUPLICATE)
    both = close.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(close.select("target_id", "source_id")).distinct()
    inside = ranked.select(group, "id", "place").join(both, "id").join(ranked.select(group, F.col("id").alias("other"), F.col("place").alias("_p")), [group, "other"])
    before = inside.where("_p < place").groupBy(group, "id").agg(F.collect_set("other").alias("before"))
    rows = ranked.select(group, "id", "place").join(before, [group, "id"], "left")
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "id", F.coalesce("before", F.array().cast("array<long>")).alias("before")))).alias("l"))
    keep = F.aggregate("l", F.array().cast("array<long>"), lambda kept, x: F.when(F.arrays_overlap(kept, x["before"]), kept).otherwise(F.concat(kept, F.array(x["id"].cast("long")))))
    return ranked.join(lists.select(group, F.explode(keep).alias("id")), [group, "id"])


def with_counts(rows: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """Adds tier, what each row supersedes and is superseded by, its conflicts, and whether it is disputed."""
    sure = links.where("link_type = 'supersedes' AND confidence >= 0.8")
    conflict = links.where("link_type = 'conflicts'")
    out = sure.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("supersedes"))
    into = sure.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("superseded_by"))
    both = conflict.select(F.col("source_id").alias("id")).union(conflict.select("target_id")).groupBy("id").agg(F.count(F.lit(1)).alias("conflicts"))
    joined = rows.join(out, "id", "left").join(into, "id", "left").join(both, "id", "left").fillna(0, ["supersedes", "superseded_by", "conflicts"])
    trust = scoring.trust(now, F.col("importance"), F.col("access_count"), F.col("created_at"))
    return joined.withColumn("tier", scoring.tier(trust, F.col("pinned"))).withColumn("disputed", F.col("conflicts") > 0)


def stamped(hits: DataFrame, at: int, mode: str = "explicit", touch: bool | None = None) -> DataFrame:
    """Access events (id, at, uses) that a read leaves: by policy for every read, or only where it asks;
    ``off`` leaves none. Uses of a memory are its events' sum."""
    allowed = mode != "off" and (touch is True or (touch is not False and mode == "retrieval"))
    return hits.groupBy("id").agg(F.lit(at).alias("at"), F.count(F.lit(1)).alias("uses")).where(F.lit(allowed))


def digest_reserve(budget: Column, length: Column) -> Column:
    return F.least(length, F.floor(budget * scoring.digest_share(budget)).cast("int"))


def _fold(items: Column, room: Column, least: int, kind: str) -> Column:
    """(left, kept: place and characters) of items bought in order; one that doesn't fit is cut to the room
    left where that is enough, and else passed over."""
    start = F.struct(room.cast("int").alias("left"), F.array().cast("array<struct<place:int,chars:int>>").alias("kept"))

    def buy(acc: Column, x: Column) -> Column:
        take = lambda n: F.struct((acc["left"] - n).cast("int").alias("left"), F.concat(acc["kept"], F.array(F.struct(x["place"].alias("place"), n.cast("int").alias("chars")))).alias("kept"))
        enough = (acc["left"] > least) if kind == "memory" else ((acc["left"] - 1 >= least) & (x["chars"] > 0))
        return F.when(x["chars"] <= acc["left"], take(x["chars"])).when(enough, take(acc["left"])).otherwise(acc)

    return F.aggregate(items, start, buy)


def packed(budgets: DataFrame, memories: DataFrame, topics: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, digest_chars, memories, topics, used): what a budget serves of digest, memories and topics.

    ``budgets``: group, budget, digest (null: none). Both lists: group, place, chars. The digest takes at
    most its share, and one more character where it is cut; memories are cut where over 16 characters are
    left, topics where over 24 are.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("chars").cast("int").alias("chars"))))
    m, t = memories.groupBy(group).agg(items.alias("_m")), topics.groupBy(group).agg(items.alias("_t"))
    none = F.array().cast("array<struct<place:int,chars:int>>")
    rows = budgets.join(m, group, "left").join(t, group, "left")
    whole = F.coalesce(F.length("digest"), F.lit(0))
    reserve = digest_reserve(F.col("budget"), whole)
    rows = rows.withColumn("digest_chars", F.when(whole > reserve, reserve + 1).otherwise(whole))
    rows = rows.withColumn("_a", _fold(F.coalesce("_m", none), F.col("budget") - F.col("digest_chars"), LEAST_MEMORY, "memory"))
    rows = rows.withColumn("_b", _fold(F.coalesce("_t", none), F.col("_a.left"), LEAST_TOPIC, "topic"))
    used = F.col("budget") - F.col("_b.left")
    return rows.select(group, "digest_chars", F.col("_a.kept").alias("memories"), F.col("_b.kept").alias("topics"), used.alias("used"))


def assembled(items: DataFrame, budget: int, recipe: str = "default", quotas: dict[str, tuple[float, int]] | None = None, group: str = "query_id") -> DataFrame:
    """(group, kind, place, id, chars): a recipe's sections, bought in order within their shares.

    ``items``: group, kind, place, id, chars. An item of an earlier section isn't bought again; where
    one doesn't fit it is cut to the room left, if that is over 16 characters. Where the recipe carries,
    unused room goes to later sections and then back, in order, to those that dropped or cut something.
    """
    spec = RECIPES[recipe]["sections"] | {k: v for k, v in (quotas or {}).items() if k in RECIPES[recipe]["sections"]}
    carry = RECIPES[recipe]["carry"]
    kind = dict(items.dtypes)["id"]
    entry = f"array<struct<place:int,id:{kind},chars:int>>"
    own = items.groupBy(group)
    lists = own.agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("place").cast("int").alias("place"), "id", F.col("chars").cast("int").alias("chars"))))).alias(f"i_{k}") for k in spec])

    def pack(rows: Column, limit: int, room: Column, served: Column) -> Column:
        fresh = F.filter(F.slice(rows, F.lit(1), F.lit(limit)) if limit > 0 else F.array().cast(entry), lambda x: ~F.array_contains(served, x["id"]))
        start = F.struct(room.cast("int").alias("left"), F.array().cast(entry).alias("kept"), F.lit(False).alias("cut"))

        def buy(acc: Column, x: Column) -> Column:
            take = lambda n, cut: F.struct((acc["left"] - n).cast("int").alias("left"), F.concat(acc["kept"], F.array(F.struct(x["place"].alias("place"), x["id"].alias("id"), n.cast("int").alias("chars")))).alias("kept"), cut.alias("cut"))
            again = F.exists(acc["kept"], lambda k: k["id"] == x["id"])
            return F.when(again, acc).when(x["chars"] <= acc["left"], take(x["chars"], acc["cut"])).when(acc["left"] > LEAST_ITEM, take(acc["left"], F.lit(True))).otherwise(F.struct(acc["left"].alias("left"), acc["kept"].alias("kept"), F.lit(True).alias("cut")))

        return F.aggregate(fresh, start, buy)

    ids = lambda c: F.transform(c, lambda x: x["id"])
    out = lists.withColumn("_served", F.array().cast(f"array<{kind}>")).withColumn("_used", F.lit(0)).withColumn("_allotted", F.lit(0))
    for k, (share, limit) in spec.items():
        own_share = int(budget * share)
        room = F.least(F.lit(own_share) + (F.greatest(F.col("_allotted") - F.col("_used"), F.lit(0)) if carry else F.lit(0)), F.lit(budget) - F.col("_used"))
        out = out.withColumn("_room", room).withColumn("_p", pack(F.col(f"i_{k}"), limit, F.col("_room"), F.col("_served")))
        # over the limit counts as dropped
        out = out.withColumn(f"k_{k}", F.col("_p.kept")).withColumn(f"c_{k}", F.col("_p.cut") | (F.size(f"i_{k}") > limit)).withColumn(f"u_{k}", F.col("_room") - F.col("_p.left"))
        out = out.withColumn("_served", F.concat("_served", ids(F.col("_p.kept")))).withColumn("_used", F.col("_used") + F.col(f"u_{k}")).withColumn("_allotted", F.col("_allotted") + own_share)
    if carry:
        for k, (_, limit) in spec.items():
            others = F.flatten(F.array(*[ids(F.col(f"k_{o}")) for o in spec if o != k])) if len(spec) > 1 else F.array().cast(f"array<{kind}>")
            room = F.col(f"u_{k}") + F.lit(budget) - F.col("_used")
            out = out.withColumn("_room", room).withColumn("_p", pack(F.col(f"i_{k}"), limit, F.col("_room"), others))
            better = F.col(f"c_{k}") & (F.col("_room") - F.col("_p.left") > F.col(f"u_{k}"))
            out = out.withColumn("_n", F.when(better, F.col("_room") - F.col("_p.left")).otherwise(F.col(f"u_{k}"))).withColumn(f"k_{k}", F.when(better, F.col("_p.kept")).otherwise(F.col(f"k_{k}")))
            out = out.withColumn("_used", F.col("_used") + F.col("_n") - F.col(f"u_{k}")).withColumn(f"u_{k}", F.col("_n"))

    def named(k: str) -> Column:
        return F.transform(f"k_{k}", lambda x: F.struct(F.lit(k).alias("kind"), x["place"].alias("place"), x["id"].alias("id"), x["chars"].alias("chars")))

    parts = F.flatten(F.array(*map(named, spec)))
    return out.select(group, F.explode(parts).alias("x")).select(group, "x.*")


def funnel(hits: DataFrame, ancestors: DataFrame, least_hits: int = 3, least_score: float = 0.35) -> DataFrame:
    """(namespace, depth, hits, top_score, action): a leaf search and what its ancestors are used for.

    ``hits``: namespace, score of the leaf. ``ancestors``: path, depth, readable. A rich leaf skips them;
    else those that may be read guide, deepest first; the others are withheld.
    """
    s = hits.agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_top")).withColumn("_top", F.least(F.greatest("_top", F.lit(0.0)), F.lit(1.0)))
    n, top = s.first()
    rich = n >= least_hits and (top or 0.0) >= least_score
    action = F.when(~F.col("readable"), "withheld").otherwise(F.lit("skipped" if rich else "guide_only"))
    return ancestors.select(F.col("path").alias("namespace"), "depth", action.alias("action")).orderBy(F.desc("depth"))


def guide_excerpts(sources: DataFrame, tokens: list[str], most: int = 2, chars: int = 240) -> DataFrame:
    """(namespace, kind, excerpt): at most two excerpts of each scope around the earliest token, digest first.

    ``sources``: namespace, kind ('digest' or 'cluster'), place, text.
    """
    low = F.lower("text")
    at = F.array_min(F.filter(F.array(*[F.locate(t, low) for t in tokens]), lambda x: x > 0))
    rows = sources.withColumn("_at", at).where("_at IS NOT NULL")
    start = F.greatest(F.col("_at") - chars // 2, F.lit(1))
    rows = rows.withColumn("excerpt", F.col("text").substr(start, F.lit(chars)))
    w = Window.partitionBy("namespace").orderBy(F.when(F.col("kind") == "digest", 0).otherwise(1), "place")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("namespace", "kind", "excerpt")


def cue_identifiers(path: str, namespace: str) -> list[str]:
    """The path as given, relative to the namespace, and its last part; most specific first."""
    full, prefix = path.strip(), namespace.rstrip("/")
    parts = [full, full[len(prefix) + 1 :] if prefix and full.startswith(prefix + "/") else "", full.rsplit("/", 1)[-1]]
    return list(dict.fromkeys(p for p in parts if p))


def cue(lists: list[tuple[str, DataFrame]], memories: DataFrame, types: tuple[str, ...] = ("decision", "gotcha", "pattern", "procedure"), k: int = 3) -> DataFrame:
    """(id, type, matched): memories of the telling types that identifiers find, the most specific first.

    ``lists``: (identifier, (id, place)) from identifier and entity searches, in order.
    """
    out = None
    for i, (name, rows) in enumerate(lists):
        own = rows.select("id", F.struct(F.lit(i).alias("list"), F.col("place").alias("rank")).alias("order"), F.lit(name).alias("matched"))
        out = own if out is None else out.union(own)
    best = out.groupBy("id").agg(F.min(F.struct("order", "matched")).alias("b"))
    live = memories.where(F.col("type").isin(*types) & F.col("archived_at").isNull())
    return live.join(best, "id").orderBy("b.order").limit(k).select("id", "type", F.col("b.matched").alias("matched"))


def archive_rank(hits: DataFrame, k: int = 10) -> DataFrame:
    """The k best of an archive's hits (memories with bm25): strength of the match, with small boosts for
    importance, telling types and pins; newer first among equals."""
    boost = 0.35 * F.coalesce("importance", F.lit(0.5)) + F.when(F.col("type").isin("decision", "pattern", "gotcha", "procedure"), 0.25).otherwise(0.0) + F.when(F.col("pinned"), 0.25).otherwise(0.0)
    return hits.withColumn("strength", F.col("bm25") + boost).orderBy(F.desc("strength"), F.desc("created_at"), "id").limit(k)


def archive_search(memories: DataFrame, lexical: DataFrame, vector: DataFrame, hidden: DataFrame, k: int = 10, least_cosine: float = 0.6) -> DataFrame:
    """(id): lexical hits by ``archive_rank``; where there are none, the nearest vectors that are close
    enough; superseded rows never. ``lexical``: id, bm25. ``vector``: id, distance."""
    live = memories.join(hidden, "id", "left_anti")
    found = archive_rank(live.join(lexical, "id"), k).select("id")
    if not found.isEmpty():
        return found
    near = vector.where(1 - F.col("distance") * F.col("distance") / 2 >= least_cosine).orderBy("distance", "id").limit(k)
    return live.select("id").join(near.select("id"), "id", "left_semi")


def channel(ranked: DataFrame, memories: DataFrame, links: DataFrame, now: int, scope: str | None = None, caller: str | None = None, least_trust: float = 0.0, group: str = "query_id") -> DataFrame:
    """Ranked candidates (group, id, place and what else the search says) as they are served.

    Rows that the caller may not read are dropped here once more, whatever found them; each id counts
    once; rows below the trust floor go before near-duplicates do, so that a trusted sibling of an
    untrusted row stays; what is left gets its tier and its counts, and a new place without gaps.
    """
    own = visibility.visible_to(caller, F.col("visibility"), F.col("owner"))
    if scope is not None:
        own = own & visibility.in_scope(F.col("namespace"), scope, subtree=False)
    found = ranked.select(group, "id", "place", *[c for c in ("score", "relevance", "reason") if c in ranked.columns])
    rows = first_of_each(found, group).join(memories.where(own), "id")
    kept = with_counts(without_near_duplicates(trusted(rows, now, least_trust), links, group), links, now)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("place")))


def dropped(ranked: DataFrame, served: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, candidates, served) of every query."""
    a = ranked.groupBy(group).agg(F.count_distinct("id").alias("candidates"))
    b = served.groupBy(group).agg(F.count(F.lit(1)).alias("served"))
    return a.join(b, group, "left").fillna(0, ["served"])


def full_context(turns: DataFrame, budget: int, group: str = "session_id") -> DataFrame:
    """Turns (group, place, content) from the first on, as long as all of them fit, lines and all."""
    w = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("content") + 1).over(w) - 1
    return turns.withColumn("used", used).where(F.col("used") <= budget)


def briefs(items: DataFrame, budget: int) -> DataFrame:
    """(task_id, brief): open items of every task, by kind and age, cut to a budget with a note of the rest.

    ``items``: task_id, kind, first_seq, text, status (null: open). A task's items are few.
    """
    line = F.concat(F.lit("- ["), F.col("kind"), F.lit("] "), F.col("text"))
    rows = items.where("status IS NULL").groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("kind", "first_seq", line.alias("line")))).alias("l"))
    return rows.select("task_id", cut_lines(F.transform("l", lambda x: x["line"]), budget).alias("brief"))
