"""Walks and ranks over memory links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.components import connected_components
from recallspark.operators.vector_join import nearest_many
from recallspark.operators.visibility import valid_at
from recallspark.plans.scratch import Scratch


def neighbours(links: DataFrame, start: int, k: int) -> DataFrame:
    """One hop in either direction, most similar first; the limit counts edges, then nodes are single."""
    out = links.where(F.col("source_id") == start).select(F.col("target_id").alias("id"), "similarity", "link_type")
    back = links.where(F.col("target_id") == start).select(F.col("source_id").alias("id"), "similarity", "link_type")
    edges = out.union(back).orderBy(F.desc("similarity"), "id", "link_type").limit(k)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "link_type")
    return edges.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def auto_links(vectors: DataFrame, fresh: DataFrame, k: int = 20, below: float = 0.837) -> DataFrame:
    """(source_id, target_id, similarity): semantic links in both directions between fresh vectors and their
    at most k nearest ones that are close enough. Both tables are (id, embedding)."""
    near = nearest_many(vectors, fresh, k, below)
    similarity = F.greatest(1 - F.col("distance") * F.col("distance") / 2, F.lit(0.0)).alias("similarity")
    ways = F.explode(F.array(F.struct(F.col("query_id").alias("s"), F.col("id").alias("t")), F.struct(F.col("id").alias("s"), F.col("query_id").alias("t")))).alias("w")
    return near.select(ways, similarity).select(F.col("w.s").alias("source_id"), F.col("w.t").alias("target_id"), "similarity").dropDuplicates(["source_id", "target_id"])


def _both_ways(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) in both directions, the best of each pair; both ends are among ``nodes`` if given."""
    both = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "similarity").union(links.select("target_id", "source_id", "similarity"))
    if nodes is not None:
        ids = nodes.select(F.col("id").alias("a"))
        both = both.join(ids, "a", "left_semi").join(ids.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b", "similarity")
    return both.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def walk(links: DataFrame, start: int, depth: int = 2, nodes: DataFrame | None = None, shown: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(id, hops, similarity): nodes within reach over either direction, by fewest hops, then best edge.

    The walk stays among ``nodes`` (those in scope); only those of ``shown`` (valid, not superseded) are
    returned, but it may pass through others.
    """
    spark, scratch = links.sparkSession, Scratch.of(links.sparkSession)
    both = scratch.save(_both_ways(links, nodes))
    seen = spark.createDataFrame([(start, 0, None)], "id long, hops int, similarity double")
    if nodes is not None:
        seen = seen.join(nodes.select("id"), "id", "left_semi")
    edge = seen
    for hop in range(1, depth + 1):
        reach = edge.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.max("similarity").alias("similarity"))
        edge = scratch.save(reach.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "similarity"))
        seen = seen.union(edge)
    out = seen.where("hops > 0")
    if shown is not None:
        out = out.join(shown.select("id"), "id", "left_semi")
    return out if k is None else out.orderBy("hops", F.desc("similarity"), "id").limit(k)


def reach(links: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hops, link_type, source_id): each node that the seeds reach, by its first edge in the order of
    hops, kind of link and source."""
    scratch = Scratch.of(links.sparkSession)
    both = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "link_type").union(links.select("target_id", "source_id", "link_type"))
    seen = scratch.save(seeds.select("id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("link_type"), F.lit(None).cast("long").alias("source_id")))
    edge = seen
    for hop in range(1, hops + 1):
        step = edge.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("link_type", F.col("a").alias("source_id"))).alias("e"))
        edge = scratch.save(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "e.link_type", "e.source_id"))
        seen = seen.union(edge)
    return seen.where("hops > 0")


def closure(links: DataFrame, seeds: DataFrame, as_of: int | None = None) -> DataFrame:
    """(seed, id): all that supersedes links connect to each seed, itself included, in either direction.

    Links judged after ``as_of`` don't exist yet. Components are contracted, each step halving what is
    left of a chain, so the number of steps grows with the logarithm of its length.
    """
    rows = links.where(F.col("link_type") == "supersedes")
    if as_of is not None:
        rows = rows.where(F.coalesce("judged_at", "created_at") <= as_of)
    member = Scratch.of(links.sparkSession).save(connected_components(rows, "source_id", "target_id"))
    own = seeds.select(F.col("id").alias("seed")).distinct()
    named = own.join(member.select(F.col("id").alias("seed"), "component"), "seed")
    return named.join(member, "component").select("seed", "id").union(own.select("seed", F.col("seed").alias("id"))).distinct()


def pointer_ends(pointers: DataFrame) -> DataFrame:
    """(id, end, steps, loops): where following ``pointers`` (id, next) from each id leads, and in how many steps.

    Every round doubles the length of all pointers that haven't arrived, so chains of n steps take log2(n)
    rounds. Pointers that run into a loop never arrive: for them ``end`` is the least id of the loop, ``steps``
    counts the different ids after the first, and ``loops`` is true. Of several pointers of an id the least counts.
    """
    scratch = Scratch.of(pointers.sparkSession)
    single = scratch.save(pointers.where("id is not null and next is not null").groupBy("id").agg(F.min("next").alias("next")))
    ends = single.select(F.col("id").alias("_id"))
    start = single.join(ends, F.col("next") == F.col("_id"), "left")
    now = scratch.save(start.select("id", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("_id").isNull().alias("done")))
    total, length = now.count(), 1
    while not now.where("not done").isEmpty() and length <= total:
        then = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = now.where("not done").join(then, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        fresh = scratch.save(now.where("done").unionByName(moved))
        scratch.drop(now)
        now, length = fresh, 2 * length
    arrived = now.where("done").select("id", F.col("at").alias("end"), "steps", F.lit(False).alias("loops"))
    rest = now.where("not done")
    if rest.isEmpty():
        return arrived
    return arrived.unionByName(_looping(single, rest))


def _looping(single: DataFrame, rest: DataFrame) -> DataFrame:
    """Ends of pointers that run into loops. ``rest`` has gone so far that all of it is inside them."""
    scratch = Scratch.of(single.sparkSession)
    inside = rest.select(F.col("at").alias("id")).distinct().join(single, "id")
    inside = scratch.save(inside)
    # all ids of a loop are places that some pointer has reached, and a loop is a component of its own
    names = connected_components(inside, "id", "next")
    loops = scratch.save(inside.select("id").join(names, "id", "left").select("id", F.coalesce("component", "id").alias("end")))
    size = loops.groupBy("end").agg(F.count(F.lit(1)).alias("size"))
    own = loops.join(size, "end").select("id", "end", (F.col("size") - 1).alias("steps"))
    tails = rest.select("id").join(loops.select("id"), "id", "left_anti").join(single, "id")
    out = own
    if not tails.isEmpty():
        to_loop = pointer_ends(tails).select("id", F.col("end").alias("at"), "steps")
        out = own.unionByName(to_loop.join(own.select(F.col("id").alias("at"), "end", F.col("steps").alias("round")), "at").select("id", "end", (F.col("steps") + F.col("round")).alias("steps")))
    return out.select("id", "end", F.col("steps").cast("long").alias("steps"), F.lit(True).alias("loops"))


def history(memories: DataFrame, links: DataFrame, start: int, as_of: int | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Versions of a memory, oldest first, and the supersedes links between them."""
    ids = closure(links, memories.where(F.col("id") == start)).select("id")
    rows = memories.join(ids, "id", "left_semi")
    inside = links.where(F.col("link_type") == "supersedes")
    if as_of is not None:
        rows = rows.where(valid_at(as_of, F.col("valid_from"), F.col("valid_until")))
        inside = inside.where(F.coalesce("judged_at", "created_at") <= as_of)
    rows = rows.orderBy("created_at", "id").limit(limit)
    ends = rows.select(F.col("id").alias("source_id"))
    inside = inside.join(ends, "source_id", "left_semi").join(ends.select(F.col("source_id").alias("target_id")), "target_id", "left_semi")
    return rows, inside


def chain_depth(links: DataFrame, most: int = 100) -> DataFrame:
    """(id, depth): versions from each memory back along its revisions, itself included, at most ``most`` + 1.

    Every memory has at most one revision that it replaces: the least id where there are several. A loop
    counts each of its versions once.
    """
    back = links.where((F.col("link_type") == "supersedes") & (F.col("revision") > 0)).select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    return pointer_ends(back).select("id", F.least(F.col("steps") + 1, F.lit(most + 1)).alias("depth"))


def duplicate_groups(memories: DataFrame, links: DataFrame, threshold: float = 0.95, limit: int | None = 50) -> DataFrame:
    """(id, representative, similarity): members of groups joined by links above the threshold.

    The limit counts pairs, most similar first. The representative has the largest importance times
    uses; members without a link of their own to it take the threshold as similarity.
    """
    ids = memories.select("id", "importance", "access_count")
    pairs = links.where((F.col("similarity") > threshold) & (F.col("source_id") < F.col("target_id"))).select("source_id", "target_id", "similarity")
    pairs = pairs.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    if limit is not None:
        pairs = pairs.orderBy(F.desc("similarity"), "source_id", "target_id").limit(limit)
    pairs = Scratch.of(links.sparkSession).save(pairs)
    groups = connected_components(pairs, "source_id", "target_id").join(ids, "id")
    weight = F.struct((F.col("importance") * (F.col("access_count") + 1)).alias("w"), F.negative("id"))
    lead = groups.groupBy("component").agg(F.max_by("id", weight).alias("representative"))
    edges = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("representative"), "similarity").union(pairs.select("target_id", "source_id", "similarity"))
    edges = edges.groupBy("id", "representative").agg(F.max("similarity").alias("similarity"))
    members = groups.join(lead, "component").where(F.col("id") != F.col("representative")).select("id", "representative")
    return members.join(edges, ["id", "representative"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(threshold)))


def contradiction_candidates(lexical: DataFrame, vector: DataFrame, k: int = 10, least_cosine: float = 0.75) -> DataFrame:
    """(subject, id, score, source): the k best candidates of each subject from lexical (subject, id, rank
    from 0) and vector lists (subject, id, distance), those that both lists have first."""
    close = vector.where(1 - F.col("distance") * F.col("distance") / 2 >= least_cosine)
    near = close.select("subject", "id", F.greatest(1 - F.col("distance") * F.col("distance") / 2, F.lit(0.0)).alias("vec"), F.lit(None).cast("int").alias("rank"))
    both = near.union(lexical.select("subject", "id", F.lit(None).cast("double"), "rank")).groupBy("subject", "id").agg(F.max("vec").alias("vec"), F.min("rank").alias("rank"))
    word = F.when(F.col("rank").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("rank") / 20.0)).otherwise(0.0)
    shared = F.col("vec").isNotNull() & F.col("rank").isNotNull()
    score = 0.6 * F.coalesce("vec", F.lit(0.0)) + 0.4 * word + F.when(shared, 0.2).otherwise(0.0)
    source = F.when(shared, "both").when(F.col("vec").isNotNull(), "vec").otherwise("fts")
    out = both.select("subject", "id", score.alias("score"), source.alias("source"))
    w = Window.partitionBy("subject").orderBy(F.desc("score"), "id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def personalised_rank(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, reach: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(id, rank): random walks that restart at the seeds; weights are similarities; mass of dead ends is lost.

    With ``reach`` only nodes within so many hops of the seeds take part; where they are fewer than three,
    the rank of the others is their best edge's similarity.
    """
    scratch = Scratch.of(links.sparkSession)
    weights = _both_ways(links, nodes).select("a", "b", F.greatest("similarity", F.lit(0.0)).alias("w"))
    if reach is not None:
        weights = scratch.save(weights)
        near = scratch.save(seeds.select("id"))
        for _ in range(reach):
            near = scratch.save(near.union(near.select(F.col("id").alias("a")).join(weights, "a").select(F.col("b").alias("id"))).distinct())
        if near.count() < 3:
            out = near.join(seeds.select("id"), "id", "left_anti").join(weights.select(F.col("b").alias("id"), "w"), "id")
            return out.groupBy("id").agg(F.max("w").alias("rank"))
        weights = weights.join(near.select(F.col("id").alias("a")), "a", "left_semi").join(near.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "w")
    total = weights.groupBy("a").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))
    steps = scratch.save(weights.join(total, "a").select("a", "b", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1.0 / F.col("n")).alias("p")))
    n = seeds.count()
    seed = seeds.select("id", F.lit(1.0 / max(n, 1)).alias("mass"))
    rank = seed.select("id", F.col("mass").alias("rank"))
    for i in range(rounds):
        moved = rank.join(steps, rank.id == steps.a).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        rank = moved.join(seed, "id", "full_outer").select("id", ((1 - damping) * F.coalesce("mass", F.lit(0.0)) + damping * F.coalesce("m", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = scratch.save(rank)
    return rank
