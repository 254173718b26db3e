"""Digests, topics, health and ledgers' summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import first_sentence
from recallspark.plans.scratch import Scratch

#: Lines of a navigation digest by kind, its length, and the bounds of health.
TOPICS, PROMOTED, CHILDREN, NAV_CHARS = 5, 4, 8, 1200
THIN, STALE_MS = 3, 7 * 86_400_000
#: Levels of a consolidation at most, and room for the note of a cut digest.
MOST_DEPTH, NOTE_CHARS = 64, 24
#: Parts of a large group that are cut apart before the group is.
PARTS = 64


def cut_lines(lines: Column, budget: int) -> Column:
    """All lines where they fit; else the first that do, with a note of how many more there are."""
    note = lambda n: F.concat(F.lit("\n…("), n.cast("string"), F.lit(" more)"))
    room = budget - F.length(note(F.size(lines)))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        cost = F.length(x) + F.when(acc["kept"] > 0, 1).otherwise(0)
        fits = ~acc["full"] & (acc["used"] + cost <= room)
        return F.struct((acc["used"] + F.when(fits, cost).otherwise(0)).alias("used"), (acc["kept"] + fits.cast("int")).alias("kept"), (~fits).alias("full"))

    kept = F.aggregate(lines, start, add)["kept"]
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), kept), "\n"), note(F.size(lines) - kept))
    whole = F.array_join(lines, "\n")
    return F.when(F.length(whole) <= budget, whole).otherwise(F.substring(cut, 1, budget))


def digests(memories: DataFrame, budget: int = 2000) -> DataFrame:
    """(namespace, content, source_hash) of the pinned rows of every scope, oldest first.

    Superseded and archived pins count too. A scope's pins are few; a line is cut by the budget only.
    """
    pinned = memories.where("pinned").select("namespace", F.struct("created_at", "id", F.concat(F.lit("- ["), "type", F.lit("] "), F.col("content")).alias("line")).alias("x"))
    lists = pinned.groupBy("namespace").agg(F.sort_array(F.collect_list("x")).alias("l"))
    lines = F.transform("l", lambda x: x["line"])
    return lists.select("namespace", cut_lines(lines, budget).alias("content"), F.sha2(F.array_join(lines, "\n"), 256).alias("source_hash"))


def changed(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Digests whose sources differ from those that the stored ones were made of."""
    was = stored.select("namespace", F.col("source_hash").alias("_h"))
    return fresh.join(was, "namespace", "left").where(~F.col("source_hash").eqNullSafe(F.col("_h"))).drop("_h")


def nav_digests(memories: DataFrame, topics: DataFrame, nodes: DataFrame, budget: int = NAV_CHARS) -> DataFrame:
    """(path, digest): lines of pins, topics, promoted patterns and children of every scope, in this order.

    ``topics``: namespace, place, summary. ``nodes``: path, parent_path, memory_count.
    """
    def top(rows: DataFrame, kind: int, order: list, most: int | None) -> DataFrame:
        w = Window.partitionBy("path").orderBy(*order)
        out = rows.withColumn("n", F.row_number().over(w))
        if most is not None:
            out = out.where(F.col("n") <= most)
        return out.select("path", F.lit(kind).alias("kind"), "n", "line")

    own = memories.withColumn("path", F.col("namespace")).withColumn("line", F.concat(F.lit("- ["), "type", F.lit("] "), first_sentence(F.col("content"))))
    parts = [
        top(own.where("pinned"), 0, ["created_at", "id"], None),
        top(topics.select(F.col("namespace").alias("path"), "place", F.concat(F.lit("[topic] "), F.trim("summary")).alias("line")), 1, ["place"], TOPICS),
        top(own.where("type = 'pattern'").withColumn("line", F.concat(F.lit("[pattern] "), F.substring(F.trim(F.get(F.split("content", "\n"), F.lit(0))), 1, 160))), 2, [F.desc("importance"), "id"], PROMOTED),
        top(nodes.where("parent_path IS NOT NULL").select(F.col("parent_path").alias("path"), F.col("path").alias("child"), "memory_count", F.concat(F.lit("[child] "), "path", F.lit(" ("), F.col("memory_count").cast("string"), F.lit(")")).alias("line")), 3, [F.desc("memory_count"), "child"], CHILDREN),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    lists = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("kind", "n", "line"))).alias("l"))
    return lists.select("path", cut_lines(F.transform("l", lambda x: x["line"]), budget).alias("digest"))


def packed_lines(lines: Column, budget: int, reserve: int = NOTE_CHARS) -> Column:
    """All lines where they fit; else the first that leave room for a note of how many more there are; of a
    first line that alone is too long, its beginning. No lines are an empty text."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        cost = F.length(x) + F.when(acc["kept"] > 0, 1).otherwise(0)
        fits = ~acc["full"] & (acc["used"] + cost + reserve <= budget)
        return F.struct((acc["used"] + F.when(fits, cost).otherwise(0)).alias("used"), (acc["kept"] + fits.cast("int")).alias("kept"), (~fits).alias("full"))

    kept = F.aggregate(lines, start, add)["kept"]
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), kept), "\n"), F.lit("\n…("), (F.size(lines) - kept).cast("string"), F.lit(" more)"))
    whole = F.array_join(lines, "\n")
    begun = F.concat(F.substring(F.get(lines, F.lit(0)), 1, max(budget - 1, 1)), F.lit("…"))
    return F.when(F.length(whole) <= budget, whole).when(kept == 0, begun).otherwise(F.substring(cut, 1, budget))


def _first(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """At most so many rows of each group, with their place; groups of any size are cut in parts first."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)))
    near = part.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_n") <= most)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_part")


def consolidated(memories: DataFrame, topics: DataFrame, nodes: DataFrame, root: str, budget: int = NAV_CHARS, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(path, depth, digest): navigation digests of a scope and all below it, children before their parents.

    A digest condenses the scope's pins, topics, promoted patterns and the digests that its first children
    got in the same pass, each under the child's path. The tree is folded level by level from its deepest
    one, so there are as many rounds as levels, whatever their width.

    ``memories``: namespace, type, content, pinned, origin, importance, created_at, id. ``topics``: namespace,
    summary, updated_at, id. ``nodes``: path, parent_path, depth. Scopes deeper than ``most_depth`` below
    the root are left out, as are scopes without a node.
    """
    scratch = Scratch.of(memories.sparkSession)
    inside = scratch.save(nodes.where((F.col("path") == root) | F.col("path").startswith(root + "/")).select("path", "parent_path", "depth"))
    bounds = inside.agg(F.min("depth"), F.max("depth")).first()
    if bounds[0] is None:
        return inside.select("path", "depth", F.lit("").alias("digest"))
    trimmed = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pins = digests(memories).select(F.col("namespace").alias("path"), F.lit(0).alias("kind"), F.lit(1).alias("n"), trimmed(F.col("content")).alias("lines"))
    summaries = topics.where(F.trim("summary") != "").select(F.col("namespace").alias("path"), "updated_at", "id", F.trim("summary").alias("s"))
    topic = _first(summaries, "path", [F.desc("updated_at"), "id"], TOPICS).select("path", F.lit(1), "_n", F.array(F.concat(F.lit("[topic] "), "s")))
    promoted = memories.where("origin = 'promotion'").select(F.col("namespace").alias("path"), "importance", "created_at", "id", F.substring(F.trim(F.get(F.split("content", "\n"), F.lit(0))), 1, 160).alias("s"))
    pattern = _first(promoted, "path", [F.desc("importance"), F.desc("created_at"), "id"], PROMOTED).select("path", F.lit(2), "_n", F.array(F.concat(F.lit("[pattern] "), "s")))
    own = scratch.save(pins.union(topic).union(pattern).join(inside.select("path"), "path"))
    first_children = scratch.save(_first(inside.where("parent_path is not null").select("parent_path", "path"), "parent_path", ["path"], CHILDREN))
    below, levels = None, []
    for depth in range(min(bounds[1], bounds[0] + most_depth), bounds[0] - 1, -1):
        here = inside.where(F.col("depth") == depth).select("path", "depth")
        parts = own.join(here.select("path"), "path")
        if below is not None:
            told = first_children.join(below.select("path", "digest"), "path")
            lines = trimmed(F.col("digest"))
            name = F.concat(F.lit("[child "), "path", F.lit("] "))
            tail = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("  "), x))
            said = F.when(F.size(lines) == 0, F.array(F.concat(name, F.lit("(no digest yet)")))).otherwise(F.concat(F.array(F.concat(name, F.get(lines, F.lit(0)))), tail))
            parts = parts.union(told.select(F.col("parent_path").alias("path"), F.lit(3), "_n", said.alias("lines")))
        gathered = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("kind", "n", "lines"))).alias("l"))  # bounded by the kinds
        lines = F.flatten(F.transform("l", lambda x: x["lines"]))
        done = here.join(gathered.select("path", packed_lines(lines, budget).alias("digest")), "path", "left")
        below = scratch.save(done.select("path", "depth", F.coalesce("digest", F.lit("")).alias("digest")))
        levels.append(below)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def upserted_clusters(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, member_ids): found clusters (key, member_ids) take the id of the first stored one (id, member_ids)
    that shares a member, and are new without."""
    f = found.select("key", F.explode("member_ids").alias("m"))
    s = stored.select(F.col("id").alias("old"), F.explode("member_ids").alias("m"))
    match = f.join(s, "m").groupBy("key").agg(F.min("old").alias("old"))
    return found.join(match, "key", "left").select(F.col("old").alias("id"), "key", "member_ids")


def retrieval_summary(events: DataFrame) -> DataFrame:
    """logged, empty, weak, queries_logged, and mean latency and drops to one place."""
    count = lambda c: F.count_if(c)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    return events.agg(F.count(F.lit(1)).alias("logged"), count(F.col("result_count") == 0).alias("empty"), count(F.col("weak")).alias("weak"), mean("latency_ms").alias("avg_latency_ms"), mean("dropped").alias("avg_dropped"), count(F.col("query").isNotNull()).alias("queries_logged"))


def to_millis(at: Column) -> Column:
    """Times in seconds as milliseconds; those in milliseconds as they are."""
    return F.when(at < 1_000_000_000_000, at * 1000).otherwise(at)


def health(nodes: DataFrame, digests: DataFrame, now: int) -> DataFrame:
    """Scopes with their counts and what ails them: thin, without a digest, or with a stale one.

    ``nodes``: path, memory_count. ``digests``: namespace, content, updated_at.
    """
    d = digests.where(F.length("content") > 0).select(F.col("namespace").alias("path"), to_millis(F.col("updated_at")).alias("_at"))
    rows = nodes.join(d, "path", "left")
    some = F.col("memory_count") > 0
    return rows.select("path", "memory_count", (some & (F.col("memory_count") < THIN)).alias("thin"), (some & F.col("_at").isNull()).alias("missing_digest"), F.coalesce(now - F.col("_at") > STALE_MS, F.lit(False)).alias("stale_digest"))


def job_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))


def outbox_status(rows: DataFrame) -> DataFrame:
    """Counts by operation and state, the oldest unfinished time and the last error of each operation."""
    open_ = ~F.col("state").isin("done", "dead")
    counts = rows.groupBy("op", "state").agg(F.count(F.lit(1)).alias("n"))
    more = rows.groupBy("op").agg(F.min(F.when(open_, F.col("created_at"))).alias("oldest_unfinished"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("updated_at", "id"))).alias("last_error"))
    return counts.join(more, "op")


def slot_keys(memories: DataFrame, k: int) -> DataFrame:
    """State keys of each scope, those written last first."""
    rows = memories.where("state_key IS NOT NULL AND state_key <> ''").groupBy("namespace", "state_key").agg(F.max(F.coalesce("valid_from", "created_at")).alias("last"))
    w = Window.partitionBy("namespace").orderBy(F.desc("last"), "state_key")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def child_roster(nodes: DataFrame, k: int = 12) -> DataFrame:
    """The k children with most memories of each scope."""
    w = Window.partitionBy("parent_path").orderBy(F.desc("memory_count"), "path")
    return nodes.where("parent_path IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("parent_path", "path", "memory_count", "place")


def evicted_vectors(cache: DataFrame, capacity: int) -> DataFrame:
    """Keys of a vector cache beyond its capacity, least recently used first (then oldest, then key)."""
    bound = cache.select(F.struct("last_used_at", "created_at", "key").alias("k")).orderBy(F.desc("k")).limit(capacity).agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("n"))
    least, n = bound.first()
    if n < capacity or capacity == 0:
        return cache.select("key").where(F.lit(capacity == 0))
    kind = dict(cache.dtypes)
    names = ("last_used_at", "created_at", "key")
    return cache.where(F.struct(*names) < F.struct(*[F.lit(v).cast(kind[c]).alias(c) for c, v in zip(names, least)])).select("key")


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text, embedding): the vectors that a cache has for texts, by content; null where it has none."""
    keyed = texts.select("text", F.sha2(F.concat_ws("\0", F.lit(model), "text"), 256).alias("key")).distinct()
    return keyed.join(cache.select("key", "embedding"), "key", "left")


def report(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result, of at most so many rows."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    body = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join([head, *body])
