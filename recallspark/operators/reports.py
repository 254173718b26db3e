"""Reports and small lookups over memories, links, ledgers and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.json_values import canonical_key
from recallspark.functions.text import ancestors


def namespace_nodes(memories: DataFrame) -> DataFrame:
    """(path, parent_path, depth, is_synthetic, memory_count, child_count, last_activity) of every scope and all above it."""
    own = memories.groupBy("namespace").agg(F.count(F.lit(1)).alias("memory_count"), F.max("created_at").alias("last_activity"))
    chain = own.select(ancestors(F.col("namespace")).alias("chain"), "namespace")
    step = chain.select(F.posexplode("chain").alias("i", "path"), "chain").select("path", F.when(F.col("i") > 0, F.get("chain", F.col("i") - 1)).alias("parent_path"), (F.col("i") + 1).alias("depth")).distinct()
    children = step.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("child_count"))
    out = step.join(own.withColumnRenamed("namespace", "path"), "path", "left").join(children, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("path", "parent_path", "depth", F.contains("path", F.lit("//")).alias("is_synthetic"), zero("memory_count"), zero("child_count"), "last_activity")


def explain_miss(memories: DataFrame, scope: str, rich: int = 3) -> DataFrame:
    """(path, depth, rows, is_nearest): what a scope and those above it hold, deepest first; the nearest rich one is marked."""
    chain = memories.sparkSession.range(1).select(F.posexplode(ancestors(F.lit(scope))).alias("i", "path"))
    held = memories.select(F.explode(ancestors(F.col("namespace"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    out = chain.join(held, "path", "left").select("path", (F.col("i") + 1).alias("depth"), F.coalesce("rows", F.lit(0)).alias("rows"))
    nearest = F.max(F.when(F.col("rows") >= rich, F.col("depth"))).over(Window.partitionBy(F.lit(1)))  # one row for each level
    return out.withColumn("is_nearest", F.coalesce(F.col("depth") == nearest, F.lit(False)))


def eviction_summary(events: DataFrame, top: int = 20) -> DataFrame:
    """(action, reason, n): the most frequent reasons of each action."""
    return events.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason", "action").limit(top)


def fault_rate(events: DataFrame) -> DataFrame:
    """(faults, removed, fault_rate): faults for each archived or pruned row, null where none was."""
    c = events.agg(F.count_if(F.col("action") == "fault").alias("faults"), F.count_if(F.col("action").isin("archived", "pruned")).alias("removed"))
    return c.withColumn("fault_rate", F.round(F.col("faults") / F.nullif("removed", F.lit(0)), 4))


def newest(events: DataFrame, key: str, cap: int) -> DataFrame:
    """The rows of the ``cap`` largest ids: what a ledger keeps."""
    return events.orderBy(F.desc(key)).limit(cap)


def fully_visible(memories: DataFrame, caller: str) -> DataFrame:
    """(namespace): scopes whose rows are all the caller's, so that texts derived from them may be served."""
    return memories.groupBy("namespace").agg(F.bool_and(F.col("owner").eqNullSafe(F.lit(caller))).alias("own")).where("own").select("namespace")


def reversed_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links without the superseding ones of the pairs (source_id, target_id), which are taken back."""
    undone = pairs.select("source_id", "target_id", F.lit("supersedes").alias("link_type"))
    return links.join(undone, ["source_id", "target_id", "link_type"], "left_anti").select(*links.columns)


def restored(memories: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Memories after superseding links of the pairs are taken back: targets are open and out of the archive
    again, and judged or waiting rows of both ends are not to be judged anew ('skipped').

    Pairs without such a link change nothing. ``memories`` has adjudication_state.
    """
    hit = links.where("link_type = 'supersedes'").join(pairs.select("source_id", "target_id"), ["source_id", "target_id"], "left_semi")
    targets = hit.select(F.col("target_id").alias("id"), F.lit(True).alias("_target")).distinct()
    ends = hit.select(F.col("source_id").alias("id")).union(hit.select("target_id")).distinct().withColumn("_end", F.lit(True))
    rows = memories.join(targets, "id", "left").join(ends, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    settled = yes("_end") & F.col("adjudication_state").isin("done", "pending")
    changed = {"valid_until": F.when(~yes("_target"), F.col("valid_until")), "archived_at": F.when(~yes("_target"), F.col("archived_at")), "adjudication_state": F.when(settled, "skipped").otherwise(F.col("adjudication_state"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in memories.columns])


#: Characters of a query and ids of results that a retrieval event keeps, and days and rows of a ledger.
QUERY_CHARS, RESULT_IDS, LEDGER_DAYS, LEDGER_ROWS = 2000, 50, 90, 100_000


def retrieval_events(calls: DataFrame, log_queries: bool = True) -> DataFrame:
    """Events of calls (tool, query, result_ids, latency_ms, created_at): lengths and counts are true, what
    is stored of the query and the ids is bounded."""
    n = F.size("result_ids")
    query = F.substring("query", 1, QUERY_CHARS) if log_queries else F.lit(None).cast("string")
    return calls.select("tool", query.alias("query"), F.coalesce(F.length("query"), F.lit(0)).alias("query_chars"), n.alias("result_count"), F.slice("result_ids", 1, RESULT_IDS).alias("result_ids"), F.greatest(F.round("latency_ms"), F.lit(0)).cast("long").alias("latency_ms"), "created_at")


def pruned_ledger(events: DataFrame, now: int, days: int = LEDGER_DAYS, cap: int = LEDGER_ROWS) -> DataFrame:
    """What a ledger (id, ts) keeps: the newest rows that are young enough, by the retention rule."""
    return newest(events.where(F.col("ts") >= now - days * 86_400_000), "id", cap)


def patched(memories: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Rows after patches (key, seq, columns): of each column the last value that isn't null stands."""
    columns = [c for c in patches.columns if c not in (key, "seq")]
    last = patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns])
    return memories.join(last, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in memories.columns])


def leak_rates(ranked: DataFrame, scope: Column, stale: Column) -> DataFrame:
    """(query_id, leak_rate, stale_rate): shares of a query's rows outside its scope, and of outdated ones."""
    return ranked.groupBy("query_id").agg(F.avg((~scope).cast("double")).alias("leak_rate"), F.avg(stale.cast("double")).alias("stale_rate"))


def newest_fact(facts: DataFrame, answers: list[str]) -> DataFrame:
    """(serial, fact): the fact of the highest serial that holds any answer, case apart; no row if none does."""
    hit = F.lit(False)
    for a in answers:
        hit = hit | F.contains(F.lower("fact"), F.lit(a.lower()))
    return facts.where(hit).orderBy(F.desc("serial")).limit(1)


def gated(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, value, bound, passed): measures against bounds (metric, bound, lower_is_better); a missing measure fails."""
    joined = limits.join(metrics, "metric", "left")
    ok = F.when(F.col("lower_is_better"), F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return joined.select("metric", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def excerpt(text: Column, terms: list[str], width: int = 240) -> Column:
    """The stretch of a text around the first place that holds a term, else its beginning."""
    places = [F.nullif(F.instr(F.lower(text), t.lower()), F.lit(0)) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    return F.substring(text, F.greatest(F.lit(1), at - width // 2), F.lit(width))


def raw_rank(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score): chunks by how often the terms occur as plain substrings; ties go to the smaller id."""
    text, score = F.lower("text"), F.lit(0)
    for t in terms:
        score = score + ((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t)).cast("int")
    return chunks.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def clusters_visible(clusters: DataFrame, readable: DataFrame) -> DataFrame:
    """Clusters (cluster_id, member_ids) whose members can all be read; an empty one can't."""
    members = clusters.select("cluster_id", F.explode("member_ids").alias("id"))
    seen = members.join(readable.select("id", F.lit(True).alias("ok")), "id", "left")
    whole = seen.groupBy("cluster_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok")
    return clusters.join(whole.select("cluster_id"), "cluster_id", "left_semi")


def assertions(facts: DataFrame, memories: DataFrame, predicate: str, value: str | None = None, until: int | None = None, k: int = 50) -> DataFrame:
    """Typed facts (memory_id, subject, predicate, value, observed_at) of the memories in reach, newest first.

    ``value`` is JSON; facts have it where theirs is the same value, however it is spelled.
    """
    out = facts.where(F.col("predicate") == predicate)
    out = out if value is None else out.where(canonical_key(F.col("value")) == canonical_key(F.lit(value)))
    out = out if until is None else out.where(F.col("observed_at") <= until)
    return out.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").orderBy(F.desc("observed_at"), "memory_id").limit(k)


def same_assertions(facts: DataFrame) -> DataFrame:
    """(memory_id, first_id, n): of each fact the first one that says the same, and how many do.

    Facts (memory_id, subject, predicate, value, observed_at) say the same where subject, predicate and
    the JSON value are equal. They are counted by key before they are joined to, so a value that a third of
    all facts have is one row. Facts whose value isn't JSON say nothing and are left out.
    """
    keyed = facts.withColumn("key", canonical_key(F.col("value"))).where("key is not null")
    by = [F.col("subject"), F.col("predicate"), F.col("key")]
    first = keyed.groupBy(F.xxhash64("subject", "predicate", F.col("subject").isNull(), "key").alias("h"), *by).agg(F.min(F.struct("observed_at", "memory_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.select("h", F.col("subject").alias("_s"), F.col("predicate").alias("_p"), F.col("key").alias("_k"), F.col("first.memory_id").alias("first_id"), "n")
    rows = keyed.withColumn("h", F.xxhash64("subject", "predicate", F.col("subject").isNull(), "key"))
    same = (rows["h"] == first["h"]) & F.col("subject").eqNullSafe(F.col("_s")) & F.col("predicate").eqNullSafe(F.col("_p")) & (F.col("key") == F.col("_k"))
    return rows.join(first, same).select("memory_id", "first_id", "n")


def chain_keys(components: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, chain_key): for chains (id, component) without any keyed member, a key named by the oldest."""
    m = components.join(memories.select("id", "created_at", "state_key"), "id")
    heads = m.groupBy("component").agg(F.min_by("id", F.struct("created_at", "id")).alias("oldest"), F.bool_and(F.col("state_key").isNull()).alias("bare")).where("bare")
    return components.join(heads, "component").select("id", F.concat(F.lit("chain:"), F.col("oldest").cast("string")).alias("chain_key"))
