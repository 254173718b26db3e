"""Upkeep plans: admission, lexical families, duplicate pruning, retention and adjudicated links."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import scoring, text
from recallspark.operators.visibility import SUPERSEDES_AT
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Confidences from which a verdict hides its target, and below which it is dropped.
RELATION_THRESHOLDS = {"contradicts": 0.8, "updates": 0.9, "duplicate": 0.95}
CONFLICTS_FROM = 0.4

#: Defaults of family and retention plans.
PREFIX_CHARS, SIMILARITY = 48, 0.95
BURST_ROWS, BURST_DAYS = 5, 7
MOST_SCORE, LEAST_ROWS, LEAST_DAYS, MOST_ARCHIVED = 0.35, 500, 14, 200


def admission(content: Column, enforce: bool = True, by_agent: Column | None = None) -> Column:
    """Struct (action, rule) by the text alone: secrets are always refused; the other rules refuse only what agents write.

    Bursts take the stored rows as well, see ``admitted``.
    """
    junk, strict = text.junk_reason(content), (F.lit(True) if by_agent is None else by_agent) & F.lit(enforce)
    refuse = F.when(strict, "reject").otherwise("warn")
    return (
        F.when(text.secret_shape(content).isNotNull(), F.struct(F.lit("reject").alias("action"), F.lit("secrets").alias("rule")))
        .when(F.coalesce(junk, F.lit("")).isin("empty", "too long"), F.struct(refuse.alias("action"), F.lit("junk").alias("rule")))
        .when(junk == "thin", F.struct(F.lit("warn").alias("action"), F.lit("junk").alias("rule")))
        .when(text.claims_absence(content), F.struct(F.lit("warn").alias("action"), F.lit("negative-result").alias("rule")))
        .otherwise(F.struct(F.lit("allow").alias("action"), F.lit(None).cast("string").alias("rule")))
    )


def burst_keepers(stored: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """(namespace, type, prefix, existing_id): families of recent rows with the same opening that hold too many, and their best row.

    Rows that are archived, or superseded from within their namespace, don't count. Links count for a row's rank
    where their other end is in its namespace. The whole family is looked at, not its 200 oldest rows.
    """
    where = stored.select("id", "namespace")
    near = links.join(where.toDF("source_id", "_s"), "source_id").join(where.toDF("target_id", "_t"), "target_id").where("_s = _t")
    gone = near.where((F.col("link_type") == "supersedes") & (F.col("confidence") >= SUPERSEDES_AT)).select(F.col("target_id").alias("id"))
    prefix = F.substring("content", 1, PREFIX_CHARS).alias("prefix")
    recent = stored.where((F.col("created_at") >= now - BURST_DAYS * 86_400_000) & F.col("archived_at").isNull() & F.col("content").isNotNull())
    recent = recent.select("id", "namespace", "type", prefix, "pinned", "importance", "access_count", "created_at").join(gone, "id", "left_anti")
    rows = recent.join(degrees(near).select("id", "degree"), "id", "left")
    order = F.struct(~F.coalesce("pinned", F.lit(False)), F.negative("importance"), F.negative("access_count"), F.negative(F.coalesce("degree", F.lit(0))), "created_at", "id")
    families = rows.groupBy("namespace", "type", "prefix").agg(F.count(F.lit(1)).alias("_n"), F.min_by("id", order).alias("existing_id"))
    return families.where(F.col("_n") >= BURST_ROWS).drop("_n")


def admitted(writes: DataFrame, stored: DataFrame, links: DataFrame, now: int, enforce: bool = True, by_agent: Column | None = None) -> DataFrame:
    """(id, action, rule, existing_id, warnings): what becomes of each write (id, namespace, type, content, and tags if there are any).

    Rules are tried in the order secrets, junk, negative-result, burst. The first that refuses decides, whatever
    warned before it; else all that warn are listed, and the first of them is the rule. ``existing_id`` holds the family of a burst.
    """
    full = F.concat_ws("\n", "content", "tags") if "tags" in writes.columns else F.col("content")
    strict = (F.lit(True) if by_agent is None else F.coalesce(by_agent, F.lit(False))) & F.lit(enforce)
    junk, absent = text.junk_reason(F.col("content")), F.coalesce(text.claims_absence(F.col("content")), F.lit(False))
    # texts are judged before the join, which carries their beginnings alone
    judged = writes.select("id", "namespace", "type", F.substring("content", 1, PREFIX_CHARS).alias("prefix"), strict.alias("_strict"), text.secret_shape(full).isNotNull().alias("_secret"), junk.alias("_junk"), absent.alias("_absent"))
    rows = judged.join(burst_keepers(stored, links, now), ["namespace", "type", "prefix"], "left")
    burst = F.col("existing_id").isNotNull()
    refused = F.when(F.col("_secret"), "secrets").when(F.col("_strict"), F.when(F.col("_junk").isin("empty", "too long"), "junk").when(burst, "burst"))
    warnings = F.array_compact(F.array(F.when(F.col("_junk").isNotNull(), "junk"), F.when(F.col("_absent"), "negative-result"), F.when(burst, "burst")))
    rows = rows.select("id", "existing_id", refused.alias("_r"), F.when(refused.isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))
    action = F.when(F.col("_r").isNotNull(), "reject").when(F.size("warnings") > 0, "warn").otherwise("allow")
    return rows.select("id", action.alias("action"), F.coalesce("_r", F.get("warnings", F.lit(0))).alias("rule"), F.when(F.col("_r") == "burst", F.col("existing_id")).alias("existing_id"), "warnings")


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree, duplicates_out, supersedes_out, duplicate_target) of every linked row."""
    dup, sup = F.col("link_type") == "duplicate_of", (F.col("link_type") == "supersedes") & (F.col("confidence") >= 0.8)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    out = links.select(F.col("source_id").alias("id"), F.lit(1).alias("d"), flag(dup).alias("do"), flag(sup).alias("so"), F.lit(0).cast("long").alias("dt"))
    into = links.select(F.col("target_id").alias("id"), (F.col("source_id") != F.col("target_id")).cast("int").alias("d"), F.lit(0).cast("long").alias("do"), F.lit(0).cast("long").alias("so"), flag(dup).alias("dt"))
    return out.union(into).groupBy("id").agg(F.sum("d").alias("degree"), F.sum("do").alias("duplicates_out"), F.sum("so").alias("supersedes_out"), F.sum("dt").alias("duplicate_target"))


def needed_prefix(length: int, threshold: float) -> int:
    """The least common prefix with which a text of this length, the longer of two, is similar enough."""
    k = max(0, min(length, int(threshold * length) - 1))
    while k < length and k / length < threshold:
        k += 1
    return k


def needed_prefix_of(length: Column, threshold: float) -> Column:
    """``needed_prefix`` of a column."""
    low = F.greatest(F.lit(0), F.least(length, F.floor(length * F.lit(threshold)).cast("int") - 1))
    tries = [F.when((k >= length) | (k / length >= threshold), F.least(k, length)) for k in (low + i for i in range(4))]
    return F.coalesce(*tries, length).cast("int")


def _prefix_nodes(threshold: float):
    """Each text's own node and those that it touches: its prefixes of the lengths ``ks`` (ascending) that a text of its group needs."""

    def run(batches):
        for rb in batches:
            cls, g, node, k, own = [], [], [], [], []
            for c, group, text_, ks in zip(*(rb.column(x).to_pylist() for x in ("cls", "g", "content", "ks"))):
                need = needed_prefix(len(text_), threshold)
                h, done = hashlib.blake2b(digest_size=16), 0
                for at in ks:
                    h.update(text_[done:at].encode())
                    done = at
                    cls.append(c)
                    g.append(group)
                    node.append(h.digest())
                    k.append(at)
                    own.append(at == need)
                if len(cls) > 100_000:
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "g": pa.array(g, pa.int64()), "k": pa.array(k, pa.int32()), "node": pa.array(node, pa.binary()), "own": pa.array(own, pa.bool_())})
                    cls, g, node, k, own = [], [], [], [], []
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "g": pa.array(g, pa.int64()), "k": pa.array(k, pa.int32()), "node": pa.array(node, pa.binary()), "own": pa.array(own, pa.bool_())})

    return run


def _leading(texts: DataFrame, touches: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls): texts that lead families. ``texts``: cls, o (the first row's place); ``touches``: cls, node, own.

    In each round all texts that come before every similar text still open lead, and the texts similar
    to them are settled. A node's least place stands for all texts that touch it, so similar pairs are never listed.
    """
    leaders, open_ = None, texts.select("cls", "o")
    while True:
        rows = touches.join(open_, "cls")
        first = rows.groupBy("node").agg(F.min("o").alias("any"), F.min(F.when(F.col("own"), F.col("o"))).alias("owner"))
        # of a text's own node all that touch it count, of the other nodes their owners
        seen = F.when(F.col("own"), F.least("any", "owner")).otherwise(F.col("owner"))
        least = rows.join(first, "node").groupBy("cls", "o").agg(F.min(seen).alias("least"))
        new = scratch.save(least.where(F.coalesce("least", "o") >= F.col("o")).select("cls"))
        leaders = new if leaders is None else leaders.union(new)
        led = touches.join(new, "cls").groupBy("node").agg(F.max("own").alias("by_owner"))
        gone = touches.join(led, "node").where("own or by_owner").select("cls").union(new).distinct()
        rest = scratch.save(open_.join(gone, "cls", "left_anti"))
        open_ = rest
        if rest.isEmpty():
            return leaders


def lexical_families(rows: DataFrame, prefix_chars: int = PREFIX_CHARS, threshold: float = SIMILARITY, whole_prefix: bool = False) -> DataFrame:
    """(id, keeper, similarity, siblings): each row's family among those of its namespace, type and opening.

    Rows stand in order of use: pinned, importance, access_count, degree, oldest, least id. The first of
    a group leads a family; each row joins the earlier leader that it resembles most, from
    ``threshold`` on, else leads another. With ``whole_prefix`` a group is one family.

    Two texts are similar where their common prefix reaches what the longer one needs: where the shorter
    touches the node of the longer one's needed prefix. Equal texts are one. Texts meet by these nodes
    alone, so neither a group nor its pairs are gathered, and all leaders that depend on no other are
    found in one round. At most one leader touches a node, so rows meet few leaders.
    Texts are taken as they are; null texts form a family of each namespace and type. Prefixes are compared by 128-bit digests.
    """
    scratch = Scratch.of(rows.sparkSession)
    order = F.struct((~F.col("pinned")).alias("p"), F.negative("importance").alias("i"), F.negative("access_count").alias("a"), F.negative("degree").alias("d"), F.col("created_at").alias("c"), F.col("id").alias("id"))
    content = F.coalesce("content", F.lit(""))
    base = rows.select("id", content.alias("content"), F.xxhash64("namespace", "type", F.substring(content, 1, prefix_chars)).alias("g"), order.alias("o"))
    if whole_prefix:
        lead = base.groupBy("g").agg(F.min("o").alias("lo"), F.count(F.lit(1)).alias("n"))
        return base.join(lead, "g").select("id", F.col("lo.id").alias("keeper"), F.lit(1.0).alias("similarity"), (F.col("n") - 1).alias("siblings"))
    base = scratch.save(base.withColumn("cls", F.xxhash64("g", F.sha2("content", 256))))
    texts = base.groupBy("cls").agg(F.first("g").alias("g"), F.min("o").alias("o"), F.first("content").alias("content"))
    several = base.groupBy("g").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("g")
    # lengths are written, or they would be counted anew for every prefix
    texts = scratch.save(texts.withColumn("length", F.length("content")).withColumn("need", needed_prefix_of(F.col("length"), threshold)))
    ensure_on_executors(rows.sparkSession)
    # a prefix that no text of the group needs is no text's own node, and is not made
    needs = texts.select("g", "need").join(several, "g", "left_semi").groupBy("g").agg(F.array_sort(F.collect_set("need")).alias("needs"))
    crowded = texts.join(needs, "g").select("cls", "g", "content", "need", "length", "needs")
    within = F.filter("needs", lambda k: (k >= F.col("need")) & (k <= F.col("length")))
    nodes = crowded.select("cls", "g", "content", within.alias("ks")).mapInArrow(_prefix_nodes(threshold), "cls long, g long, k int, node binary, own boolean")
    nodes = scratch.save(nodes.select("cls", F.struct("g", "k", "node").alias("node"), "own"))
    # only nodes that some text owns, and that two texts touch, tell texts apart
    shared = nodes.groupBy("node").agg(F.max("own").alias("owned"), F.count(F.lit(1)).alias("n")).where("owned and n > 1").select("node")
    touches = scratch.save(nodes.join(shared, "node"))
    apart = texts.join(touches.select("cls").distinct(), "cls", "left_anti").select("cls")
    leaders = apart
    if not touches.isEmpty():
        leaders = apart.union(_leading(texts.join(touches.select("cls").distinct(), "cls", "left_semi"), touches, scratch))
    leaders = scratch.save(leaders.join(texts.select("cls", "o"), "cls").select(F.col("cls").alias("lcls"), F.col("o").alias("lo")))
    by_node = touches.join(leaders.select("lcls"), F.col("cls") == F.col("lcls"), "left_semi").select("node", F.col("cls").alias("lcls"), F.col("own").alias("lown"))
    met = touches.join(by_node, "node").where("(own or lown) and cls <> lcls").select("cls", "lcls").distinct()
    led = texts.select(F.col("cls").alias("lcls"), F.col("content").alias("lc"))
    pairs = met.join(leaders, "lcls").join(texts.select("cls", "content"), "cls").join(led, "lcls").select("cls", "lo", text.prefix_similarity(F.col("content"), F.col("lc")).alias("s")).where(F.col("s") >= threshold)
    own = leaders.select(F.col("lcls").alias("cls"), "lo", F.lit(1.0).alias("s"))
    choices = pairs.union(own).groupBy("cls").agg(F.collect_list(F.struct((-F.col("s")).alias("s"), "lo")).alias("choices"))  # few leaders of a text
    before = F.filter("choices", lambda c: c["lo"] <= F.col("o"))
    best = base.join(choices, "cls").select("id", F.array_min(before).alias("b"))
    done = scratch.save(best.select("id", F.col("b.lo.id").alias("keeper"), (-F.col("b.s")).alias("similarity")))
    members = done.groupBy("keeper").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return done.join(members, "keeper").select("id", "keeper", "similarity", "siblings")


def prune_plan(families: DataFrame) -> DataFrame:
    """(id, keeper, similarity): redundant rows and what stands for them."""
    return families.where("id <> keeper").select("id", "keeper", "similarity")


def repointed(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Links once the plan's rows are archived: their ends move to the keepers, loops and repeats go.

    Of links that fall together, one that was there before stays, else that of the least old ends.
    """
    p = plan.select("id", "keeper")
    s, t = p.select(F.col("id").alias("source_id"), F.col("keeper").alias("_s")), p.select(F.col("id").alias("target_id"), F.col("keeper").alias("_t"))
    moved = links.join(s, "source_id", "left").join(t, "target_id", "left")
    ends = F.struct((F.col("_s").isNotNull() | F.col("_t").isNotNull()).alias("moved"), F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    new = moved.select(F.coalesce("_s", "source_id").alias("source_id"), F.coalesce("_t", "target_id").alias("target_id"), "link_type", ends.alias("_o"), F.struct(*[c for c in links.columns if c not in ("source_id", "target_id", "link_type")]).alias("_v"))
    kept = new.where(~(F.col("_o.moved") & (F.col("source_id") == F.col("target_id")))).groupBy("source_id", "target_id", "link_type").agg(F.min_by("_v", "_o").alias("_v"))
    return kept.select("source_id", "target_id", "link_type", "_v.*").select(*links.columns)


def retention_plan(rows: DataFrame, links: DataFrame, families: DataFrame, now: int, most_score: float = MOST_SCORE, least_rows: int = LEAST_ROWS, least_days: int = LEAST_DAYS, most_archived: int = MOST_ARCHIVED) -> DataFrame:
    """(id, tier, reason, score, archive): one decision for each current row, by the first gate that fits.

    Rows need shareable and origin. Of the candidates the least worth ``most_archived`` are archived.
    """
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    x = rows.join(degrees(links), "id", "left").join(families.select("id", "keeper", "siblings"), "id", "left").crossJoin(F.broadcast(n))  # one row
    num = lambda c: F.coalesce(c, F.lit(0))
    trust = scoring.trust(now, F.col("importance"), F.col("access_count"), F.col("created_at"))
    score = scoring.retention(now, F.col("importance"), F.col("access_count"), F.col("last_accessed"), F.col("created_at"), num("degree"), num("duplicates_out"))
    x = x.withColumn("tier", scoring.tier(trust, F.lit(False))).withColumn("score", score)
    age = F.greatest(F.lit(now) - F.coalesce("last_accessed", "created_at"), F.lit(0)) / F.lit(float(scoring.DAY_MS))
    redundant = (num("duplicates_out") > 0) | ((num("siblings") > 0) & (F.col("id") != F.col("keeper")))
    reason = (
        F.when(F.col("_n") < least_rows, "corpus_too_small")
        .when(F.col("pinned"), "pinned")
        .when(F.col("shareable"), "shareable")
        .when(F.col("origin") == "promotion", "promotion")
        .when(num("supersedes_out") > 0, "adjudication_winner")
        .when(num("duplicate_target") > 0, "dedupe_keeper")
        .when(F.col("tier") == "hot", "hot_tier")
        .when(~redundant, "non_redundant")
        .when(age < least_days, "recently_used")
        .when(F.col("score") >= most_score, "above_threshold")
        .otherwise("low_retention")
    )
    plan = x.select("id", "tier", reason.alias("reason"), "score")
    least = plan.where("reason = 'low_retention'").orderBy("score", "id").limit(most_archived).select("id", F.lit(True).alias("archive"))
    return plan.join(F.broadcast(least), "id", "left").select("id", "tier", "reason", "score", F.coalesce("archive", F.lit(False)).alias("archive"))


def adjudicated(verdicts: DataFrame, rows: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """Links that verdicts (source_id, target_id, relation, confidence, similarity) add.

    At its relation's threshold a verdict supersedes, below it conflicts, below 0.4 it is dropped; a
    pinned or missing target takes none; a pair's link of a type is written once, and not again.
    """
    threshold = F.coalesce(*[F.when(F.col("relation") == k, F.lit(v)) for k, v in RELATION_THRESHOLDS.items()])
    v = verdicts.withColumn("_t", threshold).where(F.col("_t").isNotNull() & ((F.col("confidence") >= F.col("_t")) | (F.col("confidence") >= CONFLICTS_FROM)))
    v = v.withColumn("link_type", F.when(F.col("confidence") >= F.col("_t"), "supersedes").otherwise("conflicts"))
    v = v.join(rows.where(~F.coalesce("pinned", F.lit(False))).select(F.col("id").alias("target_id")), "target_id", "left_semi")
    v = v.join(links.select("source_id", "target_id", "link_type"), ["source_id", "target_id", "link_type"], "left_anti")
    best = v.groupBy("source_id", "target_id", "link_type").agg(F.max_by(F.struct(F.coalesce("similarity", "confidence").alias("similarity"), "confidence"), F.struct("confidence", "similarity")).alias("b"))
    return best.select("source_id", "target_id", "b.similarity", "link_type", "b.confidence", F.lit(now).alias("created_at"), F.lit(now).alias("judged_at"))


def task_state(events: DataFrame) -> DataFrame:
    """(task_id, kind, item_id, text, status, first_seq, last_seq): items of tasks after all their deltas.

    Events (task_id, seq, kind, item_id, text, status) add an item or change it by id: the last text
    and status that aren't null stand, a removed item goes. Combined before the shuffle by maxima, so a
    task of any length is no burden.
    """
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    out = events.groupBy("task_id", "kind", "item_id").agg(at("text"), at("status"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return out.where(F.coalesce("status", F.lit("")) != "removed")


def derived_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the roots and all that edges (parent, child) derive from them, loops included."""
    scratch = Scratch.of(edges.sparkSession)
    seen = scratch.save(roots.select("id").distinct())
    front = seen
    while not front.isEmpty():
        nxt = front.join(edges, front.id == edges.parent).select(F.col("child").alias("id")).distinct()
        front = scratch.save(nxt.join(seen, "id", "left_anti"))
        seen = scratch.save(seen.union(front))
    return seen


def purge(rows: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows left once the roots are forgotten together with everything derived from them."""
    return rows.join(derived_from(edges, roots), "id", "left_anti")


def forgotten(items: DataFrame, tombstones: DataFrame, barriers: DataFrame) -> DataFrame:
    """Items of sources (source, item_id, generation) that may be applied: not those with a tombstone,
    under whatever revision, nor those of a generation at or before their source's barrier."""
    live = items.join(tombstones.select("source", "item_id").distinct(), ["source", "item_id"], "left_anti")
    last = barriers.groupBy("source").agg(F.max("generation").alias("_barrier"))
    return live.join(last, "source", "left").where(F.col("_barrier").isNull() | (F.col("generation") > F.col("_barrier"))).select(*items.columns)
