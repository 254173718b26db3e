"""Families, retention, packing, archives, answers, JSON and bootstrap against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.functions import answers, json_values, scoring, text
from recallspark.functions.entities import entities, entity_terms
from recallspark.plans.scratch import Scratch
from recallspark.operators import allocation, archive, channels, evaluation, upkeep

ROWS = "id long, namespace string, type string, content string, importance double, access_count int, degree int, pinned boolean, created_at long, last_accessed long"


def _similarity(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n / max(len(a), len(b)) if a or b else 1.0


def _families(rows, threshold):
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2], (r[3] or "")[:48]), []).append(r)
    out = {}
    for members in groups.values():
        leaders = []
        for r in sorted(members, key=lambda r: (not r[7], -r[4], -r[5], -r[6], r[8], r[0])):
            best = max(leaders, key=lambda k: _similarity(r[3] or "", k[3] or ""), default=None)
            if best and _similarity(r[3] or "", best[3] or "") >= threshold:
                out[r[0]] = best[0]
            else:
                leaders.append(r)
                out[r[0]] = r[0]
    return out


def _rows(n, seed=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abc ") for _ in range(150)) for _ in range(4)]
    return [(i, f"/p/{rng.randrange(2)}", "note", None if i % 29 == 0 else rng.choice(stems)[: rng.choice((48, 100, 143, 146, 148, 150))] + rng.choice(("", "x", "yz", "tail " * 3)), rng.randrange(5) / 10, rng.randrange(3), 0, rng.random() < 0.1, rng.randrange(50), None) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.95, 0.7])
def test_families_match_leader_by_leader(spark, threshold):
    rows = _rows(150)
    got = {r.id: r.keeper for r in upkeep.lexical_families(spark.createDataFrame(rows, ROWS), threshold=threshold).collect()}
    assert got == _families(rows, threshold)


def test_families_of_long_texts_with_many_leaders(spark):
    rng = random.Random(3)
    stem = "".join(rng.choice("abcd ") for _ in range(400))
    texts = [stem[: rng.randrange(48, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    rows = [(i, "/p", "note", t, rng.randrange(5) / 10, rng.randrange(3), 0, False, rng.randrange(50), None) for i, t in enumerate(texts)]
    for threshold in (0.95, 0.97):
        got = {r.id: r.keeper for r in upkeep.lexical_families(spark.createDataFrame(rows, ROWS), threshold=threshold).collect()}
        assert got == _families(rows, threshold) and len(set(got.values())) > 40


def test_a_crowded_group_takes_few_rounds(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: saved.append(1) or save(self, *a, **k))
    opening, rng = "the same opening of all texts, " * 2, random.Random(5)
    rows = [(i, "/p", "note", opening + f"{rng.randrange(3000):06d}" * 12 + "." * rng.randrange(4), 0.1, 0, 0, False, rng.randrange(10**6), None) for i in range(10_000)]
    got = {r.id: r.keeper for r in upkeep.lexical_families(spark.createDataFrame(rows, ROWS)).collect()}
    assert len(saved) <= 16
    by_number = {}
    for r in rows:
        by_number.setdefault(r[3].rstrip("."), []).append(r)
    want = {}
    for own in by_number.values():  # texts of other numbers are too far apart
        want |= _families(own, 0.95)
    assert got == want and len(set(got.values())) > 2500


def test_families_make_only_nodes_that_a_text_needs(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: saved.append(save(self, *a, **k)) or saved[-1])
    stem = "the same opening of all texts, and more of it. " * 40
    rows = [(i, "/p", "note", stem[:n] + e, 0.1, i, 0, False, 5, None) for i, (n, e) in enumerate(((1800, ""), (1790, "x"), (1700, "é"), (900, "")))]
    got = {r.id: r.keeper for r in upkeep.lexical_families(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == _families(rows, 0.95)
    nodes = next(df for df in saved if df.columns == ["cls", "node", "own"])
    assert nodes.where("own").count() == 4 and nodes.count() <= 16  # not each of some 90 prefixes of a text


def test_needed_prefixes_of_columns(spark):
    for threshold in (0.95, 0.7, 0.97, 1.0):
        rows = spark.range(3000).select("id", upkeep.needed_prefix_of(F.col("id").cast("int"), threshold).alias("k")).collect()
        assert all(r.k == upkeep.needed_prefix(r.id, threshold) for r in rows)


def test_families_of_nothing_and_of_copies(spark):
    assert upkeep.lexical_families(spark.createDataFrame([], ROWS)).count() == 0
    copies = [(i, "/p", "note", "same text " * 9, 0.1, 0, 0, False, 5, None) for i in range(300)]
    got = upkeep.lexical_families(spark.createDataFrame(copies, ROWS)).collect()
    assert {(r.keeper, r.siblings) for r in got} == {(0, 299)} and len(got) == 300


def test_retention_plan_matches_gates(spark):
    now = 4_000_000_000_000
    rows = [(*r[:8], now - (5 if r[0] % 7 == 0 else 100) * 86_400_000, None) for r in _rows(120, 4)]
    links = [(1, 2, "supersedes", 0.9), (3, 4, "duplicate_of", None), (5, 5, "semantic", None), (6, 7, "supersedes", 0.5)]
    lf = spark.createDataFrame(links, "source_id long, target_id long, link_type string, confidence double")
    df = spark.createDataFrame(rows, ROWS).withColumn("shareable", F.col("id") == 11).withColumn("origin", F.when(F.col("id") == 12, "promotion"))
    plan = upkeep.retention_plan(df.drop("degree"), lf, upkeep.lexical_families(df, threshold=0.7), now, least_rows=10, most_archived=9)
    keep = _families(rows, 0.7)
    size = {k: list(keep.values()).count(k) for k in keep.values()}
    want, worth = {}, {}
    for r in rows:
        i, imp, acc = r[0], r[4], r[5]
        age = (now - r[8]) / 86_400_000
        trust = 0.5 * imp + 0.3 * min(math.log(acc + 1) / math.log(100), 1) + 0.2 * math.exp(-age / (30 * max(imp + 0.3 * math.log(acc + 1), 0.1)))
        deg, dup = sum(i in x[:2] for x in links), int(i == 3)
        score = round(0.4 * imp + 0.2 * min(math.log(acc + 1) / math.log(50), 1) + 0.1 * math.exp(-age / 30) + 0.15 * min(deg / 8, 1) + 0.15 * (0.5 if dup else 1), 6)
        gates = [(r[7], "pinned"), (i == 11, "shareable"), (i == 12, "promotion"), (i == 1, "adjudication_winner"), (i == 4, "dedupe_keeper"), (trust >= 0.7, "hot_tier"), (not dup and not (size[keep[i]] > 1 and keep[i] != i), "non_redundant"), (age < 14, "recently_used"), (score >= 0.35, "above_threshold"), (True, "low_retention")]
        want[i] = next(name for hit, name in gates if hit)
        worth[i] = score
    got = plan.collect()
    assert {r.id: r.reason for r in got} == want
    out = sorted((s, i) for i, s in worth.items() if want[i] == "low_retention")[:9]
    assert {r.id for r in got if r.archive} == {i for _, i in out} and len(out) == 9
    small = upkeep.retention_plan(df.drop("degree"), lf, upkeep.lexical_families(df), now).select("reason").distinct().collect()
    assert [r.reason for r in small] == ["corpus_too_small"]


def test_repointed_links(spark):
    links = spark.createDataFrame([(1, 9, "semantic", 0.1), (2, 9, "semantic", 0.2), (1, 2, "semantic", 0.3), (9, 2, "conflicts", 0.4)], "source_id long, target_id long, link_type string, similarity double")
    plan = spark.createDataFrame([(2, 1)], "id long, keeper long")
    assert sorted(map(tuple, upkeep.repointed(links, plan).collect())) == [(1, 9, "semantic", 0.1), (9, 1, "conflicts", 0.4)]


def test_task_items_keep_the_last_word(spark):
    events = [("t", 1, "plan", "a", "draft", "open"), ("t", 2, "plan", "a", None, "done"), ("t", 3, "plan", "b", "x", None), ("t", 4, "plan", "b", None, "removed")]
    got = upkeep.task_state(spark.createDataFrame(events, "task_id string, seq int, kind string, item_id string, text string, status string")).collect()
    assert [tuple(r) for r in got] == [("t", "plan", "a", "draft", "done", 1, 2)]


def test_purge_follows_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "parent long, child long")
    left = upkeep.purge(spark.range(8), edges, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [0, 4, 5, 6, 7]


def test_sections_pass_on_what_is_left(spark):
    schema = "query_id int, id int, place int, chars int"
    a = spark.createDataFrame([(1, 1, 1, 30), (1, 2, 2, 80)], schema)
    b = spark.createDataFrame([(1, 1, 1, 10), (1, 3, 2, 65), (1, 4, 3, 9), (2, 5, 1, 95)], schema)
    got = allocation.assemble({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, 100).collect()
    assert sorted((r.query_id, r.id, r.section) for r in got) == [(1, 1, "a"), (1, 3, "b"), (2, 5, "b")]


def test_policies_reserve_and_refuse(spark):
    units = spark.createDataFrame([(1, 7, 0, 5, "user", 10), (1, 8, 0, 0, "assistant", 500), (1, 7, 1, 1, "user", 20)], "query_id int, session_id int, position int, rank int, role string, chars int")
    got = allocation.ordered(units, "breadth-first", reserve=1).orderBy("place").collect()
    assert [(r.session_id, r.position) for r in got] == [(8, 0), (7, 1), (7, 0)]
    with pytest.raises(ValueError):
        allocation.ordered(units, "best")


def test_archive_redacts(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % (1 << 32)
        return f"{h:08x}"

    names = ["/home/u", "/home/u/x//s", "/work/a/pay//b//c", "~/k", "plain", "", "/", "/home/user2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.select(archive.redact_namespace(F.col("n"), "/home/u").alias("n")).collect()]
    assert got == ["~", "~/x//s", f"ext/pay-{fnv('/work/a/pay')}//b//c", "~/k", "plain", "", f"ext/root-{fnv('/')}", f"ext/user2-{fnv('/home/user2')}"]
    one = spark.createDataFrame([("see /Users/ann/x and /home/bob",)], "t string").select(archive.scrub_homes(F.col("t")).alias("t")).first().t
    assert one == "see ~/x and ~"
    assert archive.importable({"schema": 3, "model": "m", "dim": 2}, 3, "m", 2) == [] and len(archive.importable({"schema": 4, "model": "m", "dim": 2}, 3, "n", 2)) == 2


def test_stems_and_answers():
    pairs = "caresses caress ponies poni flies fli dies die agreed agre hopping hop falling fall filing file happy happi enjoy enjoy relational relat conditional condit rational ration radically radic hopefulness hope adoption adopt controlling control cease ceas geology geolog dying die hopefully hope replacement replac effective effect".split()
    assert [answers.stem(w) for w in pairs[::2]] == pairs[1::2]
    assert answers.f1("the running dogs", "dog runs and") == 1.0 and answers.f1("", "x") == 0.0
    assert answers.f1_parts("cats, birds", "cat, fish") == 0.5


def test_answer_categories(spark):
    rows = [("not mentioned here", "x", 5), ("red", "red; blue", 3), (None, "x", 2)]
    df = spark.createDataFrame(rows, "p string, t string, c int")
    assert [r.s for r in df.select(answers.answer_score("p", "t", "c").alias("s")).collect()] == [1.0, 1.0, 0.0]


def test_json_values():
    assert json_values.canonical('{"b": 1.0, "a": [true, null, 2.5]}') == '{"a":[true,null,2.5],"b":1}'
    assert json_values.canonical("{") is None and json_values.canonical(None) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}
    assert json_values.value_fault('{"a": 1}', schema) is None
    assert [json_values.value_fault(t, schema) for t in ('{"a": "1"}', "{}", '{"a": 1, "b": 2}', "[")] == ["$.a: not integer", "$.a: missing", "$.b: unknown", "$: not JSON"]
    assert json_values.value_fault("[" * 13 + "]" * 13, {}) == "$: too deep"


def test_bootstrap_matches_one_stream(spark):
    pairs = [(i, float(i % 3 == 0), float(i % 2)) for i in range(40)]
    got = evaluation.paired_bootstrap(spark.createDataFrame(pairs, "id int, a double, b double"), seed=5, label="x", resamples=200).first()
    state, m, means = evaluation.stream_seed(5, "x"), 0xFFFFFFFF, []
    for _ in range(200):
        total = 0.0
        for _ in pairs:
            state = (state + 0x6D2B79F5) & m
            t = ((state ^ (state >> 15)) * (state | 1)) & m
            t = ((t + ((t ^ (t >> 7)) * (t | 61) & m)) & m) ^ t
            _, a, b = pairs[min(39, int((t ^ (t >> 14)) / 2**32 * 40))]
            total += a - b
        means.append(total / 40)
    assert (got.n, got.ci_low, got.ci_high) == (40, pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    assert evaluation.paired_bootstrap(spark.createDataFrame([], "id int, a double, b double")).first().n == 0


def test_entities_and_their_search(spark):
    df = spark.createDataFrame([(1, 10, "see src/a/Main.ts, class Parser and parser() fetchUser( HTTP_CODE"), (2, 20, None), (3, 30, "`parser` TypeError: bad")], "id long, created_at long, content string")
    rows = df.select("id", F.explode(entities(F.col("content"))).alias("e")).select("id", "e.*").collect()
    assert [tuple(r) for r in rows] == [(1, "src/a/Main.ts", "file_path"), (1, "fetchUser", "function"), (1, "Parser", "class"), (1, "HTTP_CODE", "symbol"), (3, "parser", "symbol"), (3, "TypeError: bad", "error")]
    named = channels.entity_rows(df)
    assert [r.memory_id for r in channels.entity_lookup(named, "PARSER").collect()] == [3, 1]
    assert [r.id for r in channels.entity_search(named, ["fetch"]).collect()] == [1]
    assert df.select(entity_terms(F.lit("where is fetchUser of db")).alias("t")).first().t == ["fetch", "user"]


def test_common_prefix_and_rules(spark):
    df = spark.createDataFrame([("abcd", "abxd", 2), ("", "a", 0), ("same", "same", 4), ("aé😀b", "aé😀c", 3)], "a string, b string, n int")
    assert all(r.p == r.n for r in df.select(text.common_prefix(F.col("a"), F.col("b")).alias("p"), "n").collect())
    rule = lambda t: spark.range(1).select(upkeep.admission(F.lit(t)).alias("a")).first().a
    assert [tuple(rule(t)) for t in ("key AKIA" + "A" * 16, "<b></b>", "ok", "no issues found in the drill", "it works as told")] == [("reject", "secrets"), ("reject", "junk"), ("warn", "junk"), ("warn", "negative-result"), ("allow", None)]
    assert sum(scoring.WEIGHT_PROFILES["lookup"].values()) == pytest.approx(1.0)


def test_rules_are_tried_where_they_can_fit(spark):
    old = F.length(F.regexp_replace(F.regexp_replace("t", "<[^>]*>", " "), "[^A-Za-z0-9]", ""))
    old = F.when(F.coalesce(old, F.lit(0)) == 0, "empty").when(F.length("t") > text.MOST_CHARS, "too long").when(old < text.LEAST_ALNUM, "thin")
    shapes = F.coalesce(*[F.when(F.col("t").rlike(text.ascii_bounds(p)), F.lit(k)) for k, p in text.SECRET_SHAPES.items()])
    texts = [None, "", "é—", "<b>abc</b>", "<b>a b c d e f g</b> h", "a<b", "<abcdefgh", "1234567", "1 2 3\n4 5é6 7 8", "a" * 24_001, "é" * 24_001, "-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "B" * 16, "xAKIA" + "B" * 16, "ghp_" + "a1" * 18, "xoxb-0123456789ab", "sk-" + "a" * 20, "AIza" + "b" * 35]
    texts += ["eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 5, "Postgres://me:secret@host", "AUTHORIZATION: " + "q" * 16, "Bearer " + "z" * 16, "My Password is hunter2222", "API-KEY = abcd1234", "apikey:" + "x" * 16, "pwd: short", "a token of thanks"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", old.alias("j"), text.junk_reason(F.col("t")).alias("junk"), shapes.alias("s"), text.secret_shape(F.col("t")).alias("shape")).collect()
    assert all((r.j, r.s) == (r.junk, r.shape) for r in rows) and {r.s for r in rows} == {None, *text.SECRET_SHAPES} and {r.j for r in rows} == {None, "empty", "too long", "thin"}
    plan = df.select(upkeep.admission(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Za-z0-9], " not in plan  # no text is replaced character by character


def test_compared_reads_its_rows_once(spark):
    from recallspark.operators import runs

    rows = [(s, q, "a" if q % 2 else "b", (q * 7 + i) % 3 > 0) for q in range(60) for i, s in enumerate(("x", "y", "z")) if q % 9 or i]
    graded = spark.createDataFrame(rows, "system string, question_id long, question_type string, correct boolean")
    out = runs.compared(graded, by_type=True)
    assert len(out.inputFiles()) < 3 and "question_id" not in out._jdf.queryExecution().optimizedPlan().toString()  # the grades are not gone through again
    right, got = {(s, q): c for s, q, _, c in rows}, {(r["question_type"], r["left"], r["right"]): (r["n"], r["only_left"]) for r in out.collect()}
    asked = lambda t: [q for q in range(60) if q % 9 and ("a" if q % 2 else "b") == t]
    assert got == {(t, a, b): (len(asked(t)), sum(right[a, q] and not right[b, q] for q in asked(t))) for t in "ab" for a, b in ("xy", "xz", "yz")}


def test_entities_of_odd_spaces_are_those_of_sql(spark):
    text_ = "https://ac.org/o\x0bx fetchUser\x0b( \u2028#other\r#made\nError: bad\xa0\n`İx` Error: ix \nError: İx"
    rows = spark.createDataFrame([(text_,)], "t string").select(F.explode(entities(F.col("t"))).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in rows] == [("#made", "symbol"), ("https://ac.org/o\x0bx", "url"), ("Error: bad", "error"), ("Error: ix", "error")]


def test_admission_refuses_bursts(spark):
    long = "the nightly drill of the queue ends with this very line "
    stored = [(i, "/a" if i < 20 else "/b", "note", f"{long}{i}", i == 3, 0.5, 0, 1000 + i, None) for i in [*range(1, 8), *range(21, 26)]]
    stored += [(30 + i, "/a", "fact", f"{long}{i}", False, 0.5, 0, -i * 700_000_000, None) for i in range(5)] + [(40 + i, "/c", "note", f"{long}{i}", False, 0.5, 0, 1000, 5 if i == 0 else None) for i in range(5)]
    stored = spark.createDataFrame(stored, "id long, namespace string, type string, content string, pinned boolean, importance double, access_count int, created_at long, archived_at long")
    # 25 is superseded from its own namespace, so four of /b are left; the link from /b leaves all of /a
    links = spark.createDataFrame([(24, 25, "supersedes", 0.9), (21, 1, "supersedes", 0.9), (1, 2, "supersedes", 0.5)], "source_id long, target_id long, link_type string, confidence double")
    texts = [("/a", "note", long), ("/b", "note", long), ("/a", "fact", long), ("/c", "note", long), ("/a", "note", long + "AKIA" + "A" * 16), ("/a", "note", long + "no issues found"), ("/a", "note", "ok"), (None, "note", long), ("/a", "note", None)]
    writes = spark.createDataFrame([(i, *t, []) for i, t in enumerate(texts)], "id int, namespace string, type string, content string, tags array<string>")
    got = {r.id: (r.action, r.rule, r.existing_id) for r in upkeep.admitted(writes, stored, links, 1000).collect()}
    assert [got[i] for i in range(9)] == [("reject", "burst", 3), ("allow", None, None), ("allow", None, None), ("allow", None, None), ("reject", "secrets", None), ("reject", "burst", 3), ("warn", "junk", None), ("allow", None, None), ("reject", "junk", None)]
    mild = {r.id: (r.action, r.rule, r.warnings) for r in upkeep.admitted(writes, stored, links, 1000, by_agent=F.lit(False)).collect()}
    assert (mild[0], mild[4], mild[5]) == (("warn", "burst", ["burst"]), ("reject", "secrets", []), ("warn", "negative-result", ["negative-result", "burst"]))
    tagged = spark.createDataFrame([(1, "/z", "note", "a plain sentence", ["AKIA" + "A" * 16])], writes.schema)
    assert upkeep.admitted(tagged, stored, links, 1000).first().rule == "secrets"


def test_mcnemar_of_large_counts(spark):
    from math import comb

    pairs = [(0, 0), (0, 1), (3, 3), (1, 9), (0, 40), (12, 30), (15, 16), (200, 260), (1500, 1500), (1200, 1400)]
    exact = [min(1.0, 2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) for b, c in pairs]
    df = spark.createDataFrame([*pairs, (39_390, 39_342), (4_000_000, 3_996_000), (3_000_000_000, 2_999_800_000)], "b long, c long")
    p = [r.p for r in df.select(evaluation.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    assert p[: len(exact)] == pytest.approx(exact, rel=1e-12)
    # of large counts the normal tail with continuity is near
    normal = lambda b, c: math.erfc((abs(b - c) - 1) / math.sqrt(2 * (b + c)))
    assert p[len(exact) :] == pytest.approx([normal(39_390, 39_342), normal(4_000_000, 3_996_000), normal(3_000_000_000, 2_999_800_000)], rel=1e-3)
