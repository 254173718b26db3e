"""Words counted without lists of them, and texts normalised once for each row."""

import re

import pytest
from pyspark.sql import functions as F

from recallspark.functions.text import folded, normalize_identifiers, token_count, tokens
from recallspark.operators import channels
from recallspark.plans.scratch import Scratch

TEXTS = ["", " ", "aB1C ABCd É_a-b ÀB", "x\U0001d400the the𝟏 ①the ⅷ the", "fooBarHTTPServer2X", "thé THE é́ other", "𐐀the🙂the", "the,the;THE the", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, content string")


@pytest.mark.parametrize("prefix", [False, True])
def test_counts_are_those_of_the_lists(texts, prefix):
    for term in ("the", "o", "1", "é", "", "a b"):
        rows = texts.select(tokens(F.col("content")).alias("t"), token_count(folded(F.col("content")), term, prefix).alias("n")).collect()
        for r in rows[:-1]:
            assert r.n == sum(t.startswith(term) if prefix else t == term for t in r.t), (term, r)


def test_identifiers_as_by_replacing(texts):
    for r in texts.select("content", normalize_identifiers(F.col("content")).alias("n")).collect():
        if r.content is None:
            continue
        parts = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", r.content))
        want = " ".join(re.sub("[^A-Za-z0-9]+", " ", t) for t in (parts, re.sub("[_-]", "", r.content)))
        assert r.n == want.lower().strip(" ")


def test_texts_are_normalised_once(texts, monkeypatch):
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, *a))[1])
    got = channels.identifier_search(texts, ["the", "server"]).collect()
    assert [plan.count("concat_ws(") for plan in plans] == [1]
    assert {r.id for r in got} == {i for i, t in enumerate(TEXTS) if t and any(w in re.split("[^a-z0-9]+", t.lower()) for w in ("the", "server"))}


def test_entities_are_found_once(spark):
    many = " ".join(f"A_{i:03d} a_{i % 40:03d}" for i in range(50))
    texts = [many, "see src/a.py and SRC/A.PY, class Tree `Tree` import x from 'y/z'", "fooBar (1) *.tsx #tag https://a.b/c TypeError: no\nError: yes", "const f = ( require('q') interface Box type Kind function go", "nothing here", None]
    rows = channels.entity_rows(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, content string, created_at long"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("flatten(") == 1
    got = [[(r.entity_text, r.entity_type) for r in rows.where(f"memory_id = {i}").collect()] for i in range(6)]
    assert got[0] == [(f"A_{i:03d}", "symbol") for i in range(30)] and got[4:] == [[], []]
    assert got[1] == [("src/a.py", "file_path"), ("Tree", "class"), ("SRC", "symbol"), ("y/z", "library")]
    assert got[2] == [("*.tsx", "file_path"), ("fooBar", "function"), ("#tag", "symbol"), ("https://a.b/c", "url"), ("TypeError: no", "error"), ("Error: yes", "error")]
    assert got[3] == [("go", "function"), ("f", "function"), ("Box", "class"), ("Kind", "class"), ("q", "library")]
