"""Fill-in-middle against regular expressions, exact round trips and edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from recallspark.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOC = "doc_id long, text string, form string, n long, output string"


def slow(doc_id, text, unit="word"):
    text = text or ""
    units = list(text) if unit == "char" else TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    alphabet = list("ab<S>PM \t\n\x85\xa0é中\U0001f600")
    out = [(i, "".join(rng.choice(alphabet, rng.integers(0, 25)))) for i in range(400)]
    out += [(i, t) for i, t in enumerate(["", None, " ", "one", " one ", "<P>x", "a<S", "<" * 9, "\n\n x", "S>a <", "M> b <"], 400)]
    out += [(None, "no id here"), (None, None), (None, "no id here"), (7, "same id"), (7, "same id"), (9223372036854775807, "a b c"), (-1, "d e f")]
    return out + [(1000, " ".join(f"w{i}" for i in range(400_000))), (1002, "x" * 3_000_000), (1003, "é \n" * 700_000)]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_same_as_by_regular_expression(spark, rows, unit):
    docs = spark.createDataFrame([(i, t, "clash", 5, None) for i, t in rows], DOC).repartition(3)
    out = fill_middle.fill_in_middle(docs, unit=unit)
    got = out.select("*", fill_middle.restored().alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(slow(i, t, unit) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_no_rows_and_other_rates(spark, rows):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOC)).count() == 0
    docs = spark.createDataFrame([(i, t) for i, t in rows[:60]], "id long, body string")
    forms = {r.form for r in fill_middle.fill_in_middle(docs, rate=100, spm_rate=0, id_col="id", text_col="body").collect()}
    assert forms == {"plain", "psm"}
    assert {r.form for r in fill_middle.fill_in_middle(docs, rate=0, id_col="id", text_col="body").collect()} == {"plain"}
