"""Answer scores that need stems: Porter's stemmer with its common extensions, and token F1.

Stems are found once per distinct word of a batch; everything runs behind Arrow.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Words whose stem the rules would miss.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

#: Endings of Porter's second, third and fourth steps.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Letters as c or v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    s = _shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if "v" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _swap(w: str, rules: tuple, least: int) -> str:
    """The longest ending that fits, swapped if the measure before it is above ``least``."""
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            if end == "ion" and stem[-1:] not in ("s", "t"):
                continue
            return stem + new if _measure(stem) > least else w
    return w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _swap(w, STEP2, 0)
    w = _swap(_swap(w, STEP3, 0), tuple((e, "") for e in STEP4), 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _tokens(text: str) -> list[str]:
    bare = text.replace(",", "").lower().translate(str.maketrans("", "", string.punctuation))
    return [stem(t) for t in re.sub(r"\b(a|an|the|and)\b", " ", bare).split()]


def f1(prediction: str, truth: str) -> float:
    """F1 of the two bags of stems; 0 where either is empty."""
    p, t = _tokens(prediction), _tokens(truth)
    same = sum((Counter(p) & Counter(t)).values())
    return 2 * same / (len(p) + len(t)) if same else 0.0


def f1_parts(prediction: str, truth: str) -> float:
    """Mean over the truth's parts between commas of the best part of the prediction."""
    best = [max(f1(p.strip(), t.strip()) for p in prediction.split(",")) for t in truth.split(",")]
    return sum(best) / len(best)


def _score(prediction: str | None, truth: str | None, category: int) -> float:
    p, t = prediction or "", truth or ""
    if category == 5:
        return float("no information available" in p.lower() or "not mentioned" in p.lower())
    if category == 1:
        return f1_parts(p, t)
    if category in (2, 3, 4):
        return f1(p, t.split(";")[0].strip() if category == 3 else t)
    raise ValueError(f"category {category} is none of the five")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of arrays of words; null gives null."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


@F.pandas_udf(DoubleType())
def answer_score(prediction: pd.Series, truth: pd.Series, category: pd.Series) -> pd.Series:
    """Score of an answer by the rule of its question's category; null texts count as empty."""
    return pd.Series([_score(p, t, int(c)) for p, t, c in zip(prediction, truth, category)])

