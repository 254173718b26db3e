"""Text functions as Column expressions, and the few that need Python behind Arrow."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unmarked() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters."""
    pairs = ((chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.category(x).startswith("M"))) for c in range(0xC0, 0x2000))
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BASE = _unmarked()


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _respaced(text: Column) -> Column:
    r"""Each run of other characters than ASCII letters and digits as one space.

    Java looks ``\P{Alnum}`` up in a table, several times faster than it tries ranges; a split is cheaper than replacing every run.
    """
    return F.array_join(F.split(text, r"\P{Alnum}+"), " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, without marks; for ASCII runs of a-z and 0-9.

    Letters beyond U+2000 that are composed with marks stay as they are.
    """
    return _words(folded(text))


def folded(text: Column) -> Column:
    """Lower-case text without marks, whose runs of letters and digits are its tokens."""
    marked = F.regexp_replace(F.translate(text, _MARKED, _BASE), r"\p{M}+", "")
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(marked)  # ASCII has no marks
    return F.lower(plain)


def _words(text: Column) -> Column:
    # the first class, ASCII of the others, is looked up in a table
    return F.filter(F.split(text, r"[^\p{Alnum}\p{L}\p{N}]+"), lambda t: t != "")


def token_count(text: Column, term: str, prefix: bool = False) -> Column:
    """Tokens of a folded text that equal the term, or begin with it."""
    listed = F.size(F.filter(_words(text), lambda t: t.startswith(term) if prefix else t == term))
    if not term or any(unicodedata.category(c)[0] not in "LN" or ord(c) > 0xFFFF for c in term):
        return listed
    # the term itself is looked for first, then what stands around it: no list of words is made
    found = F.regexp_count(text, F.lit(rf"{term}(?<![\p{{L}}\p{{N}}]{term})" + ("" if prefix else r"(?![\p{L}\p{N}])")))
    # Java looks behind by halves of characters beyond U+FFFF
    halves = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(halves, listed).otherwise(found)


def query_tokens(query: Column) -> Column:
    return F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")


def split_identifiers(query: Column) -> Column:
    """Camel case and joined words, taken apart by spaces."""
    apart = F.regexp_replace(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(apart, r"[_.\-/:]+", " "), r"\s+", " "))


def normalize_identifiers(text: Column) -> Column:
    """Split form and glued form of a text's identifiers, lower case."""
    glued = _respaced(F.regexp_replace(text, "[_-]", ""))
    parts = _respaced(F.regexp_replace(F.regexp_replace(text, r"(\p{Upper})(?<=[\p{Lower}\p{Digit}]\p{Upper})", " $1"), r"(\p{Upper})(\p{Upper}\p{Lower})", "$1 $2"))
    return F.trim(F.lower(F.concat_ws(" ", parts, glued)))


def rare_tokens(query: Column) -> Column:
    """Tokens with capitals, digits or joints, or of nine characters and more; null if none or all."""
    tokens = query_tokens(query)
    rare = F.filter(tokens, lambda t: t.rlike(r"[A-Z_./:\d]") | (F.length(t) >= 9))
    return F.when((F.size(rare) > 0) & (F.size(rare) < F.size(tokens)), F.concat_ws(" ", rare))


def expand_query(query: Column, most: int = 4) -> Column:
    """The query and its variants, without repeats, at most so many."""
    tokens = query_tokens(query)
    phrase = F.when(F.size(tokens) > 1, F.concat(F.lit('"'), F.concat_ws(" ", tokens), F.lit('"')))
    return F.slice(F.array_distinct(F.array_compact(F.array(query, split_identifiers(query), phrase, rare_tokens(query)))), 1, most)


def state_key(raw: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(raw), r"\s+", " "))
    return F.when((F.length(key) > 0) & (F.length(key) <= 200), key)


def normalize_answer(answer: Column) -> Column:
    bare = F.regexp_replace(F.lower(answer), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, most: int = 120) -> Column:
    return F.substring(F.trim(F.get(F.split(text, "[.!?]"), F.lit(0))), 1, most)


def ancestors(path: Column) -> Column:
    """Prefixes of a namespace path, the root's first child first; ``//`` starts a synthetic scope."""
    marked = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "//", "/\u0001"), "/")
    prefix = lambda i: F.concat(F.lit("/"), F.regexp_replace(F.array_join(F.slice(marked, F.lit(1), i), "/"), "/\u0001", "//"))
    return F.transform(F.sequence(F.lit(1), F.size(marked)), prefix)


#: Shapes of secrets in order; the first that fits names the reason.
SECRET_SHAPES = {
    "a private key block": r"-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY-----",
    "an aws access key id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "a github token": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "a slack token": r"\bxox[abpros]-[A-Za-z0-9-]{10,}",
    "an api key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "a google api key": r"\bAIza[0-9A-Za-z_-]{35}",
    "a json web token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "credentials in a connection string": r"(?i)\b[a-z][a-z0-9+.-]*:\/\/[^\s:@/]+:[^\s@/]{3,}@",
    "an authorization header": r"(?i)\bauthorization\s*:\s*\S{16,}",
    "a bearer token": r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]{16,}",
    "a password or key with its value": r"""(?i)\b(?:api[_-]?key|apikey|access[_-]?key|client[_-]?secret|private[_-]?key|secret|token|passw(?:or)?d|passwd|pwd)\b\s*(?:[:=]|\bis\b)\s*["']?(?:[A-Za-z0-9!@#$%^&*_+-]{16,}|[A-Za-z0-9!@#$%^&*_+-]*\d[A-Za-z0-9!@#$%^&*_+-]{4,})""",
}

#: What a text with such a secret holds: parts that are looked for before the shape is tried, all of them, or a pattern without bounds.
_SECRET_SIGNS = {
    "a private key block": ("-----BEGIN", "PRIVATE KEY-----"),
    "a github token": ("gh", "_"),
    "a slack token": ("xox",),
    "an api key": ("sk-",),
    "a google api key": ("AIza",),
    "a json web token": ("eyJ", "."),
    "credentials in a connection string": ("://", "@"),
    "an aws access key id": "AKIA|ASIA",
    "an authorization header": "(?i)authorization",
    "a bearer token": "(?i)bearer",
    "a password or key with its value": "(?i)key|secret|token|passw|pwd",
}

#: Claims of mere absence.
ABSENCE_CLAIMS = (
    r"(?i)\bnone of (?:these|those|the|them)\b",
    r"(?i)\bnothing (?:found|to report|to add|to note|actionable|came of|durable|notable|new|changed|happened)\b",
    r"(?i)\bno (?:new |further |additional )?(?:issues?|findings?|problems?|bugs?|errors?|failures?|regressions?|decisions?|changes?|results?|blockers?|actions?|action items?|information|evidence)\b",
    r"(?i)\bno (?:durable|useful|actionable|relevant|specific|notable) (?:[\w-]+ ){0,2}(?:decision|finding|result|change|information|evidence|task|action)\b",
    r"(?i)\b(?:could not|couldn't|unable to) (?:find|reproduce|confirm|locate|identify)\b",
    r"(?i)\bnot (?:found|reproducible|applicable|an issue|reproduced)\b",
    r"(?i)\bno (?:further )?(?:action|investigation) (?:needed|required|necessary)\b",
)

#: Patterns of query archetypes, in order of precedence.
ARCHETYPES = {
    "temporal": r"(?i)\b(yesterday|today|recent(?:ly)?|last\s+(?:week|session|time|month|day)|ago|earlier|previous(?:ly)?|this\s+(?:morning|week|month))\b",
    "lookup": r"\b[a-z]+[A-Z][a-zA-Z]*\b|\b[a-z]+_[a-z]+\b|\b[A-Z][A-Z0-9]+_[A-Z][A-Z0-9]+\b|`[^`]+`|0x[0-9a-fA-F]+",
    "frequentist": r"(?i)\b(common(?:ly)?|frequent(?:ly)?|often|always|usually|pattern|convention|standard|best\s+practice|typical(?:ly)?)\b",
    "aggregation": r"(?i)\b(how many|how much|how often|how long|in total|total|altogether|combined|sum|number of|all the|list)\b",
}

MOST_CHARS, LEAST_ALNUM = 24_000, 8


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with each ``\b`` between ASCII word characters and others, which Java's is not in all versions."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def as_re2(pattern: str) -> str:
    r"""The pattern for Java, as RE2 reads it: ``\s`` is no vertical tab, and lines end at a line feed only."""
    spaces = r"\t\n\f\r "
    apart = ascii_bounds(pattern).replace(r"[^\s", f"[^{spaces}").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    return apart.replace("(?m)", "(?md)")


def secret_shape(text: Column) -> Column:
    def fits(kind: str, pattern: str) -> Column:
        signs, shape = _SECRET_SIGNS[kind], text.rlike(as_re2(pattern))
        if isinstance(signs, str):
            return text.rlike(signs) & shape
        for sign in reversed(signs):
            shape = text.contains(sign) & shape
        return shape

    return F.coalesce(*[F.when(fits(k, p), F.lit(k)) for k, p in SECRET_SHAPES.items()])


def junk_reason(text: Column) -> Column:
    """'empty' and 'too long' are refused, 'thin' is only warned of; null is fine."""
    # read up to the first letters and digits only; texts without a tag are taken as they are
    plain = F.when(text.contains("<"), F.regexp_replace(text, "<[^>]*>", " ")).otherwise(text)
    some, enough = plain.rlike("[A-Za-z0-9]"), plain.rlike("(?:[A-Za-z0-9][^A-Za-z0-9]*+){%d}" % LEAST_ALNUM)
    return F.when(~F.coalesce(some, F.lit(False)), "empty").when(F.length(text) > MOST_CHARS, "too long").when(~enough, "thin")


def claims_absence(text: Column) -> Column:
    """Says only that nothing was found; a digit or a code span makes it a claim of something."""
    any_of = F.lit(False)
    for p in ABSENCE_CLAIMS:  # without its bounds, which are slow to look for, a claim is tried first
        any_of = any_of | (text.rlike(p.replace(r"\b", "")) & text.rlike(as_re2(p)))
    return ~text.rlike(r"\d|`") & any_of


def query_kind(query: Column) -> Column:
    """Archetype of a query: the first pattern that fits, else semantic."""
    return F.coalesce(*[F.when(query.rlike(ascii_bounds(p)), F.lit(k)) for k, p in ARCHETYPES.items()], F.lit("semantic"))


def common_prefix(a: Column, b: Column, bits: int = 25) -> Column:
    """Length of the longest common prefix, by halving; texts up to 2**bits characters."""
    most = F.least(F.length(a), F.length(b))
    step = lambda n, p: F.when((n + p <= most) & (F.substring(a, F.lit(1), n + p) == F.substring(b, F.lit(1), n + p)), n + p).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)]), F.lit(0), step)


def prefix_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(common_prefix(a, b) / longest)


def mentions(content: Column, scope: str) -> Column:
    """Holds the scope's name as a word of its own."""
    return content.rlike(r"(?i)(^|[^A-Za-z0-9_])" + re.escape(scope) + r"($|[^A-Za-z0-9_])")


def quoted_terms(query: Column) -> Column:
    """What stands in double quotes, each once, in order; doubled quotes inside stand for one."""
    found = F.regexp_extract_all(query, F.lit(r'"((?:[^"]|"")*)"'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.replace(t, F.lit('""'), F.lit('"'))), lambda t: t != ""))


def shared_rare_tokens(a: Column, b: Column, common: list[str], least: int = 4) -> Column:
    """Tokens that both texts hold, but for common ones and short ones."""
    both = F.array_intersect(tokens(a), tokens(b))
    return F.filter(F.array_except(both, F.array(*map(F.lit, common)) if common else F.array().cast("array<string>")), lambda t: F.length(t) >= least)


def exact_match(text: Column, answers: Column) -> Column:
    """Holds any of the answers (array of arrays) as a part, after normalising both."""
    plain = normalize_answer(text)
    return F.exists(F.flatten(answers), lambda a: plain.contains(normalize_answer(a)))


def line_chunks(text: Column, size: int) -> Column:
    """Whole lines joined to chunks of at most ``size`` characters; a longer line is a chunk of its own."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"), F.lit(True).alias("none"))

    def add(acc: Column, line: Column) -> Column:
        fits = ~acc["none"] & (F.length(acc["open"]) + 1 + F.length(line) <= size)
        done = F.when(fits | acc["none"], acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, F.concat(acc["open"], F.lit("\n"), line)).otherwise(line).alias("open"), done.alias("done"), F.lit(False).alias("none"))

    return F.aggregate(F.split(text, "\n"), start, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


#: Words that an archive's query does without.
ARCHIVE_STOPWORDS = (
    "a about an and are as at be been but by "
    "can could did do does for from had has have "
    "how i if in into is it its me my not of "
    "on or our should so than that the their them "
    "then there these they this to was we were what "
    "when where which who why will with would you your"
).split()


def archive_tokens(query: Column, most: int = 12) -> Column:
    """Words of a query to an archive: letters, digits and underscores, two characters at least, no stopwords."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    kept = F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*ARCHIVE_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def iso_day(at: Column) -> Column:
    return F.date_format(F.timestamp_millis(at), "yyyy-MM-dd")


def retry_delay(attempt: Column, base_ms: int = 1000, most_ms: int = 60_000, jitter: Column | None = None) -> Column:
    """Doubles with each attempt up to a bound; ``jitter`` (0 to 1) takes up to half of it away."""
    full = F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), attempt))
    return F.floor(full * (1 - 0.5 * jitter)) if jitter is not None else F.floor(full)


def value_index(at: Column, start: Column, step_ms: int, values: int) -> Column:
    """Index of a slot's value at a time, where values change every ``step_ms``; null before the first."""
    return F.when(at >= start, F.least(F.floor((at - start) / step_ms), F.lit(values - 1)))
