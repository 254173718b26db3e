"""Entities named in a text, and the terms of a query that looks for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.text import as_re2, once

#: Fixed values: (type, pattern, group) in the order in which they are tried.
ENTITY_RULES = (
    ("file_path", r"(?:\.{1,2}\/|\/)?(?:[A-Za-z0-9._-]+\/)+[A-Za-z0-9._-]+\.[A-Za-z0-9]{1,8}\b", 0),
    ("file_path", r"\*\.[A-Za-z0-9]{1,8}\b", 0),
    ("function", r"\bfunction\s+([A-Za-z_$][\w$]*)\b", 1),
    ("function", r"\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*\(", 1),
    ("function", r"\b([a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)\s*\(", 1),
    ("class", r"\bclass\s+([A-Z][\w$]*)\b", 1),
    ("class", r"\binterface\s+([A-Z][\w$]*)\b", 1),
    ("class", r"\btype\s+([A-Z][\w$]*)\b", 1),
    ("symbol", r"`([A-Za-z_$#][\w$-]*)`", 1),
    ("symbol", r"\b([A-Z][A-Z0-9_]{2,})\b", 1),
    ("symbol", r"(?m)(^|\s)(#[A-Za-z][\w-]*)\b", 2),
    ("library", r"""\bimport\s+[^'"\n]+\s+from\s+['"]([^'"]+)['"]""", 1),
    ("library", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", 1),
    ("url", r"""https?:\/\/[^\s)\]}>"']+""", 0),
    ("error", r"\b(?:[A-Za-z]+Error|Error):\s*[^\n]+", 0),
)
#: What a text must hold for each of them to fit anywhere, as a part or, in a tuple, by a cheap pattern.
ENTITY_NEEDS = ("/", "*.", "function", "const", "(", "class", "interface", "type", "`", (r"\p{Upper}[\p{Upper}\p{Digit}_]{2}",), "#", "import", "require(", "://", "Error:")
MOST_ENTITIES = 30

#: Spaces of Unicode (Zs), which the twin's trim takes off. The two letters that Java lowers to more than one character, or by their place.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_ALONE = ("İΣ", "iσ")

#: Words that a query for entities passes over.
ENTITY_STOPWORDS = (
    "the", "and", "for", "from", "this", "that", "with", "was", "were", "are",
    "how", "does", "did", "what", "when", "where", "which", "why", "who", "into",
    "over", "under", "its", "our", "their", "have", "has", "had", "can", "not",
    "but", "any", "all", "use", "used", "using", "about",
)


def entities(text: Column) -> Column:
    """Array of (entity_text, entity_type), at most thirty; the first of spellings that differ in case stays."""

    def found(kind: str, pattern: str, group: int, need: str | tuple[str]) -> Column:
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(as_re2(pattern)), F.lit(group))
        needed = text.contains(need) if isinstance(need, str) else text.rlike(need[0])
        hits = F.when(needed, hits).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, lambda x: F.struct(F.trim(x, F.lit(_SPACES)).alias("entity_text"), F.lit(kind).alias("entity_type")))

    every = F.filter(F.flatten(F.array(*[found(*rule, need) for rule, need in zip(ENTITY_RULES, ENTITY_NEEDS, strict=True)])), lambda e: e["entity_text"] != "")
    keys = lambda found: F.transform(found, lambda e: F.lower(F.translate(e["entity_text"], *_ALONE)))
    first = lambda found, k: F.transform(F.slice(F.array_distinct(k), 1, MOST_ENTITIES), lambda x: F.get(found, (F.array_position(k, x) - 1).cast("int")))
    return once(every, lambda found: once(keys(found), lambda k: first(found, k)))


def entity_terms(query: Column) -> Column:
    """Lower-case parts of a query; stop-words and short ones go only where others are left."""
    apart = F.regexp_replace(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda t: t != "")
    plain = F.filter(words, lambda t: ~t.isin(*ENTITY_STOPWORDS))
    some = F.when(F.size(plain) > 0, plain).otherwise(words)
    longer = F.filter(some, lambda t: F.length(t) >= 3)
    return F.array_distinct(F.when(F.size(longer) > 0, longer).otherwise(some))
