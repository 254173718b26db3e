"""Canonical JSON and checks against a small part of JSON Schema, behind Arrow."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bounds of a value.
MOST_DEPTH, MOST_NODES, MOST_BYTES = 12, 1024, 8192

_TYPES: dict[str, Callable[[object], bool]] = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def _plain(v, depth: int = 0):
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("not finite")
        return int(v) if v.is_integer() else v
    if isinstance(v, list):
        return [_plain(x, depth + 1) for x in v]
    return {k: _plain(x, depth + 1) for k, x in v.items()} if isinstance(v, dict) else v


def canonical(text: str | None) -> str | None:
    """Keys sorted, no spaces, whole numbers without a point; null for null and for what isn't JSON."""
    try:
        return json.dumps(_plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None


def _size(v) -> tuple[int, int]:
    """(depth, nodes)."""
    inner = v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
    sizes = [_size(x) for x in inner]
    return 1 + max((d for d, _ in sizes), default=0), 1 + sum(n for _, n in sizes)


def fault(v, schema: dict, at: str = "$") -> str | None:
    """The first thing in which a value differs from a schema, or None."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](v) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and json.dumps(_plain(v), sort_keys=True) not in [json.dumps(_plain(e), sort_keys=True) for e in schema["enum"]]:
        return f"{at}: not in enum"
    if isinstance(v, dict):
        for k in schema.get("required", []):
            if k not in v:
                return f"{at}.{k}: missing"
        known = schema.get("properties", {})
        for k, x in v.items():
            if k in known:
                if bad := fault(x, known[k], f"{at}.{k}"):
                    return bad
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    if isinstance(v, list) and "items" in schema:
        for i, x in enumerate(v):
            if bad := fault(x, schema["items"], f"{at}[{i}]"):
                return bad
    return None


def value_fault(text: str | None, schema: dict) -> str | None:
    plain = canonical(text)
    if plain is None:
        return "$: not JSON"
    if len(plain.encode()) > MOST_BYTES:
        return "$: too long"
    v = json.loads(plain)
    depth, nodes = _size(v)
    if depth > MOST_DEPTH or nodes > MOST_NODES:
        return "$: too deep" if depth > MOST_DEPTH else "$: too many nodes"
    return fault(v, schema)


def _written(v: Column, depth: int) -> Column:
    """A VARIANT in one spelling: keys sorted, numbers as doubles, strings quoted; null below the last level."""
    kind = F.schema_of_variant(v)
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    number = F.try_variant_get(v, "$", "double")
    scalar = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).when(kind == "STRING", F.to_json(v)).otherwise(F.when(~F.isnan(number) & (F.abs(number) < float("inf")), (number + 0.0).cast("string")))
    if depth == 0:
        return F.when(~is_object & ~is_array, scalar)
    members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    quoted = lambda k: F.concat(F.to_json(F.call_function("to_variant_object", F.array(k))), F.lit(":"))
    # one list of parts for objects and arrays alike, so that a level names the next one only once
    parts = F.when(is_object, F.transform(F.array_sort(F.map_keys(members)), lambda k: F.struct(quoted(k).alias("k"), F.element_at(members, k).alias("v")))).when(is_array, F.transform(items, lambda x: F.struct(F.lit("").alias("k"), x.alias("v"))))
    inner = F.aggregate(parts, F.lit(""), lambda acc, c: F.concat(acc, F.lit(","), c["k"], _written(c["v"], depth - 1)))  # null as soon as a part is
    return F.when(is_object | is_array, F.concat(F.when(is_object, "{").otherwise("["), inner, F.when(is_object, "}").otherwise("]"))).otherwise(scalar)


def canonical_key(text: Column, depth: int = MOST_DEPTH) -> Column:
    """A digest that two JSON texts share where their values are equal: whatever the order of keys, spaces
    and spelling of numbers, but 1, "1" and true apart. Built-ins only, so it can be joined on.

    Null for null, for what isn't JSON, repeats a key or is nested deeper than ``depth``, and for texts over the bound.
    """
    written = _written(F.try_parse_json(text), depth)
    return F.when(F.octet_length(written) <= MOST_BYTES, F.sha2(written.cast("binary"), 256))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical)


def schema_fault(text: Column, schema: dict) -> Column:
    """What a JSON text has wrong, or null."""

    @F.pandas_udf(StringType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda t: value_fault(t, schema))

    return check(text)
