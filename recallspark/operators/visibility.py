"""Scope, visibility, validity and supersession of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the confidence from which a superseding link hides its target.
SUPERSEDES_AT = 0.8


def in_scope(namespace: Column, scope: str, subtree: bool = True, fold: bool = False) -> Column:
    """Exactly the scope, or it and all below it; a sibling that shares a prefix is outside.

    With ``fold``, as for the local owner, scopes below may differ in ASCII case.
    """
    if fold and subtree:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return (namespace == scope) | F.translate(namespace, upper, lower).startswith(F.translate(F.lit(scope + "/"), upper, lower))
    same = namespace == scope
    return same | namespace.startswith(scope + "/") if subtree else same


def visible_to(caller: str | None, visibility: Column, owner: Column) -> Column:
    return visibility.isNull() | (visibility != "personal") | owner.eqNullSafe(F.lit(caller))


def granted(namespace: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (F.lit(True) if p == "/" else in_scope(namespace, p))
    return out


def covered(paths: Column, prefixes: list[str]) -> Column:
    """Those of an array of scopes that a grant reaches: a funnel doesn't climb above it."""
    return F.filter(paths, lambda p: granted(p, prefixes))


def valid_at(when: int, valid_from: Column, valid_until: Column) -> Column:
    return (valid_from <= when) & (valid_until.isNull() | (valid_until >= when))


def superseded_ids(links: DataFrame, at: int | None = None, successors: DataFrame | None = None) -> DataFrame:
    """Ids hidden by a confident enough link, known by ``at``, from a successor that is itself in reach."""
    rows = links.where((F.col("link_type") == "supersedes") & (F.col("confidence") >= SUPERSEDES_AT))
    if at is not None:
        rows = rows.where(F.coalesce("judged_at", "created_at") <= at)
    if successors is not None:
        rows = rows.join(successors.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return rows.select(F.col("target_id").alias("id")).distinct()


def current(memories: DataFrame, links: DataFrame, as_of: int | None = None, before: int | None = None, include_superseded: bool = False, include_archived: bool = False, scoped: bool = False) -> DataFrame:
    """Memories as they stand, or stood: as_of goes before ``before``; archived rows stay hidden."""
    out = memories
    if as_of is not None:
        out = out.where(valid_at(as_of, F.col("valid_from"), F.col("valid_until")))
    elif before is not None:
        out = out.where(F.col("valid_from") <= before)
    if not include_archived:
        out = out.where(F.col("archived_at").isNull())
    if not include_superseded:
        out = out.join(superseded_ids(links, as_of, memories if scoped else None), "id", "left_anti")
    return out
