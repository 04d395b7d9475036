"""The fold of a version's commits into one table.

A later commit's value wins unless it is null; rows are matched by key. Merging is associative, so the fold is one aggregation over the union
of all commits instead of a chain of outer joins: for each key and column, the last value that is not null. Filters on keys and the
choice of columns reach every scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ, DELETED = "_seq", "_deleted"
#: Bytes of files whose keys one task aggregates; in memory they take some thirty times as much.
FOLD_BYTES = 16 << 20


def together(rows: DataFrame, ids: list[str], size: int) -> DataFrame:
    """rows, read from files of `size` bytes, with equal ids in one of as many parts as those bytes need, so that aggregating by ids takes a bounded
    part of the table in every task, none of them in the scan. Rows of few bytes stay as they are, as do those of unknown size (0)."""
    parts = -(-size // FOLD_BYTES)
    return rows.repartition(parts, *ids) if parts > 1 else rows


def last_value(column: str) -> Column:
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(SEQ)))


def step(how: str, kind: str) -> str:
    """SQL of a value after a commit, over `old`, the value before (not null), and x.v, the commit's."""
    plain = {"set": "x.v", "sum": "old + x.v", "max": "greatest(old, x.v)", "min": "least(old, x.v)", "append": "concat(old, x.v)"}
    if how in plain:
        return f"cast({plain[how]} as {kind})"
    if how.startswith("expr:"):
        return f"cast({re.sub(r'\bnew\b', 'x.v', how[len('expr:') :])} as {kind})"
    raise ValueError(f"no such merge: {how}")


def merged_value(column: str, how: list[str | None], kind: str) -> Column:
    """The column folded over commits, oldest first: set (the value), sum, max, min, append (arrays joined), or expr:<SQL over old and new>.

    how[k] is the k-th commit's way, None if it lacks the column. A null value changes nothing, and a value that meets none is taken as it is. One way for all commits
    after the first is an aggregate without state; ways that differ are folded in order."""
    later = set([h for h in how if h][1:]) or {"set"}
    if later == {"set"}:
        return last_value(column)
    if len(later) == 1 and (way := next(iter(later))) in ("sum", "max", "min"):
        return getattr(F, way)(column).cast(kind)
    values = f"array_sort(collect_list(if(`{column}` is not null, struct({SEQ} as s, `{column}` as v), null)))"
    cases = " ".join(f"when x.s in ({', '.join(str(k) for k, h in enumerate(how) if h == way)}) then {step(way, kind)}" for way in sorted({h for h in how if h}))
    return F.expr(f"aggregate({values}, cast(null as {kind}), (old, x) -> case when old is null then x.v {cases} end)")


def fold(actions: list[DataFrame], ids: list[str], how: list[dict[str, str]] | None = None, deletes: bool = False, size: int = 0) -> DataFrame:
    """One row for each key. actions: oldest first; a column that an action lacks is null there. how: for each action, columns to their way of
    merging. deletes: actions may mark rows by `_deleted`. size: bytes of the actions' files, if known; see together()."""
    how = how or [{} for _ in actions]
    if len(actions) == 1 and not deletes:
        return actions[0]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (a.withColumn(SEQ, F.lit(k)) for k, a in enumerate(actions)))
    rows = together(rows, ids, size)
    if deletes and DELETED in rows.columns:
        gone = rows.filter(DELETED).groupBy(*ids).agg(F.max(SEQ).alias("_gone"))
        rows = rows.join(gone, ids, "left").filter(F.col("_gone").isNull() | (F.col(SEQ) > F.col("_gone"))).drop("_gone")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    values = [c for c in rows.columns if c not in (*ids, SEQ, DELETED)]
    if not values:
        return rows.select(*ids).distinct()
    ways = lambda c: [h.get(c, "set") if c in a.columns else None for h, a in zip(how, actions)]
    return rows.groupBy(*ids).agg(*(merged_value(c, ways(c), kinds[c]).alias(c) for c in values))


def fold_small(base: DataFrame, later: list[DataFrame], ids: list[str], how: list[dict[str, str]], deletes: bool = False) -> DataFrame:
    """The same fold where all of `later` is small enough to be broadcast: rows of the base whose key no later action has pass without a shuffle."""
    keys = reduce(DataFrame.unionByName, (a.select(*ids) for a in later)).distinct()
    touched = fold([base.join(F.broadcast(keys), ids, "left_semi"), *later], ids, how, deletes)
    return base.join(F.broadcast(keys), ids, "left_anti").unionByName(touched, allowMissingColumns=True)


def fold_by_joins(actions: list[DataFrame], ids: list[str]) -> DataFrame:
    """The same by a chain of full outer joins; for tests and for comparison only."""

    def join(old: DataFrame, new: DataFrame) -> DataFrame:
        values = [c for c in old.columns if c not in ids]
        renamed = new.select(*ids, *(F.col(c).alias(f"new_{c}") for c in values))
        return old.join(renamed, ids, "full").select(*ids, *(F.coalesce(f"new_{c}", c).alias(c) for c in values))

    return reduce(join, actions)


def join_groups(groups: list[DataFrame], ids: list[str]) -> DataFrame:
    """Column groups put side by side on their keys."""
    return reduce(lambda a, b: a.join(b, ids, "full"), groups)
