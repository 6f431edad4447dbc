"""Keyed upserts as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(target: DataFrame, source: DataFrame, key: tuple[str, ...], updates: tuple[str, ...], seq: str | None, dealt: Iterable[str], sorts: Iterable[str]) -> DataFrame:
    """target's rows and source's (__new), numbered within their key (__n): old ones first, then by
    `seq`, then by their columns. __last: the updates of the last one. Rows move once, on the key, or
    not at all where both sides hold `dealt`, columns that follow from the key and by which they lie together. sorts: more such columns,
    by which rows are sorted before the key."""
    dealt, sorts = list(dealt), list(sorts)
    rest = [c for c in source.columns if c not in (*key, *dealt, *sorts, seq)]
    rest += [seq] if seq in target.columns and seq not in key else []
    after = source.select(*dealt, *sorts, *key, *rest, F.lit(True).alias("__new"), (F.col(seq) if seq else F.lit(None).cast("int")).alias("__seq"))
    both = target.withColumn("__new", F.lit(False)).unionByName(after, allowMissingColumns=True)
    both = both.repartition(*dealt) if dealt else both
    order = Window.partitionBy(*dealt, *sorts, *key).orderBy("__new", "__seq", *rest)
    out = both.withColumn("__n", F.row_number().over(order))
    if updates:
        out = out.withColumn("__last", F.last(F.struct("__new", *updates)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out


def new_rows(known: DataFrame, source: DataFrame, key: tuple[str, ...], seq: str | None = None, dealt: Iterable[str] = (), sorts: Iterable[str] = (), ids: Mapping[str, Column] = {}) -> DataFrame:
    """The first row of each key that `known`, a table of keys, doesn't hold, in the order of merge_upsert."""
    columns = [ids[c].alias(c) if c in ids else c for c in source.columns if c != seq]
    return _in_order(known, source, key, (), seq, dealt, sorts).where("__new and __n = 1").select(*columns)


def merge_upsert(target: DataFrame, source: DataFrame, key: tuple[str, ...], updates: tuple[str, ...], seq: str | None = None, dealt: Iterable[str] = (), sorts: Iterable[str] = (), ids: Mapping[str, Column] = {}, changed: str | None = None) -> DataFrame:
    """target after source's rows were upserted one by one, in the order of `seq`; rows
    of one key that it doesn't tell apart (all, without it) in the order of their columns.

    A conflict on the key overwrites `updates`; without any, the old row stays. A
    new key takes its first row, and then the updates of its last. Rows with a null
    in the key conflict with nothing in SQL; here null equals null, so that a
    second run changes nothing. One shuffle of both sides together, on the key or on `dealt`.
    ids: columns that follow from the key, which new rows take at the end and don't move.
    changed: a column more, true for rows that target doesn't hold as they are.
    """
    columns = target.columns
    source = source.select(*columns, *([seq] if seq and seq not in columns else []))
    out = _in_order(target, source, key, updates, seq, dealt, sorts).where("not __new or __n = 1")
    last = lambda c: F.when(F.col("__last.__new"), F.col(f"__last.{c}")).otherwise(F.col(c)).alias(c)
    made = {c: F.when(F.col("__new"), ids[c]).otherwise(F.col(c)).alias(c) for c in ids}
    same = lambda c: F.col(f"__last.{c}").eqNullSafe(F.col(c))
    other = F.col("__new") | (F.col("__last.__new") & ~reduce(and_, map(same, updates))) if updates else F.col("__new")
    return out.select(*[last(c) if c in updates else made.get(c, F.col(c)) for c in columns], *([other.alias(changed)] if changed else []))
