"""Upsert by key as joins; the caller writes the result to a new place.

Both sides hold one row per key, so these joins cannot fan out or skew on a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    target: DataFrame, src: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None
) -> DataFrame:
    """Insert new keys and update existing ones.

    Without ``update_cols`` the source row replaces the target row.  With it, only those
    columns are taken from the source for keys that exist; new keys are inserted whole.
    """
    src = src.select(*target.columns)
    if update_cols is None:
        kept = target.join(src.select(*keys), list(keys), "left_anti")
        return kept.select(*target.columns).unionByName(src)

    s, t = src.withColumn("_src", F.lit(True)).alias("s"), target.withColumn("_tgt", F.lit(True)).alias("t")
    on = reduce(Column.__and__, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys])
    in_src, in_tgt = F.col("s._src").isNotNull(), F.col("t._tgt").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            value = F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))
        elif c in update_cols:
            value = F.when(in_src, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        else:
            value = F.when(in_tgt, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        return value.alias(c)

    return t.join(s, on, "full_outer").select(*[pick(c) for c in target.columns])


def merge(target: DataFrame, src: DataFrame, keys: Sequence[str], only_new: bool = False) -> DataFrame:
    """Target columns with ``_in_src`` and ``_in_target``: one join gives the result and all counts.

    Keys compare null-safe.  With ``only_new`` rows that exist stay as they are; otherwise the source row replaces them.
    """
    here, there = F.lit(True).alias("_in_src"), F.lit(True).alias("_in_target")
    s, t = src.select(*target.columns, here).alias("s"), target.select("*", there).alias("t")
    on = reduce(Column.__and__, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    in_src, in_target = F.coalesce("_in_src", F.lit(False)), F.coalesce("_in_target", F.lit(False))
    from_src = in_src & ~in_target if only_new else in_src
    picked = [F.when(from_src, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return t.join(s, on, "full_outer").select(*picked, in_src.alias("_in_src"), in_target.alias("_in_target"))


#: What became of a row: its key is new, its content differs, its key is gone from a source that holds all rows.
INSERTED, UPDATED, REMOVED = "insert", "update", "remove"


def changes(
    known: DataFrame, src: DataFrame, keys: Sequence[str], only_new: bool = False, removing: bool = False
) -> DataFrame:
    """The change feed of an upsert of ``src`` into a table of which ``known`` holds keys, row hash and part.

    One row per key of either side, with ``_op`` (NULL for rows that stay as they are), the part a row is in now
    (``_old_part``) and the one it belongs to (``_part``).  Rows are compared by ``_row``, a hash of their content.  With
    ``only_new`` existing rows stay.  With ``removing`` the source is complete, so keys it lacks are removed; without,
    they are not looked at.  Keys compare null-safe.
    """
    s = src.withColumn("_here", F.lit(True)).alias("s")
    k = known.select(*keys, F.col("_row").alias("_old_row"), F.col("_part").alias("_old_part"), F.lit(True).alias("_known")).alias("k")
    on = reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys])
    joined = s.join(k, on, "full_outer" if removing else "left")
    here, there = F.coalesce("_here", F.lit(False)), F.coalesce("_known", F.lit(False))
    op = F.when(here & ~there, INSERTED)
    if not only_new:
        op = op.when(here & there & (F.col("_row") != F.col("_old_row")), UPDATED)
    if removing:
        op = op.when(~here & there, REMOVED)
    picked = [(F.when(here, F.col(f"s.{c}")).otherwise(F.col(f"k.{c}")) if c in keys else F.col(f"s.{c}")).alias(c) for c in src.columns]
    return joined.select(*picked, op.alias("_op"), "_old_part", here.alias("_in_src"))


def apply_changes(old: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts ``old`` after the feed's inserts, updates and removals: one anti join on the feed's keys."""
    named = {k: f"_key_{n}" for n, k in enumerate(keys)}
    gone = feed.filter(F.col("_op") != INSERTED).select([F.col(k).alias(n) for k, n in named.items()])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    fresh = feed.filter(F.col("_op") != REMOVED).select(*old.columns)
    return old.join(gone, on, "left_anti").unionByName(fresh)


def insert_new(target: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert new keys only; existing rows stay as they are."""
    fresh = src.select(*target.columns).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh)


def upsert_metrics(target: DataFrame | None, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: eligible, inserted and updated counts of an upsert of ``src`` into ``target``."""
    if target is None:
        n = F.count(F.lit(1))
        return src.agg(
            n.alias("eligible"), n.alias("inserted"), F.lit(0).cast("bigint").alias("updated")
        )
    known = target.select(*keys, F.lit(True).alias("_known"))
    matched = src.select(*keys).join(known, list(keys), "left")
    return matched.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
    )
