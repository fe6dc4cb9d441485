"""Left join to a table with at most one row per key: broadcast when measured small, else shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.session import BROADCAST_BYTES, broadcast_measured

# NULL keys are spread over this many stand-in keys.
NULL_SPREAD = 1024
_PER_VALUE = 16
# Begins every key of a shuffled link, and no stand-in.
_MARK = "="


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``: text length plus a fixed cost per value.  Runs one aggregate."""

    def width(f: T.StructField) -> Column:
        text = F.octet_length(f.name) if isinstance(f.dataType, T.StringType) else F.lit(0)
        return F.coalesce(text, F.lit(0)) + _PER_VALUE

    total = sum((width(f) for f in df.schema.fields[1:]), width(df.schema.fields[0]))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def link(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread_by: str,
    measure: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``left`` plus the columns of ``right`` whose unique string ``right_key`` equals ``left_key``.

    With ``measure`` (for sides that are usually small; Spark's own estimate multiplies up
    through joins) the right side is measured and, within ``limit``, broadcast, so the left
    side stays where it is.

    Otherwise both sides are shuffled, unless AQE finds the right one small before the left one is on its way.  A plain left
    join hashes every NULL key to one task; here a NULL key becomes one of many stand-in keys, chosen by the row's own
    ``spread_by`` value so that a recomputed task places its rows as before.  Keys are marked, so that none equals a stand-in,
    and go through the shuffle once.  As a marked key is made for the join, the right side is shuffled for it even where it
    lies by its key already: that is how AQE learns its size (joins beneath count as the product of their sides) and may
    split hot keys that are not NULL.
    """
    taken = [c for c in right.columns if c != right_key]
    clash = set(taken) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keyed = right.filter(F.col(right_key).isNotNull())

    if measure and measured_bytes(keyed) <= limit:
        keyed = keyed.withColumnRenamed(right_key, "_link")
        joined = left.join(F.broadcast(keyed), left[left_key] == keyed["_link"], "left")
        return joined.select(*left.columns, *taken)

    def marked(c: str) -> Column:
        return F.concat(F.lit(_MARK), F.col(c))

    broadcast_measured(left.sparkSession)
    stand_in = F.pmod(F.xxhash64(spread_by), F.lit(NULL_SPREAD)).cast("string")
    rest = [F.col(c) for c in left.columns if c != left_key]
    spread = left.select(*rest, F.coalesce(marked(left_key), stand_in).alias("_link"))
    # The right side is named first, and so begun first: else its size would mostly be known too late.
    joined = keyed.select(marked(right_key).alias("_link"), *taken).join(spread, "_link", "right")
    key = F.when(F.startswith("_link", F.lit(_MARK)), F.substring("_link", 2, 1 << 30)).alias(left_key)
    return joined.select(*[key if c == left_key else F.col(c) for c in left.columns], *taken)
