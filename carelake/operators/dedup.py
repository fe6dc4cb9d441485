"""One row per key.

``row_number() = 1`` plans as a partial and a final group limit: each map task first
reduces a key to one row, so a hot key costs the shuffle one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def newest(c: str = "updated_at") -> Column:
    """Newest first; a missing time counts as the epoch."""
    return F.coalesce(F.col(c), F.lit(_EPOCH).cast("timestamp_ntz")).desc()


def newest_touched(updated: str = "updated_at", created: str = "created_at") -> Column:
    """Newest first by update, else creation time; rows with neither come last."""
    return F.coalesce(F.col(updated), F.col(created)).desc_nulls_last()


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    tiebreak: Sequence[Column] | None = None,
) -> DataFrame:
    """First row per key in ``order``; ties are settled by all other columns, ascending."""
    if tiebreak is None:
        named = {k for k in keys if isinstance(k, str)}
        tiebreak = [F.col(c).asc_nulls_last() for c in df.columns if c not in named]
    window = Window.partitionBy(*keys).orderBy(*order, *tiebreak)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def any_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key when no order matters; the smallest row, so that reruns agree."""
    return latest_per_key(df, keys, [])


def latest_cancellation(cancellations: DataFrame) -> DataFrame:
    """Newest cancellation per appointment: (appointment_id, created_at to the second, reason)."""
    cleaned = cancellations.select(
        F.nullif(F.trim("appointment_id"), F.lit("")).alias("appointment_id"),
        "created_at",
        F.nullif(F.trim("reason"), F.lit("")).alias("reason"),
        "cancellation_id",
    ).filter(F.col("appointment_id").isNotNull())
    latest = latest_per_key(
        cleaned, ["appointment_id"], [newest("created_at")], [F.col("cancellation_id").asc()]
    )
    return latest.select(
        "appointment_id", F.date_trunc("second", "created_at").alias("created_at"), "reason"
    )
