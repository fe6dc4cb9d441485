"""Numbers for the rows of a table in a total order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import written

_LOCAL_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with the column `name`: 1, 2, 3... in `order`.

    Rows are dealt by ranges of the order, sorted there and written with their place; how many rows the ranges before
    hold, one number for each, is broadcast. `df` is read twice (ranges are sampled), so it should be a written table.
    Rows equal in `order` are numbered in any order and share a task, so `order` should end with a key.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    table = written(ranged, "ranked").withColumn("_range", F.shiftright("_place", _LOCAL_BITS))
    counts = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1
    return table.join(F.broadcast(offsets), "_range").withColumn(name, number).drop("_range", "_place", "_before")
