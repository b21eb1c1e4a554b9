"""Numbers in order, made by ranges, so that no task orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.operators.storage import written

#: ``monotonically_increasing_id`` has the partition above so many bits and the place in it below.
BITS = 33


def accumulated(rows: DataFrame, column: str, out: str, *order: str | Column) -> DataFrame:
    """Adds ``out``: the sum of ``column`` over the rows that come before in the given order, by ranges; ``numbered`` for rows that count more than once."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", BITS)
    sums = placed.groupBy(part.alias("_of")).agg(F.sum(column).alias("_sum"))
    # one row a partition
    before = sums.select("_of", F.coalesce(F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(column).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_part", part).withColumn("_inside", inside)
    return rows.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(out, F.col("_before") + F.col("_inside")).drop("_place", "_part", "_of", "_before", "_inside")


def numbered(rows: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """Adds ``out``: the number of a row from 0 in the given order. Rows that are equal in it have numbers next to each other."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "ordered")  # a place is only fixed once it is written
    part = F.shiftright("_place", BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << BITS) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + inside).drop("_part", "_place", "_before")
