"""Numbering rows in an order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skribo.sources.files import checkpointed


def numbered(rows: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number, from 1, in the order; within each value of by, if it is given.

    Rows are sorted in ranges, however few values by has, and written; a range's numbers are its places shifted by the rows of
    the ranges before. What is summed over ranges is a row for each range and value of by. Rows that tie in the order come in any.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    order = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = checkpointed(placed.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = placed.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_range", *[F.col(c).alias(f"_by_{c}") for c in by], (F.col("_shift") - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(ranges.withColumnRenamed("_range", "_r"), same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
