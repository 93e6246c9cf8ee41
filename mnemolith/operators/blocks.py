"""Places in a long order, without putting it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their place, from 1, in a total order: a range sort, numbered by partition and offset."""
    placed = cut(rows.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    # One row per partition of the sort.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(starts, "_p").withColumn(name, (F.col("offset") + F.col("_i") - F.col("first") + 1).cast("int")).drop("_p", "_i", "first", "offset")
