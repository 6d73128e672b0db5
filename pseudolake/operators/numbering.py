"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with `name`, 1 and on by `order`: a range-partitioned sort, and the sizes of the partitions before.

    The sorted table is written once, so that a lost executor can't move the bounds between its two readings.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = kept(placed.withColumn("part_", F.spark_partition_id()).withColumn("id_", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("part_").agg(F.count("*").alias("size_"), F.min("id_").alias("low_"))
    before = F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("part_", "low_", before.alias("before_"))  # one row a partition
    return placed.join(F.broadcast(offset), "part_").withColumn(name, F.col("id_") - F.col("low_") + 1 + F.col("before_")).drop("part_", "id_", "low_", "before_")
