"""Ranks over a whole table without one window over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.session import stage


def dense_rank_by_parts(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds the 0-based rank in the order of columns that are unique together, of any values.

    Rows are dealt by range, counted per part, and ranked inside their part; only the counts, one row per
    part, are put in order.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    bases = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = ranged.withColumn("_inside", inside).join(F.broadcast(bases), "_part")
    return ranked.withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")
