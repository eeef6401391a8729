"""Benchmark results as chart series: fix all dimensions but one and collect the points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: Name + "Test_" + thousands of statements, graphs and references.
_NAME = r"^(\w+)Test_(\d+)k_(\d+)g_(\d+)pc?$"
DIMENSIONS = ["statements", "graphs", "ref_statements"]


def parse_benchmarks(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``benchmark, score, unit, version`` with the dimensions parsed from the name; and rejects."""
    name = F.element_at(F.split("benchmark", r"\."), -1)
    good = name.rlike(_NAME)

    def part(i: int):
        return F.regexp_extract(name, _NAME, i)

    parsed = results.filter(good).select(
        "*",
        part(1).alias("short_name"),
        (part(2).cast("bigint") * 1000).alias("statements"),
        part(3).cast("bigint").alias("graphs"),
        part(4).cast("bigint").alias("ref_statements"),
    )
    return parsed, results.filter(~good)


def slices(parsed: DataFrame) -> DataFrame:
    """Per version and chart: x and y vectors, for charts with more than one point.

    A chart has as many points as the benchmark grid has steps, whatever the number of charts.
    """

    def one(x: str) -> DataFrame:
        others = [d for d in DIMENSIONS if d != x]
        grouped = parsed.groupBy("version", "short_name", *others).agg(
            F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col("score").alias("y")))).alias("points")
        )
        return grouped.filter(F.size("points") > 1).select(
            "version",
            F.lit(x).alias("x_axis"),
            "short_name",
            *[(F.lit(None).cast("bigint") if d == x else F.col(d)).alias(d) for d in DIMENSIONS],
            F.col("points.x").alias("x"),
            F.col("points.y").alias("y"),
        )

    return reduce(DataFrame.unionByName, [one(x) for x in DIMENSIONS])
