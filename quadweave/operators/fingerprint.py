"""Names for materialised results: the same query over the same graphs at the same times has one name."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.scalars import epoch_millis, version_id
from quadweave.schema import Vocabulary


def static_part(
    query: str | Column, kind: str, default_graphs: Column, named_graphs: Column
) -> Column:
    """MD5 of query, kind of query and graph sets; the order of graphs does not matter."""
    parts = F.struct(
        F.array_sort(F.array_distinct(default_graphs)).alias("default_graphs"),
        F.array_sort(F.array_distinct(named_graphs)).alias("named_graphs"),
        (F.lit(query) if isinstance(query, str) else query).alias("query"),
        F.lit(kind).alias("query_type"),
    )
    return F.md5(F.to_json(parts))


def time_part(livemod: Column, draftmod: Column, version: Column, vocab: Vocabulary) -> Column:
    """``livemod[-draftmod][_version]`` in milliseconds; ``empty`` for no published time."""
    return F.concat(
        F.coalesce(epoch_millis(livemod).cast("string"), F.lit("empty")),
        F.coalesce(F.concat(F.lit("-"), epoch_millis(draftmod).cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit("_"), version_id(version, vocab)), F.lit("")),
    )


def graph_array(graphs: Collection[str]) -> Column:
    return F.array(*map(F.lit, graphs)).cast("array<string>")


def view_fingerprint(
    latest: DataFrame,
    query: str,
    kind: str,
    default_graphs: Collection[str],
    named_graphs: Collection[str],
    vocab: Vocabulary,
) -> DataFrame:
    """``(hash, times)`` from the one-row result of ``times.latest_modified``."""
    return latest.select(
        static_part(query, kind, graph_array(default_graphs), graph_array(named_graphs)).alias("hash"),
        time_part(F.col("livemod"), F.col("draftmod"), F.col("version"), vocab).alias("times"),
    )
