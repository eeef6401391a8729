"""Whole-graph moves on a quads DataFrame. Each is one projection or one semi/anti join on ``g``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.operators import lookup
from quadweave.operators.rewrite import GRAPH_POSITION
from quadweave.operators.state import GraphNotFound
from quadweave.schema import QUAD_COLS


def _require(quads: DataFrame, graph: str, silent: bool) -> bool:
    present = not quads.filter(F.col("g") == graph).limit(1).isEmpty()
    if not present and not silent:
        raise GraphNotFound(graph)
    return present


def copy_graph(quads: DataFrame, source: str, target: str, silent: bool = False) -> DataFrame:
    """The target graph is replaced by the source content."""
    _require(quads, source, silent)
    if source == target:
        return quads
    copied = quads.filter(F.col("g") == source).withColumn("g", F.lit(target))
    return quads.filter(F.col("g") != target).unionByName(copied)


def move_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    """The target graph is replaced by the source content and the source is emptied."""
    if source == target:
        return quads
    return quads.filter(F.col("g") != target).withColumn(
        "g", F.when(F.col("g") == source, F.lit(target)).otherwise(F.col("g"))
    )


def drop_graph(quads: DataFrame, graph: str) -> DataFrame:
    return quads.filter(F.col("g") != graph)


def append_triples(quads: DataFrame, graph: str, triples: DataFrame) -> DataFrame:
    """Raw append to one graph; nothing is looked up or rewritten."""
    return lookup.add_new(quads, triples.withColumn("g", F.lit(graph)).select(*QUAD_COLS))


def clone(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Content of all live graphs in ``pairs(lg, dg)`` under the draft names, in one pass."""
    pairs = lookup.local(pairs.select("lg", "dg"))
    return lookup.translate(lookup.keep(live, pairs, key="lg"), pairs, "lg", "dg", GRAPH_POSITION)


def upsert_single_value(quads: DataFrame, values: DataFrame) -> DataFrame:
    """Replace all objects of each (g, s, p) in ``values`` by the given one.

    Only quads of a predicate that ``values`` names meet them, if these are few; the others pass by.
    """
    keys = ["g", "s", "s_kind", "p"]
    named = values.select("p").filter(F.col("p").isNotNull()).distinct()
    met = lookup.among(lookup.local(named), "p", "p")
    met = F.lit(True) if met is None else met
    rest = quads.filter(met).join(values.select(*keys).distinct(), keys, "left_anti")
    kept = quads.filter(~F.coalesce(met, F.lit(False))).select(*QUAD_COLS).unionByName(rest.select(*QUAD_COLS))
    return kept.unionByName(values.select(*QUAD_COLS))
