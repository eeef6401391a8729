"""Mapping graph references between published and draft names.

Stored draft rows name graphs of their own draftset by draft IRI, in subject, predicate and object
position, unless that draft is empty (a pending deletion). Views show the published names again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.terms import TERM_DDL
from quadweave.operators import lookup
from quadweave.schema import GRAPH_REF_POSITIONS, IRI, QUAD_COLS

GRAPH_POSITION = [("g", None)]
ALL_POSITIONS = [*GRAPH_POSITION, *GRAPH_REF_POSITIONS]


def non_empty(pairs: DataFrame, draft: DataFrame) -> DataFrame:
    """Pairs whose draft graph holds at least one quad. Only the distinct graph names are shuffled.

    ``draft`` may also be the names alone, as :meth:`Snapshot.names` gives them without reading quads.
    """
    pairs = lookup.local(pairs)
    return pairs if lookup.is_empty(pairs) else lookup.local(lookup.join(pairs, _names(pairs, draft), "dg", "left_semi"))


def _names(pairs: DataFrame, draft: DataFrame) -> DataFrame:
    return lookup.local(lookup.keep(draft.select(F.col("g").alias("dg")), pairs, "dg", "dg").distinct())


def emptied(pairs: DataFrame, draft: DataFrame) -> DataFrame:
    return lookup.local(lookup.join(lookup.local(pairs), _names(pairs, draft), "dg", "left_anti"))


def _select_pairs(
    draft_graphs: DataFrame,
    draftset: str | None,
    live_graphs: Iterable[str] | None,
    drafts: Iterable[str] | None,
) -> DataFrame:
    pairs = draft_graphs
    if draftset is not None:
        pairs = pairs.filter(F.col("draftset") == draftset)
    if live_graphs is not None:
        pairs = pairs.filter(F.col("lg").isin(list(live_graphs)))
    if drafts is not None:
        pairs = pairs.filter(F.col("dg").isin(list(drafts)))
    return pairs.select("lg", "dg")


def _apply(draft: DataFrame, scope: DataFrame, pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Translate the rows of the graphs in ``scope``; two quads that become equal are one quad.

    Only rows that mention a mapped graph under either name can collide, so only those are
    deduplicated; the bulk of the data passes through without a shuffle. Few names are literals: then
    one pass filters the rows that mention them, another lets all others through, and nothing is joined.
    """
    scope, pairs = lookup.local(scope), lookup.local(pairs)
    mentioned = lookup.mentions(pairs, [source, target], GRAPH_REF_POSITIONS)
    inside_scope = lookup.among(scope, "dg", "g")
    if mentioned is not None and inside_scope is not None:
        hit = F.coalesce(inside_scope & mentioned, F.lit(False))
        moved = lookup.translate(draft.filter(hit), pairs, source, target)
        return draft.filter(~hit).select(*QUAD_COLS).unionByName(moved.select(*QUAD_COLS).dropDuplicates())
    inside = lookup.keep(draft, scope, key="dg")
    outside = lookup.drop(draft, scope, key="dg")
    names = pairs.select(F.col(source).alias("from"), F.col(target).alias("to"))
    names = names.unionByName(names.select(F.col("to").alias("from"), "to"))
    marked = lookup.translate(inside, names, "from", "to", mark="_hit")
    plain = marked.filter(~F.col("_hit")).select(*QUAD_COLS)
    merged = marked.filter("_hit").select(*QUAD_COLS).dropDuplicates()
    return outside.select(*QUAD_COLS).unionByName(plain).unionByName(merged)


def rewrite_draftset(draft: DataFrame, draft_graphs: DataFrame, draftset: str, names: DataFrame | None = None) -> DataFrame:
    """Published names to draft names inside a draftset, skipping references to emptied drafts.

    ``names(g)`` are the graphs that hold quads, if they are known.
    """
    scope = lookup.local(_select_pairs(draft_graphs, draftset, None, None))
    return _apply(draft, scope, non_empty(scope, draft if names is None else names), "lg", "dg")


def unrewrite_draftset(
    draft: DataFrame,
    draft_graphs: DataFrame,
    draftset: str,
    only_emptied: bool = False,
    live_graphs: Iterable[str] | None = None,
    drafts: Iterable[str] | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Draft names back to published names; ``only_emptied`` limits it to references to empty drafts.

    ``names(g)`` are the graphs that hold quads, if they are known.
    """
    scope = lookup.local(_select_pairs(draft_graphs, draftset, None, None))
    pairs = _select_pairs(scope, None, live_graphs, drafts)
    if only_emptied:
        pairs = emptied(pairs, draft if names is None else names)
    return _apply(draft, scope, pairs, "dg", "lg")


def show_published(quads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Draft quads under published names in every position, for reading."""
    return lookup.translate(quads, pairs, "dg", "lg", ALL_POSITIONS)


def rewrite_bindings(rows: DataFrame, pairs: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Show draft IRIs as published IRIs in every bound variable of a result, whatever it stands for."""
    terms = [f.name for f in rows.schema.fields if f.dataType.simpleString() == TERM_DDL]
    columns = list(columns) if columns is not None else terms
    order = rows.columns
    flat = rows
    for c in columns:
        flat = flat.withColumn(f"{c}__value", F.col(f"`{c}`.value")).withColumn(f"{c}__kind", F.col(f"`{c}`.kind"))
    flat = lookup.translate(flat, pairs, "dg", "lg", [(f"{c}__value", f"{c}__kind") for c in columns])
    shown = {c: _with_value(F.col(f"`{c}`"), F.col(f"`{c}__value`")).alias(c) for c in columns}
    return flat.select(*[shown.get(c, F.col(f"`{c}`")) for c in order])


def _with_value(t: Column, value: Column) -> Column:
    return F.when(t.isNotNull(), t.withField("value", value))


def names_of(pairs: DataFrame, published: Iterable[str]) -> dict[str, str]:
    """Draft names of a query's few constants: what is read of the mapping is one row per constant at most."""
    wanted = list(dict.fromkeys(published))
    if not wanted:
        return {}
    found = pairs.filter(F.col("lg").isin(wanted)).select("lg", "dg")
    return {r.lg: r.dg for r in found.collect()}


def rewrite_constant(mapping: Mapping[str, str], value: str, kind: str = IRI) -> str:
    """Name of a constant of a pattern: IRIs map, literals (also ones that look like IRIs) do not."""
    return mapping.get(value, value) if kind == IRI else value


def rewrite_parameters(mapping: Mapping[str, str], parameters: Mapping[str, tuple[str, str]]):
    """Pre-bound variables ``{name: (value, kind)}`` under the other names."""
    return {k: (rewrite_constant(mapping, v, kind), kind) for k, (v, kind) in parameters.items()}
