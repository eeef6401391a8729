"""What a reader sees: the live view, a draft laid over it, and dataset restrictions.

Views are built in published names, so constants and parameters of queries need no rewriting.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.scalars import is_user_graph
from quadweave.operators import lookup, rewrite, state
from quadweave.schema import IRI, QUAD_COLS, TRIPLE_COLS, Snapshot, Vocabulary


def live_view(live: DataFrame, managed_graphs: DataFrame) -> DataFrame:
    """Quads of the managed graphs that are public."""
    return lookup.keep(live, state.live_graphs(managed_graphs), key="lg").select(*QUAD_COLS)


def draft_view(snap: Snapshot, draftset: str, union_with_live: bool = False) -> DataFrame:
    """The draft under published names; with ``union_with_live``, over the unchanged live graphs.

    One pass over the draft and one over live: graph lists are broadcast, no quad is shuffled. The
    stored names map one to one, so no duplicates can arise. A pattern over the view hands its
    constants to the stored quads first (:func:`quadweave.operators.patterns.pattern`).
    """
    pairs = lookup.local(state.mapping(snap.draft_graphs, snap.managed_graphs, draftset).select("lg", "dg"))
    mine = lookup.keep(snap.draft, pairs, key="dg")
    unchanged = state.live_graphs(snap.managed_graphs).join(pairs.select("lg"), "lg", "left_anti")
    live = lookup.keep(snap.live, unchanged, key="lg").select(*QUAD_COLS) if union_with_live else None

    def laid(stored: DataFrame) -> DataFrame:
        shown = rewrite.show_published(stored, pairs).select(*QUAD_COLS)
        return shown if live is None else shown.unionByName(live)

    def within(constants: dict[str, tuple[str, str]]) -> DataFrame:
        """The view of stored quads that may show these (value, kind) constants, by column."""
        names = rewrite.names_of(pairs, [value for value, kind in constants.values() if kind == IRI])
        stored = mine
        for column, (value, kind) in constants.items():
            # A published name is stored as itself or under its draft's name; literals as themselves.
            both = [value, names[value]] if kind == IRI and value in names else [value]
            stored = stored.filter(F.col(column).isin(both))
        return laid(stored)

    view = laid(mine)
    view._within = within
    return view


def sizes(snap: Snapshot, draftset: str, union_with_live: bool = False) -> DataFrame:
    """``(g, n)``: statements of each graph that a draft view shows, from the kept counts where there are any."""
    pairs = lookup.local(state.mapping(snap.draft_graphs, snap.managed_graphs, draftset).select("lg", "dg"))
    mine = lookup.keep(snap.sizes("draft"), pairs, key="dg")
    shown = lookup.translate(mine, pairs, "dg", "lg", rewrite.GRAPH_POSITION).select("g", "n")
    if not union_with_live:
        return shown
    unchanged = state.live_graphs(snap.managed_graphs).join(pairs.select("lg"), "lg", "left_anti")
    return shown.unionByName(lookup.keep(snap.sizes("live"), unchanged, key="lg").select("g", "n"))


def visible_graphs(pairs: DataFrame, managed_graphs: DataFrame, union_with_live: bool) -> DataFrame:
    """Published names of the graphs a draft shows."""
    mine = pairs.select("lg")
    return mine.union(state.live_graphs(managed_graphs)).distinct() if union_with_live else mine.distinct()


def raw_graphs(pairs: DataFrame, managed_graphs: DataFrame, union_with_live: bool) -> DataFrame:
    """Stored names of the graphs behind a draft view."""
    drafts = pairs.select(F.col("dg").alias("graph"))
    if not union_with_live:
        return drafts.distinct()
    live = state.live_graphs(managed_graphs).join(pairs.select("lg"), "lg", "left_anti")
    return live.select(F.col("lg").alias("graph")).union(drafts).distinct()


@dataclass(frozen=True)
class Dataset:
    """Graphs a query may look at; None means not stated."""

    default: Collection[str] | None = None
    named: Collection[str] | None = None

    def __bool__(self) -> bool:
        return bool(self.default) or bool(self.named)


def effective_dataset(query: Dataset, user: Dataset) -> Dataset:
    """A non-empty dataset given by the user replaces the one in the query."""
    return user if user else query


def restrict(dataset: Dataset, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible (default, named) graphs of a dataset. An empty dataset shows everything visible;
    a stated dataset of which nothing is visible shows nothing."""
    name = visible.columns[0]
    visible = visible.select(F.col(name).alias("g"))
    if not dataset:
        return visible, visible
    picked = [
        visible.filter(F.col("g").isin(list(graphs or []))) if graphs else visible.limit(0)
        for graphs in (dataset.default, dataset.named)
    ]
    return picked[0], picked[1]


def default_graph(view: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """RDF merge of graphs: triples without duplicates."""
    inside = view if graphs is None else lookup.keep(view, graphs)
    return lookup.as_set(inside.select(*TRIPLE_COLS))


def named_graphs(view: DataFrame, graphs: DataFrame) -> DataFrame:
    return lookup.keep(view, graphs)


def user_graphs(changes: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Changes shown to users: without the bookkeeping graphs."""
    return changes.filter(is_user_graph(F.col("lg"), vocab))


def changed_graphs_report(snap: Snapshot, draftset: str, vocab: Vocabulary) -> DataFrame:
    """Visible graphs of the draft over live, with statement and subject counts and what changed."""
    view = draft_view(snap, draftset, union_with_live=True)
    pairs = snap.draft_graphs.filter(F.col("draftset") == draftset)
    changes = state.change_rows(pairs, snap.managed_graphs, lookup.keep(snap.names("draft"), pairs, key="dg")).select(F.col("lg").alias("g"), "status")
    # Distinct subjects first, partially aggregated: one huge graph never meets in one task.
    subjects = view.groupBy("g", "s", "s_kind").agg(F.count("*").alias("n"))
    counts = subjects.groupBy("g").agg(F.sum("n").alias("statements"), F.count("*").alias("subjects"))
    zero = F.lit(0).cast("bigint")
    return (
        counts.join(changes, "g", "full_outer")
        .filter(is_user_graph(F.col("g"), vocab))
        .select(
            "g",
            F.coalesce("statements", zero).alias("statements"),
            F.coalesce("subjects", zero).alias("subjects"),
            F.coalesce("status", F.lit("unchanged")).alias("status"),
        )
    )
