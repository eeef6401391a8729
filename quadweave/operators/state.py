"""Which graphs are managed, public, drafted, changed: table work on the bookkeeping tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.scalars import draft_graph_iri, is_protected
from quadweave.schema import TABLES, Vocabulary


class GraphNotFound(ValueError):
    pass


class ProtectedGraph(PermissionError):
    pass


def instant(now: str | dt.datetime | Column) -> Column:
    if isinstance(now, Column):
        return now
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else now
    return F.lit(text).cast("timestamp")


def columns_of(table: str) -> list[str]:
    return TABLES[table].fieldNames()


def mapping(draft_graphs: DataFrame, managed_graphs: DataFrame, draftset: str) -> DataFrame:
    """``(lg, dg, is_public)`` of a draftset; the managed graph must say whether it is public."""
    mine = draft_graphs.filter(F.col("draftset") == draftset).select("lg", "dg")
    managed = managed_graphs.filter(F.col("is_public").isNotNull()).select("lg", "is_public")
    return mine.join(managed, "lg")


def live_graphs(managed_graphs: DataFrame, online: bool = True) -> DataFrame:
    return managed_graphs.filter(F.col("is_public") == online).select("lg")


def ensure_managed(managed_graphs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Add the unmanaged ones of ``graphs(lg)`` as private managed graphs, all in one job."""
    fresh = graphs.select("lg").distinct().join(managed_graphs, "lg", "left_anti")
    rows = fresh.select("lg", F.lit(False).alias("is_public"), F.lit(None).cast("timestamp").alias("issued"))
    return managed_graphs.unionByName(rows)


def new_drafts(graphs: DataFrame, draftset: str, now, vocab: Vocabulary) -> DataFrame:
    """Draft rows for ``graphs(lg)``."""
    return graphs.select(
        draft_graph_iri(F.lit(draftset), F.col("lg"), vocab).alias("dg"),
        "lg",
        F.lit(draftset).alias("draftset"),
        instant(now).alias("created"),
    )


def create_drafts(draft_graphs: DataFrame, graphs: DataFrame, draftset: str, now, vocab: Vocabulary) -> DataFrame:
    """Draft rows for the ones of ``graphs(lg)`` that have none yet in this draftset."""
    mine = draft_graphs.filter(F.col("draftset") == draftset)
    fresh = graphs.select("lg").distinct().join(mine, "lg", "left_anti")
    return draft_graphs.unionByName(new_drafts(fresh, draftset, now, vocab))


def ensure_protected_draft(
    managed_graphs: DataFrame, draft_graphs: DataFrame, graph: str, draftset: str, now, vocab: Vocabulary
) -> tuple[DataFrame, DataFrame]:
    """Managed row and draft row of one protected graph, made when absent."""
    if not re.match(vocab.protected_regex, graph):
        raise ProtectedGraph(f"not a protected graph: {graph}")
    one = draft_graphs.sparkSession.range(1).select(F.lit(graph).alias("lg"))
    return ensure_managed(managed_graphs, one), create_drafts(draft_graphs, one, draftset, now, vocab)


def protected_rows(graphs: DataFrame, vocab: Vocabulary, column: str = "lg") -> DataFrame:
    return graphs.filter(is_protected(F.col(column), vocab))


def check_unprotected(graphs: DataFrame, vocab: Vocabulary, column: str = "lg") -> None:
    refused = protected_rows(graphs, vocab, column).select(column).limit(5).collect()
    if refused:
        raise ProtectedGraph("protected graphs: " + ", ".join(r[0] for r in refused))


def is_graph_managed(managed_graphs: DataFrame, graph: str) -> bool:
    return not managed_graphs.filter(F.col("lg") == graph).limit(1).isEmpty()


def is_graph_live(managed_graphs: DataFrame, graph: str) -> bool:
    return not managed_graphs.filter((F.col("lg") == graph) & F.col("is_public")).limit(1).isEmpty()


def draftset_exists(draftsets: DataFrame, draftset: str) -> bool:
    return not draftsets.filter(F.col("draftset") == draftset).limit(1).isEmpty()


def is_graph_empty(quads: DataFrame, graph: str) -> bool:
    return quads.filter(F.col("g") == graph).limit(1).isEmpty()


def existence(graphs: DataFrame, managed_graphs: DataFrame, quads: DataFrame) -> DataFrame:
    """Set-wise existence checks of ``graphs(lg)``: managed, live, non-empty."""
    state = managed_graphs.select("lg", F.lit(True).alias("_m"), F.col("is_public").alias("_p"))
    filled = quads.select(F.col("g").alias("lg")).distinct().withColumn("_q", F.lit(True))
    return (
        graphs.select("lg")
        .join(state, "lg", "left")
        .join(filled, "lg", "left")
        .select(
            "lg",
            F.coalesce("_m", F.lit(False)).alias("managed"),
            F.coalesce("_p", F.lit(False)).alias("live"),
            F.coalesce("_q", F.lit(False)).alias("non_empty"),
        )
    )


def lookup_live(draft_graphs: DataFrame, dg: str) -> str | None:
    row = draft_graphs.filter(F.col("dg") == dg).select("lg").first()
    return row.lg if row else None


def find_draft(draft_graphs: DataFrame, draftset: str, lg: str) -> str | None:
    row = draft_graphs.filter((F.col("draftset") == draftset) & (F.col("lg") == lg)).select("dg").first()
    return row.dg if row else None


def many_drafts(draft_graphs: DataFrame) -> DataFrame:
    """Live graphs drafted in more than one draftset."""
    return draft_graphs.groupBy("lg").agg(F.count("*").alias("drafts")).filter("drafts > 1")


def graph_status(is_public: Column, has_content: Column) -> Column:
    """What publishing would do to the graph."""
    return (
        F.when(is_public & has_content, "updated")
        .when(~is_public & has_content, "created")
        .otherwise("deleted")
    )


def change_rows(draft_graphs: DataFrame, managed_graphs: DataFrame, draft: DataFrame) -> DataFrame:
    """``(draftset, lg, dg, status)`` of every draft graph.

    ``draft`` may be the names alone of the graphs that hold quads, as :meth:`Snapshot.names` has them.
    """
    filled = draft.select(F.col("g").alias("dg")).distinct().withColumn("_filled", F.lit(True))
    return (
        draft_graphs.join(managed_graphs.select("lg", "is_public"), "lg")
        .join(filled, "dg", "left")
        .select(
            "draftset",
            "lg",
            "dg",
            graph_status(F.col("is_public"), F.coalesce("_filled", F.lit(False))).alias("status"),
        )
    )


def changes_map(changes: DataFrame) -> DataFrame:
    """One map live graph -> {status} per draftset, as shown to users."""
    entry = F.struct(F.col("lg"), F.struct("status"))
    return changes.groupBy("draftset").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("changes")
    )


def bounded_counts(quads: DataFrame, most: int | None = None) -> DataFrame:
    """Statements per graph, reported as ``most + 1`` beyond the bound if there is one."""
    return bounded(quads.groupBy("g").agg(F.count("*").alias("n")), most)


def bounded(sizes: DataFrame, most: int | None = None) -> DataFrame:
    """Kept sizes ``(g, n)`` as :func:`bounded_counts` reports them, without a look at the quads."""
    return sizes.select("g", (F.col("n") if most is None else F.least("n", F.lit(most + 1))).alias("size"))


def graph_size(quads: DataFrame, graph: str, most: int) -> int:
    return quads.filter(F.col("g") == graph).limit(most + 1).count()
