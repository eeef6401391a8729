"""Making a draftset live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.operators import lookup, rewrite, times, writes
from quadweave.operators.state import instant
from quadweave.schema import GRAPH_REF_POSITIONS, QUAD_COLS, Snapshot, Vocabulary


def published_quads(snap: Snapshot, draftset: str, vocab: Vocabulary, pairs: DataFrame | None = None) -> DataFrame:
    """Live quads after the publish: changed graphs are replaced whole; the last publish wins.

    Both sides are one filtered pass with a broadcast of the graph names: no shuffle of quads.
    """
    pairs = writes.user_pairs(snap, draftset, vocab, pairs)
    untouched = lookup.drop(snap.live, pairs, key="lg")
    mine = lookup.keep(snap.draft, pairs, key="dg")
    moved = lookup.translate(
        mine, pairs, "dg", "lg", [*rewrite.GRAPH_POSITION, *GRAPH_REF_POSITIONS]
    )
    return untouched.select(*QUAD_COLS).unionByName(moved.select(*QUAD_COLS))


def published_managed(snap: Snapshot, draftset: str, now, vocab: Vocabulary, pairs: DataFrame | None = None) -> DataFrame:
    """Managed graphs after the publish.

    Published graphs become public and get their first issue time. A graph deleted by the publish is
    no longer managed, unless another draftset also drafts it: then it stays, public but empty.
    """
    everything = writes.pairs_of(snap, draftset) if pairs is None else pairs
    pairs = writes.user_pairs(snap, draftset, vocab, everything)
    filled = lookup.local(rewrite.non_empty(pairs, snap.names("draft")).select("lg"))
    elsewhere = snap.draft_graphs.filter(F.col("draftset") != draftset).select("lg")
    removed = lookup.join(pairs, filled, "lg", "left_anti").select("lg").join(elsewhere, "lg", "left_anti")
    touched = pairs.select("lg", F.lit(True).alias("_hit")).distinct()
    merged = snap.managed_graphs.join(touched, "lg", "left").join(removed, "lg", "left_anti")
    hit = F.col("_hit").isNotNull()
    timed = F.col("lg") == vocab.modified_graph
    has_times = everything.filter(timed).select("lg", F.lit(True).alias("_timed"))
    merged = merged.join(has_times, "lg", "left")
    return merged.select(
        "lg",
        F.when(hit | F.col("_timed"), True).otherwise(F.col("is_public")).alias("is_public"),
        F.when(hit, F.coalesce("issued", instant(now))).otherwise(F.col("issued")).alias("issued"),
    )


def publish(snap: Snapshot, draftset: str, now, vocab: Vocabulary) -> Snapshot:
    """The whole publish as one new snapshot, so readers see all of it or nothing."""
    mine = F.col("draftset") == draftset
    pairs = writes.pairs_of(snap, draftset)
    _, others = writes.split_draft(snap, draftset, pairs)
    has_times = not pairs.filter(F.col("lg") == vocab.modified_graph).limit(1).isEmpty()
    graph_modified = (
        times.publish_times(snap, draftset, now, vocab)
        if has_times
        else snap.graph_modified.filter(F.col("scope") != draftset)
    )
    return snap.but(
        live=published_quads(snap, draftset, vocab, pairs),
        draft=others,
        managed_graphs=published_managed(snap, draftset, now, vocab, pairs),
        draft_graphs=snap.draft_graphs.filter(~mine),
        graph_modified=graph_modified,
        endpoints=times.stamp_endpoint(snap.endpoints, now, vocab),
        draftsets=snap.draftsets.filter(~mine),
        submissions=snap.submissions.filter(~mine),
        shares=snap.shares.filter(~mine),
    )
