"""Changing a draftset: append, delete, whole-graph operations, revert.

Every function maps a :class:`Snapshot` to a new one. Inputs name graphs by their published IRIs.
The stored invariant, kept by each write: inside a draftset, references to its non-empty draft
graphs are draft IRIs, references to emptied ones are published IRIs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.scalars import is_user_graph
from quadweave.operators import compare, graphs, lookup, rewrite, state, times
from quadweave.operators.state import GraphNotFound
from quadweave.schema import GRAPH_REF_POSITIONS, QUAD_COLS, Snapshot, Vocabulary, local_table, struct
from quadweave.sources.quads import assign_graph, check_graphs


def pairs_of(snap: Snapshot, draftset: str) -> DataFrame:
    return lookup.local(snap.draft_graphs.filter(F.col("draftset") == draftset).select("lg", "dg"))


def split_draft(snap: Snapshot, draftset: str, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored draft quads (of this draftset, of all others)."""
    pairs = pairs_of(snap, draftset) if pairs is None else pairs
    mine = lookup.keep(snap.draft, pairs, key="dg")
    return mine, lookup.drop(snap.draft, pairs, key="dg")


def to_stored(quads: DataFrame, named: DataFrame, all_pairs: DataFrame) -> DataFrame:
    """Graph names by ``all_pairs``; references only to the non-empty drafts ``named``."""
    moved = lookup.translate(quads, all_pairs, "lg", "dg", rewrite.GRAPH_POSITION)
    return lookup.translate(moved, named, "lg", "dg", GRAPH_REF_POSITIONS)


is_empty = lookup.is_empty


def with_clones(
    snap: Snapshot,
    mine: DataFrame,
    old: DataFrame,
    clones: DataFrame,
    started: DataFrame | None = None,
    names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs that held quads, pairs that now start to, stored quads with the clones added).

    ``clones(lg, dg)`` are live graphs to copy in; ``started`` the drafts that get quads now, by
    default the clones; ``names(g)`` the draft graphs that hold quads, by default those of ``snap``.
    Stored references change only for graphs that start to hold quads.
    """
    filled = lookup.pick(rewrite.non_empty(old, snap.names("draft") if names is None else names), "lg", "dg")
    started = clones if started is None else started
    filled = lookup.local(filled)
    started = lookup.local(lookup.pick(lookup.join(lookup.local(started), filled, "dg", "left_anti"), "lg", "dg"))
    base = mine.select(*QUAD_COLS)
    if not is_empty(started):
        base = lookup.translate(base, started, "lg", "dg", GRAPH_REF_POSITIONS)
    if not is_empty(clones):
        named = lookup.local(lookup.union(filled, started))
        cloned = graphs.clone(snap.live, clones)
        base = base.unionByName(lookup.translate(cloned, named, "lg", "dg", GRAPH_REF_POSITIONS))
    return filled, started, base


def append(
    snap: Snapshot, draftset: str, quads: DataFrame, now, vocab: Vocabulary, graph: str | None = None
) -> Snapshot:
    """Add quads. A live graph changed for the first time is cloned; unknown graphs become private drafts."""
    if graph is not None:
        quads = assign_graph(quads, graph)
    incoming = lookup.once(quads if quads.columns == QUAD_COLS else quads.select(*QUAD_COLS))
    check_graphs(incoming)
    touched = lookup.local(incoming.select(F.col("g").alias("lg")).distinct())
    if is_empty(touched):
        return snap
    state.check_unprotected(touched, vocab)
    old = pairs_of(snap, draftset)
    fresh = lookup.local(lookup.join(touched, old, "lg", "left_anti"))
    created = state.new_drafts(fresh, draftset, now, vocab)
    new_pairs = lookup.local(created.select("lg", "dg"))
    public = lookup.local(lookup.keep(snap.managed_graphs.filter("is_public").select("lg"), fresh, "lg"))
    pairs = lookup.local(lookup.union(old, new_pairs))
    mine, others = split_draft(snap, draftset, old)
    clones = lookup.local(lookup.join(new_pairs, public, "lg", "left_semi"))
    hit = lookup.local(lookup.join(pairs, touched, "lg", "left_semi"))
    filled, started, base = with_clones(snap, mine, old, clones, hit)
    named = lookup.local(lookup.union(filled, started))
    # Only the graphs that the batch names can hold any of it; the others pass by.
    inside, outside = lookup.keep(base, hit, key="dg"), lookup.drop(base, hit, key="dg")
    after = outside.unionByName(lookup.add_new(inside, to_stored(incoming, named, pairs), like=incoming))
    snap = snap.but(
        draft=others.unionByName(after),
        managed_graphs=state.ensure_managed(snap.managed_graphs, fresh),
        draft_graphs=snap.draft_graphs.unionByName(created),
    )
    return times.touch(snap, draftset, hit, now, vocab)


def delete(
    snap: Snapshot, draftset: str, quads: DataFrame, now, vocab: Vocabulary, graph: str | None = None
) -> Snapshot:
    """Remove quads, each from its own graph only.

    Live graphs changed for the first time are cloned. A draft left empty stays as a deletion
    marker when its graph is public, and disappears otherwise. Quads of unmanaged graphs are skipped.
    """
    if graph is not None:
        quads = assign_graph(quads, graph)
    outgoing = lookup.once(quads if quads.columns == QUAD_COLS else quads.select(*QUAD_COLS))
    check_graphs(outgoing)
    sizes = lookup.local(outgoing.groupBy(F.col("g").alias("lg")).agg(F.count("*").alias("gone")))
    managed = lookup.local(lookup.keep(snap.managed_graphs.select("lg", "is_public"), sizes, "lg", "lg"))
    touched = lookup.local(lookup.join(sizes, managed, "lg"))
    if is_empty(touched):
        return snap
    state.check_unprotected(touched, vocab)
    old = pairs_of(snap, draftset)
    public = lookup.local(touched.filter("is_public"))
    created = state.new_drafts(lookup.join(public, old, "lg", "left_anti"), draftset, now, vocab)
    new_pairs = lookup.local(created.select("lg", "dg"))
    pairs = lookup.local(lookup.union(old, new_pairs))
    mine, others = split_draft(snap, draftset, old)
    filled, started, base = with_clones(snap, mine, old, new_pairs)
    named = lookup.local(lookup.union(filled, started))
    hit = lookup.local(lookup.join(pairs, touched, "lg", "left_semi"))
    # Only the graphs that the batch names can lose any quad; the others pass by.
    inside, outside = lookup.keep(base, hit, key="dg"), lookup.drop(base, hit, key="dg")
    rest = lookup.minus(inside, to_stored(outgoing, named, pairs), like=outgoing).select(*QUAD_COLS)
    left = outside.unionByName(rest)
    # Only a graph with no more quads than the batch names in it can have lost all of them.
    unsure = _within(snap, lookup.join(hit, lookup.local(lookup.pick(touched, "lg", "gone")), "lg"), new_pairs)
    # Where the batch is all there is, the digests of both are equal; only other graphs are looked at by rows.
    differ = _unlike(lookup.keep(base, unsure, key="dg"), lookup.keep(to_stored(outgoing, named, pairs), unsure, key="dg"), unsure)
    still = rewrite.non_empty(differ, lookup.keep(rest, differ, key="dg"))
    # References to drafts that have just lost their last quad go back to the published name.
    ended = lookup.local(lookup.pick(lookup.join(unsure, still, "dg", "left_anti"), "lg", "dg"))
    after = left if is_empty(ended) else lookup.translate(left, ended, "dg", "lg", GRAPH_REF_POSITIONS)
    private = lookup.local(touched.filter(~F.col("is_public")))
    vanished = lookup.local(lookup.join(ended, private, "lg", "left_semi"))
    draft_graphs = snap.draft_graphs.unionByName(created).join(vanished.select("dg"), "dg", "left_anti")
    draft_graphs = draft_graphs.select(*state.columns_of("draft_graphs"))
    snap = snap.but(
        draft=others.unionByName(after),
        draft_graphs=draft_graphs,
        managed_graphs=times.drop_orphans(snap.managed_graphs, draft_graphs, vanished),
    )
    kept = lookup.local(lookup.join(hit, vanished, "dg", "left_anti"))
    return _after_delete(snap, draftset, kept, vanished, now, vocab)


def _unlike(stored: DataFrame, batch: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose stored quads are not just those of the batch, by order-free digests."""
    if is_empty(pairs):
        return pairs
    other = lookup.local(compare.unequal(stored, batch, "g").select(F.col("g").alias("dg")))
    return lookup.local(lookup.join(pairs, other, "dg", "left_semi"))


def _within(snap: Snapshot, hit: DataFrame, cloned: DataFrame) -> DataFrame:
    """The pairs of ``hit(lg, dg, gone)`` that hold at most ``gone`` quads, clones counted with the live graph; all, if no counts are kept."""
    if snap.counts is None:
        return lookup.local(hit.select("lg", "dg"))
    live = lookup.local(lookup.keep(snap.sizes("live").select(F.col("g").alias("lg"), F.col("n").alias("_c")), cloned, "lg", "lg"))
    copies = lookup.local(lookup.pick(lookup.join(cloned, live, "lg"), "dg", "_c"))
    stored = lookup.local(lookup.keep(snap.sizes("draft").select(F.col("g").alias("dg"), F.col("n").alias("_n")), hit, "dg", "dg"))
    sized = lookup.local(lookup.join(lookup.join(lookup.local(hit), stored, "dg", "left"), copies, "dg", "left"))
    held = F.coalesce("_n", F.lit(0)) + F.coalesce("_c", F.lit(0))
    return lookup.local(sized.filter(held <= F.col("gone")).select("lg", "dg"))


def _after_delete(snap: Snapshot, draftset: str, kept: DataFrame, vanished: DataFrame, now, vocab: Vocabulary):
    """Drafts still there get a new time; without any, only the vanished times go."""
    if not is_empty(kept):
        snap = times.touch(snap, draftset, kept, now, vocab)
    return times.forget(snap, draftset, vanished, now, vocab)


def _one(snap: Snapshot, graph: str) -> DataFrame:
    return lookup.local(local_table(snap.spark, [(graph,)], struct("lg STRING")))


def _with_draft(snap: Snapshot, draftset: str, graph: str, now, vocab: Vocabulary) -> tuple[Snapshot, DataFrame, DataFrame]:
    """(snapshot in which the graph has a draft in this draftset, all pairs of the draftset, the graph's own)."""
    one = _one(snap, graph)
    pairs = pairs_of(snap, draftset)
    missing = lookup.local(lookup.join(one, pairs, "lg", "left_anti"))
    created = state.new_drafts(missing, draftset, now, vocab)
    pairs = lookup.local(lookup.union(pairs, lookup.local(created.select("lg", "dg"))))
    if not is_empty(missing):
        snap = snap.but(draft_graphs=snap.draft_graphs.unionByName(created))
    return snap, pairs, lookup.local(pairs.filter(F.col("lg") == graph))


def _recounted(snap: Snapshot, gone: DataFrame, copied: str | None = None) -> DataFrame | None:
    """Kept counts without the drafts ``gone(dg)``, or with the size of a live graph for the one that copies it."""
    if snap.counts is None:
        return None
    names = [row[gone.columns.index("dg")] for row in gone._rows]
    rest = snap.counts.filter((F.col("store") != "draft") | ~F.col("g").isin(names))
    if copied is None:
        return rest
    copy = snap.sizes("live").filter(F.col("g") == copied).select(F.lit("draft").alias("store"), F.lit(names[0]).alias("g"), "n")
    return rest.unionByName(copy)


def delete_graph(
    snap: Snapshot, draftset: str, graph: str, now, vocab: Vocabulary, silent: bool = False
) -> Snapshot:
    """Empty the draft of a graph, making one if needed; publishing it deletes the graph."""
    state.check_unprotected(_one(snap, graph), vocab)
    if not state.is_graph_managed(snap.managed_graphs, graph):
        if silent:
            return snap
        raise GraphNotFound(graph)
    snap, pairs, target = _with_draft(snap, draftset, graph, now, vocab)
    mine, others = split_draft(snap, draftset, pairs)
    emptied = lookup.drop(mine, target, key="dg")
    after = lookup.translate(emptied, target, "dg", "lg", GRAPH_REF_POSITIONS)
    snap = snap.but(draft=others.unionByName(after), counts=_recounted(snap, target))
    return times.touch(snap, draftset, target, now, vocab)


def revert_graph(snap: Snapshot, draftset: str, graph: str, now, vocab: Vocabulary) -> tuple[str, Snapshot]:
    """Forget the changes to one graph. Returns ('reverted' | 'not-found', snapshot)."""
    dg = state.find_draft(snap.draft_graphs, draftset, graph)
    if dg is None:
        return "not-found", snap
    one = lookup.local(local_table(snap.spark, [(graph, dg)], struct("lg STRING, dg STRING")))
    mine, others = split_draft(snap, draftset)
    # References to the reverted draft become references to the published graph.
    rest = lookup.translate(mine.filter(F.col("g") != dg), one, "dg", "lg", GRAPH_REF_POSITIONS)
    draft_graphs = snap.draft_graphs.filter(F.col("dg") != dg)
    after = snap.but(
        draft=others.unionByName(rest),
        draft_graphs=draft_graphs,
        managed_graphs=times.drop_orphans(snap.managed_graphs, draft_graphs, [graph]),
        counts=_recounted(snap, one),
    )
    return "reverted", times.forget(after, draftset, one.select("dg"), now, vocab)


def copy_live_graph(snap: Snapshot, draftset: str, graph: str, now, vocab: Vocabulary) -> Snapshot:
    """Replace the draft of a live graph by the live content. Modified times stay as they are."""
    if not state.is_graph_live(snap.managed_graphs, graph):
        raise GraphNotFound(f"not live: {graph}")
    state.check_unprotected(_one(snap, graph), vocab)
    snap, pairs, target = _with_draft(snap, draftset, graph, now, vocab)
    mine, others = split_draft(snap, draftset, pairs)
    emptied = lookup.drop(mine, target, key="dg")
    if state.is_graph_empty(snap.names("live"), graph):
        after = lookup.translate(emptied, target, "dg", "lg", GRAPH_REF_POSITIONS)
    else:
        others_filled = lookup.drop(snap.names("draft"), target, key="dg")
        _, _, after = with_clones(snap, emptied, pairs, target, names=others_filled)
    return snap.but(draft=others.unionByName(after), counts=_recounted(snap, target, graph))


def delete_draftset(snap: Snapshot, draftset: str) -> Snapshot:
    """Remove a draftset with its draft graphs, submissions, shares and times."""
    _, others = split_draft(snap, draftset)
    mine = F.col("draftset") == draftset
    draft_graphs = snap.draft_graphs.filter(~mine)
    return snap.but(
        draft=others,
        draft_graphs=draft_graphs,
        managed_graphs=times.drop_orphans(
            snap.managed_graphs, draft_graphs, snap.draft_graphs.filter(mine).select("lg")
        ),
        draftsets=snap.draftsets.filter(~mine),
        submissions=snap.submissions.filter(~mine),
        shares=snap.shares.filter(~mine),
        graph_modified=snap.graph_modified.filter(F.col("scope") != draftset),
    )


def user_pairs(snap: Snapshot, draftset: str, vocab: Vocabulary, pairs: DataFrame | None = None) -> DataFrame:
    pairs = pairs_of(snap, draftset) if pairs is None else pairs
    return lookup.local(pairs.filter(is_user_graph(F.col("lg"), vocab)))
