"""Ordered update batches: rows ``(seq, op, silent, quad)`` with op insert, delete or drop.

A batch may be of any size. A caller that wants small ones gives ``max_size``: larger batches, and
batches that would clone or drop larger graphs, are then refused before anything is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.functions.scalars import is_protected
from quadweave.operators import lookup, rewrite, state, times, writes
from quadweave.operators.state import GraphNotFound, ProtectedGraph
from quadweave.schema import GRAPH_REF_POSITIONS, QUAD_COLS, QUADS, Snapshot, Vocabulary, struct

#: Fixed value: the limit of a production service. It holds only where a caller asks for it.
MAX_UPDATE_SIZE = 5000
UPDATE_OPS = T.StructType(struct("seq INT, op STRING, silent BOOLEAN").fields + QUADS.fields)
KINDS = ["insert", "delete", "drop"]


class Unprocessable(ValueError):
    pass


class TooLarge(ValueError):
    pass


class CannotCopy(ValueError):
    pass


def problems(ops: DataFrame, vocab: Vocabulary, max_size: int | None = None) -> DataFrame:
    """One row of the batch's totals and violations; an insert or delete row is one quad, a drop counts one."""
    return ops.agg(
        F.count("*").cast("bigint").alias("size"),
        F.count_if(is_protected(F.col("g"), vocab)).alias("protected"),
        F.count_if(~F.col("op").isin(KINDS)).alias("unprocessable"),
        (F.lit(False) if max_size is None else F.count("*") > max_size).alias("too_large"),
    )


def validate(ops: DataFrame, vocab: Vocabulary, max_size: int | None = None) -> None:
    found = problems(ops, vocab, max_size).first()
    _raise(found.protected, found.unprocessable, found.size, max_size)


def _raise(protected: int, unprocessable: int | None, size: int, max_size: int | None) -> None:
    if protected:
        raise ProtectedGraph("protected graphs in update")
    if unprocessable:
        raise Unprocessable("only insert, delete and drop can be processed")
    if max_size is not None and size > max_size:
        raise TooLarge(f"{size} > {max_size}")


def affected(ops: DataFrame) -> DataFrame:
    """One mergeable summary per graph: its first operation, its last drop, what its rows are.

    Everything an update asks of its batch before it writes comes from these rows.
    """
    first = F.min(F.struct("seq", "op", "silent"))
    data = F.col("op") != "drop"
    return ops.groupBy(F.col("g").alias("lg")).agg(
        first["op"].alias("first_op"),
        first["silent"].alias("first_silent"),
        F.max(F.when(~data, F.col("seq"))).alias("last_drop"),
        F.max(F.when(data, F.col("seq"))).alias("last_data"),
        F.count_if(~data).alias("drops"),
        F.min(F.when(data, F.col("seq"))).alias("first_data"),
        F.min(F.when(~data & ~F.col("silent"), F.col("seq"))).alias("first_loud_drop"),
        F.count("*").cast("bigint").alias("rows"),
        F.count_if(~F.col("op").isin(KINDS)).alias("others"),
    )


def refuse(about: DataFrame, vocab: Vocabulary, max_size: int | None = None) -> None:
    """The checks of :func:`validate` on the summary of a batch."""
    found = about.agg(
        F.count_if(is_protected(F.col("lg"), vocab)).alias("protected"), F.sum("others").alias("unprocessable"), F.sum("rows").alias("size")
    ).first()
    _raise(found.protected, found.unprocessable, found.size or 0, max_size)


def _sizes(snap: Snapshot, store: str, graphs_: DataFrame, key: str, most: int | None) -> DataFrame:
    """Bounded sizes of the graphs named: kept ones if there are any, else counted among those graphs alone."""
    if snap.counts is not None:
        return state.bounded(lookup.keep(snap.sizes(store), graphs_, key=key), most)
    return state.bounded_counts(lookup.keep(getattr(snap, store), graphs_, key=key), most)


def graph_meta(graphs_: DataFrame, draftset: str, snap: Snapshot, most: int | None = None) -> DataFrame:
    """State and bounded sizes of ``graphs_(lg)``; drafts in other draftsets do not count.

    Few graphs meet the bookkeeping tables as literals, and one another without a job; many are computed once.
    """
    graphs_ = lookup.once(lookup.local(graphs_))
    mine = snap.draft_graphs.filter(F.col("draftset") == draftset).select("lg", "dg")
    mine = lookup.local(lookup.keep(mine, graphs_, "lg", "lg"))
    public = snap.managed_graphs.filter("is_public").select("lg", F.lit(True).alias("_live"))
    public = lookup.local(lookup.keep(public, graphs_, "lg", "lg"))
    wanted = lookup.join(lookup.join(graphs_, mine, "lg", "left"), public, "lg", "left")
    drafts = lookup.local(wanted.filter(F.col("dg").isNotNull()).select("dg"))
    live_sizes = lookup.local(_sizes(snap, "live", graphs_, "lg", most).select(F.col("g").alias("lg"), F.col("size").alias("_ls")))
    draft_sizes = lookup.local(_sizes(snap, "draft", drafts, "dg", most).select(F.col("g").alias("dg"), F.col("size").alias("_ds")))
    sized = lookup.join(lookup.join(wanted, live_sizes, "lg", "left"), draft_sizes, "dg", "left")
    zero = F.lit(0).cast("bigint")
    state_ = F.when(F.col("dg").isNotNull(), "draft").when(F.col("_live"), "live").otherwise("unmanaged")
    sizes = [F.coalesce("_ds", zero).alias("draft_size"), F.coalesce("_ls", zero).alias("live_size")]
    return lookup.local(sized.select("lg", "dg", state_.alias("state"), *sizes))


def final_rows(ops: DataFrame) -> DataFrame:
    """Last word on each quad: rows after the graph's last drop, the latest operation winning."""
    drops = ops.filter("op = 'drop'").groupBy(F.col("g").alias("_g")).agg(F.max("seq").alias("_drop"))
    after = F.col("_drop").isNull() | (F.col("seq") > F.col("_drop"))
    live_rows = ops.filter("op != 'drop'").join(drops, F.col("g") == F.col("_g"), "left").filter(after)
    return live_rows.groupBy(*QUAD_COLS).agg(F.max_by("op", "seq").alias("op"))


def plan(snap: Snapshot, draftset: str, ops: DataFrame, max_size: int | None = None) -> DataFrame:
    """What each graph of a batch needs: see :func:`planned`."""
    return planned(snap, draftset, lookup.local(affected(ops)), max_size)


def planned(snap: Snapshot, draftset: str, about: DataFrame, max_size: int | None = None) -> DataFrame:
    """What each affected graph needs first: touch, clone, empty draft, new draft, or nothing.

    ``error`` names what stops the batch: a live graph too large to clone, a draft too large to
    drop, or a loud drop of a graph that is not there yet.
    """
    meta = graph_meta(about.select("lg"), draftset, snap, max_size)
    joined = lookup.join(about, meta, "lg")
    data_first = F.col("first_op") != "drop"
    missing = (F.col("state") == "unmanaged") & F.col("first_loud_drop").isNotNull() & (
        F.col("first_data").isNull() | (F.col("first_loud_drop") < F.col("first_data"))
    )
    setup = (
        F.when(F.col("state") == "draft", "touch")
        .when((F.col("state") == "live") & data_first, "clone")
        .when(F.col("state") == "live", "empty_draft")
        .when(F.col("first_data").isNotNull(), "new_draft")
        .otherwise("nothing")
    )
    beyond = lambda size: F.lit(False) if max_size is None else F.col(size) > max_size
    error = (
        F.when((F.col("state") == "live") & data_first & beyond("live_size"), "clone_too_large")
        .when((F.col("state") == "draft") & (F.col("drops") > 0) & beyond("draft_size"), "drop_too_large")
        .when(missing, "not_found")
    )
    return joined.select(
        "lg", "dg", "state", "draft_size", "live_size", "last_drop", setup.alias("setup"), error.alias("error")
    )


def _filled_after(
    snap: Snapshot, before: DataFrame, touched: DataFrame, sized: DataFrame, dropped: DataFrame, final: DataFrame, after: DataFrame
) -> DataFrame:
    """The pairs that hold quads after an update, from sizes where these settle it.

    Graphs that were not touched stay as they were. A touched one holds quads if any were inserted, and
    none if it was dropped without; if more quads were in it than the batch deletes, some are left.
    Only what is still open is looked up in the quads of these graphs.
    """
    words = final.groupBy(F.col("g").alias("dg")).agg(F.count_if(F.col("op") == "insert").alias("_in"), F.count_if(F.col("op") == "delete").alias("_out"))
    asked = lookup.join(lookup.join(touched, lookup.local(words), "dg", "left"), sized, "dg", "left")
    asked = lookup.join(asked, lookup.local(dropped.select("dg", F.lit(True).alias("_dropped"))), "dg", "left")
    some = F.coalesce("_in", F.lit(0)) > 0
    left = F.coalesce(F.col("_size") > F.coalesce("_out", F.lit(0)), F.lit(False))
    verdict = F.when(some, "filled").when(F.col("_dropped"), "empty").when(left, "filled").otherwise("open")
    judged = lookup.local(asked.select("lg", "dg", verdict.alias("verdict")))
    surely = lookup.local(judged.filter("verdict = 'filled'").select("lg", "dg"))
    open_ = lookup.local(judged.filter("verdict = 'open'").select("lg", "dg"))
    found = open_ if writes.is_empty(open_) else rewrite.non_empty(open_, lookup.keep(after, open_, key="dg"))
    found = lookup.pick(found, "lg", "dg")
    others = lookup.pick(lookup.join(before, touched, "dg", "left_anti"), "lg", "dg")
    return lookup.local(lookup.union(lookup.union(lookup.local(others), surely), lookup.local(found)))


def update(
    snap: Snapshot, draftset: str, ops: DataFrame, now, vocab: Vocabulary, max_size: int | None = None
) -> Snapshot:
    """Apply an ordered batch of insert, delete and drop rows to a draftset."""
    ops = lookup.once(ops if ops.columns == UPDATE_OPS.fieldNames() else ops.select(*UPDATE_OPS.fieldNames()))
    about = lookup.local(affected(ops))
    refuse(about, vocab, max_size)
    needs = lookup.local(planned(snap, draftset, about, max_size))
    failed = needs.filter(F.col("error").isNotNull()).orderBy("lg").select("lg", "error").first()
    if failed:
        kind = GraphNotFound if failed.error == "not_found" else CannotCopy
        raise kind(f"{failed.error}: {failed.lg}")
    work = lookup.local(needs.filter(F.col("setup") != "nothing"))
    if writes.is_empty(work):
        return snap
    fresh = lookup.local(work.filter(F.col("setup") != "touch").select("lg"))
    created = state.new_drafts(fresh, draftset, now, vocab)
    new_pairs = lookup.local(created.select("lg", "dg"))
    old = writes.pairs_of(snap, draftset)
    pairs = lookup.local(lookup.union(old, new_pairs))
    touched = lookup.local(lookup.join(pairs, work, "lg", "left_semi"))
    clones = lookup.local(work.filter(F.col("setup") == "clone").select("lg"))
    cloned = lookup.local(lookup.join(new_pairs, clones, "lg", "left_semi"))
    mine, others = writes.split_draft(snap, draftset, old)
    filled, started, base = writes.with_clones(snap, mine, old, cloned)
    before = lookup.local(lookup.union(filled, started))
    drops = lookup.local(needs.filter(F.col("last_drop").isNotNull()).select("lg"))
    dropped = lookup.local(lookup.join(pairs, drops, "lg", "left_semi"))
    kept = lookup.drop(base, dropped, key="dg")
    final = lookup.once(writes.to_stored(final_rows(ops), before, pairs))
    # Only the graphs that the batch names can lose any quad; the others pass by.
    inside, outside = lookup.keep(kept, touched, key="dg"), lookup.drop(kept, touched, key="dg")
    rest = outside.select(*QUAD_COLS).unionByName(lookup.minus(inside, final, like=final).select(*QUAD_COLS))
    after = rest.unionByName(final.filter(F.col("op") == "insert").select(*QUAD_COLS))
    size = F.when(F.col("setup") == "touch", F.col("draft_size")).when(F.col("setup") == "clone", F.col("live_size"))
    # A size beyond a bound is told as one more than it: still a lower bound of what a graph holds.
    sizes = lookup.local(work.select("lg", size.alias("_size")))
    sized = lookup.local(lookup.pick(lookup.join(touched, sizes, "lg"), "dg", "_size"))
    named = _filled_after(snap, before, touched, sized, dropped, final, after)
    # References change only for drafts that went from empty to filled or back.
    ended = lookup.local(lookup.pick(lookup.join(before, named, "dg", "left_anti"), "lg", "dg"))
    begun = lookup.local(lookup.pick(lookup.join(named, before, "dg", "left_anti"), "lg", "dg"))
    if not writes.is_empty(ended):
        after = lookup.translate(after, ended, "dg", "lg", GRAPH_REF_POSITIONS)
    if not writes.is_empty(begun):
        after = lookup.translate(after, begun, "lg", "dg", GRAPH_REF_POSITIONS)
    snap = snap.but(
        draft=others.unionByName(after),
        draft_graphs=snap.draft_graphs.unionByName(created),
        managed_graphs=state.ensure_managed(snap.managed_graphs, fresh),
    )
    return times.touch_updated(snap, draftset, touched, named, now, vocab)
