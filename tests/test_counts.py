"""Kept counts agree with the quads after every write, and joins of local relations with Spark's own."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from quadweave.operators import lookup, rewrite, writes
from quadweave.plans.workspace import Workspace
from quadweave.schema import GRAPH_REF_POSITIONS, QUADS, Vocabulary, local_table, struct
from support import row, shown

NOW, VOCAB = "2024-03-01 12:00:00", Vocabulary()


def counted(snap):
    return {(s, r.g): r.n for s in ("live", "draft") for r in getattr(snap, s).groupBy("g").agg(F.count("*").alias("n")).collect()}


def kept(snap):
    return {(r.store, r.g): r.n for r in snap.counts.collect() if r.n}


@pytest.fixture
def space(spark, quads, tmp_path):
    made = Workspace(spark, str(tmp_path / "space"), clock=lambda: NOW, buckets=4)
    first = made.create_draftset("ann", id="first")
    made.append(first, quads(*[(f"s{i}", "p", "o", f"g{i % 3}") for i in range(10)]))
    made.publish(first)
    made.create_draftset("ann", id="ds")
    return made


def test_counts_follow_every_commit(space, quads):
    steps = [
        lambda: space.append("ds", quads(("a", "p", "o", "g0"), ("b", "p", "g1", "new"))),
        lambda: space.append("ds", quads(("a", "p", "o", "g0"))),
        lambda: space.delete("ds", quads(("a", "p", "o", "g0"), ("s1", "p", "o", "g1"), ("b", "p", "g1", "new"))),
        lambda: space.delete_graph("ds", "g2"),
        lambda: space.copy_live_graph("ds", "g2"),
        lambda: space.revert_graph("ds", "g0"),
        lambda: space.publish("ds"),
    ]
    assert kept(space.snapshot()) == counted(space.snapshot())
    for step in steps:
        step()
        assert kept(space.snapshot()) == counted(space.snapshot())


def test_counts_known_before_a_commit(space, quads):
    space.append("ds", quads(("a", "p", "o", "g0"), ("b", "p", "g1", "g1")))
    snap = space.snapshot()
    emptied = writes.delete_graph(snap, "ds", "g0", NOW, VOCAB)
    assert kept(emptied) == counted(emptied)
    copied = writes.copy_live_graph(emptied, "ds", "g2", NOW, VOCAB)
    assert kept(copied) == counted(copied)
    again = writes.copy_live_graph(copied, "ds", "g0", NOW, VOCAB)
    assert kept(again) == counted(again)
    word, back = writes.revert_graph(again, "ds", "g1", NOW, VOCAB)
    assert word == "reverted" and kept(back) == counted(back)
    assert writes.append(snap, "ds", quads(("c", "p", "o", "g0")), NOW, VOCAB).counts is None


def test_a_delete_looks_only_where_a_graph_may_be_empty(space, quads, monkeypatch):
    space.append("ds", quads(("a", "p", "o", "g0"), ("x", "p", "g0", "private"), ("y", "p", "private", "g0")))
    snap = space.snapshot()
    looked = []
    plain = rewrite.non_empty
    monkeypatch.setattr(rewrite, "non_empty", lambda pairs, draft: looked.append(len(pairs._rows)) or plain(pairs, draft))
    after = writes.delete(snap, "ds", quads(("a", "p", "o", "g0")), NOW, VOCAB)
    assert looked[-1] == 0
    missed = writes.delete(snap, "ds", quads(("other", "p", "g0", "private")), NOW, VOCAB)
    assert looked[-1] == 1 and missed.draft.count() == snap.draft.count()
    # All that is in the graph: the digests of the batch and of the graph are equal, no row is looked at.
    gone = writes.delete(snap, "ds", quads(("x", "p", "g0", "private"), ("a", "p", "o", "g0")), NOW, VOCAB)
    assert looked[-1] == 0
    assert after.draft.count() == snap.draft.count() - 1 and gone.draft.count() == snap.draft.count() - 2
    assert not gone.draft_graphs.filter("lg = 'private'").count() and gone.draft.filter("o = 'private'").count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_local_joins_are_sparks(spark, how):
    a = local_table(spark, [("x", 1), ("y", 2), (None, 3), ("x", 4), ("z", None)], struct("k STRING, a INT"))
    b = local_table(spark, [("u", "x"), ("v", "y"), ("w", None), ("t", "x")], struct("b STRING, k STRING"))
    want = a.join(b, "k", how)
    got = lookup.join(lookup.local(a), lookup.local(b), "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert lookup.join(a, lookup.local(b), "k", how).count() == want.count()
    both = lookup.union(lookup.local(a), lookup.local(a.select("a", "k")))
    assert sorted(map(str, both.collect())) == sorted(map(str, a.unionByName(a).collect()))


def test_few_names_are_literals_and_many_are_joined(spark, monkeypatch):
    terms = ["g1", "d1", "g2", "x", "'g1", "_:g1"]
    rows = [row(s, p, o, g) for s, p, o, g in itertools.product(["g1", "x", "_:g2"], ["g2", "p"], terms, ["g1", "h"])]
    table = local_table(spark, rows, QUADS)
    pairs = local_table(spark, [("g1", "d1"), ("g2", "d2"), ("g9", "d9")], struct("lg STRING, dg STRING"))
    few = lookup.translate(table, pairs, "lg", "dg", GRAPH_REF_POSITIONS, mark="hit")
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lookup, "PUSHDOWN_KEYS", 1)
    many = lookup.translate(table, pairs, "lg", "dg", GRAPH_REF_POSITIONS, mark="hit")
    assert "Join" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_rewriting_few_names_reads_the_draft_twice_and_joins_nothing(spark, quads, monkeypatch):
    graphs = local_table(spark, [("d1", "g1", "ds"), ("d2", "g2", "ds"), ("d3", "g3", "ds")], struct("dg STRING, lg STRING, draftset STRING"))
    draft = quads(("g1", "p", "g3", "d1"), ("x", "g2", "d1", "d2"), ("x", "p", "o", "d1"), ("g1", "p", "o", "other"), ("x", "d2", "g1", "d2"), ("x", "g2", "g1", "d2"))
    names = local_table(spark, [("d1",), ("d2",)], struct("g STRING"))
    few = rewrite.rewrite_draftset(draft, graphs, "ds", names)
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    want = {("d1", "p", "g3", "d1"), ("x", "d2", "d1", "d2"), ("x", "p", "o", "d1"), ("g1", "p", "o", "other")}
    assert shown(few) == want
    monkeypatch.setattr(lookup, "PUSHDOWN_KEYS", 1)
    assert shown(rewrite.rewrite_draftset(draft, graphs, "ds", names)) == want
    back = {("g1", "p", "g3", "d1"), ("x", "g2", "g1", "d2"), ("x", "p", "o", "d1"), ("g1", "p", "o", "other")}
    assert shown(rewrite.unrewrite_draftset(few, graphs, "ds")) == back
