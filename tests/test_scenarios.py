"""Sequences of operations on one draftset: stored quads after each, live quads after publishing."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from support import shown
from quadweave.functions.scalars import draft_graph_iri
from quadweave.operators import publish, state, workflow, writes
from quadweave.schema import TABLES, Vocabulary, local_table

VOCAB = Vocabulary()
NOW = "2024-05-01 10:00:00"
Q = {
    1: ("s1", "p1", "o1", "g1"),
    2: ("s2", "p2", "g1", "g2"),
    3: ("s3", "p3", "g2", "g3"),
}
A, B = ("s1", "p1", "g2", "g1"), ("s2", "p2", "g1", "g2")
C1, C2 = ("s1", "p1", "o1", "g1"), ("s1", "p1", "o2", "g1")
L1, L2 = ("s1", "p1", "o1", "g1"), ("s2", "p2", "o2", "g1")
X1, X2 = ("s1", "p1", "o1", "g1"), ("s2", "p2", "o2", "g2")
N3, N4 = ("s3", "p3", "o3", "g3"), ("s4", "p4", "o4", "g4")
Z = ("z1", "z1", "z1", "g1")

# name, live quads, steps of (operation, argument, expected stored quads), expected live quads.
# A trailing ' marks a draft graph.
CASES = [
    ("sequence-1", [A, B], [
        ("copy", "g1", {("s1", "p1", "g2", "g1'")}),
        ("copy", "g2", {("s1", "p1", "g2'", "g1'"), ("s2", "p2", "g1'", "g2'")}),
        ("delete-graph", "g2", {("s1", "p1", "g2", "g1'")}),
    ], {A}),
    ("copy-live", [Q[1]], [
        ("append", [Q[2]], {("s2", "p2", "g1", "g2'")}),
        ("append", [Q[3]], {("s2", "p2", "g1", "g2'"), ("s3", "p3", "g2'", "g3'")}),
        ("copy", "g1", {("s1", "p1", "o1", "g1'"), ("s2", "p2", "g1'", "g2'"), ("s3", "p3", "g2'", "g3'")}),
    ], {Q[1], Q[2], Q[3]}),
    ("1", [], [
        ("append", [Q[1]], {("s1", "p1", "o1", "g1'")}),
        ("append", [Q[2]], {("s1", "p1", "o1", "g1'"), ("s2", "p2", "g1'", "g2'")}),
    ], {Q[1], Q[2]}),
    ("2", [], [
        ("append", [Q[1]], {("s1", "p1", "o1", "g1'")}),
        ("delete", [Q[1]], set()),
        ("append", [Q[2]], {("s2", "p2", "g1", "g2'")}),
    ], {Q[2]}),
    ("3", [], [
        ("append", [Q[1]], {("s1", "p1", "o1", "g1'")}),
        ("append", [Q[2]], {("s1", "p1", "o1", "g1'"), ("s2", "p2", "g1'", "g2'")}),
        ("delete", [Q[1]], {("s2", "p2", "g1", "g2'")}),
    ], {Q[2]}),
    ("4", [], [
        ("append", [C1, C2], {("s1", "p1", "o1", "g1'"), ("s1", "p1", "o2", "g1'")}),
        ("append", [B], {("s1", "p1", "o1", "g1'"), ("s1", "p1", "o2", "g1'"), ("s2", "p2", "g1'", "g2'")}),
        ("delete", [C1], {("s1", "p1", "o2", "g1'"), ("s2", "p2", "g1'", "g2'")}),
    ], {C2, B}),
    ("5.1", [C1], [("append", [B], {("s2", "p2", "g1", "g2'")})], {C1, B}),
    ("5.2", [L1, L2], [("delete", [L2], {("s1", "p1", "o1", "g1'")})], {L1}),
    ("5.3", [C1], [
        ("append", [C2], {("s1", "p1", "o1", "g1'"), ("s1", "p1", "o2", "g1'")}),
        ("append", [B], {("s1", "p1", "o1", "g1'"), ("s1", "p1", "o2", "g1'"), ("s2", "p2", "g1'", "g2'")}),
    ], {C1, C2, B}),
    ("6.1", [L1, L2], [("delete-graph", "g1", set()), ("delete", [Z], set())], set()),
    ("6.2", [L1, L2], [("delete", [L1], {("s2", "p2", "o2", "g1'")})], {L2}),
    ("6.3", [X1, X2], [
        ("delete", [X1], set()),
        ("delete-graph", "g2", set()),
        ("append", [N3], {("s3", "p3", "o3", "g3'")}),
        ("delete", [N3], set()),
        ("append", [N4], {("s4", "p4", "o4", "g4'")}),
        ("delete-graph", "g4", set()),
    ], set()),
]


def start(spark, blank, quads, live):
    graphs = sorted({q[3] for q in live})
    managed = local_table(spark, [(g, True, None) for g in graphs], TABLES["managed_graphs"])
    sets = workflow.create_draftset(blank.draftsets, "ds", "ann", NOW, VOCAB)
    return blank.but(live=quads(*live), managed_graphs=managed, draftsets=sets)


def settled(snap):
    """Cut the plan after each step, as committing it would."""
    spark = snap.spark
    return snap.but(**{n: spark.createDataFrame(getattr(snap, n).toArrow(), TABLES[n]) for n in TABLES})


@pytest.mark.parametrize("name, live, steps, published", CASES, ids=[c[0] for c in CASES])
def test_scenario(spark, blank, quads, name, live, steps, published):
    snap = start(spark, blank, quads, live)
    graphs = [f"g{i}" for i in range(1, 5)]
    iris = spark.range(1).select(*[draft_graph_iri(F.lit("ds"), F.lit(g), VOCAB) for g in graphs]).first()
    names = {iri: g + "'" for iri, g in zip(iris, graphs)}
    for operation, argument, expected in steps:
        if operation == "append":
            snap = writes.append(snap, "ds", quads(*argument), NOW, VOCAB)
        elif operation == "delete":
            snap = writes.delete(snap, "ds", quads(*argument), NOW, VOCAB)
        elif operation == "copy":
            snap = writes.copy_live_graph(snap, "ds", argument, NOW, VOCAB)
        else:
            snap = writes.delete_graph(snap, "ds", argument, NOW, VOCAB)
        snap = settled(snap)
        stored = {tuple(names.get(x, x) for x in q) for q in shown(snap.draft)}
        assert stored == expected, (operation, argument)
    after = publish.publish(snap, "ds", NOW, VOCAB)
    assert shown(after.live) == published
    assert after.draftsets.count() == 0 and after.draft.count() == 0 and after.draft_graphs.count() == 0


def test_publish_of_emptied_draft_held_elsewhere_keeps_graph_public(spark, blank, quads):
    snap = start(spark, blank, quads, [L1])
    snap = snap.but(draftsets=workflow.create_draftset(snap.draftsets, "other", "bob", NOW, VOCAB))
    snap = settled(writes.delete_graph(snap, "ds", "g1", NOW, VOCAB))
    snap = settled(writes.append(snap, "other", quads(C2), NOW, VOCAB))
    after = publish.publish(snap, "ds", NOW, VOCAB)
    assert after.managed_graphs.filter("lg = 'g1'").select("is_public").collect()[0][0] is True
    assert shown(after.live) == set()


def test_last_publish_wins(spark, blank, quads):
    snap = start(spark, blank, quads, [L1])
    snap = snap.but(draftsets=workflow.create_draftset(snap.draftsets, "other", "bob", NOW, VOCAB))
    snap = settled(writes.append(snap, "ds", quads(("a", "p", "1", "g1")), NOW, VOCAB))
    snap = settled(writes.append(snap, "other", quads(("b", "p", "2", "g1")), NOW, VOCAB))
    snap = settled(publish.publish(snap, "ds", NOW, VOCAB))
    assert shown(snap.live) == {L1, ("a", "p", "1", "g1")}
    snap = publish.publish(snap, "other", NOW, VOCAB)
    assert shown(snap.live) == {L1, ("b", "p", "2", "g1")}


def test_guards(spark, blank, quads):
    snap = start(spark, blank, quads, [L1])
    with pytest.raises(state.ProtectedGraph):
        writes.append(snap, "ds", quads(("s", "p", "o", VOCAB.modified_graph)), NOW, VOCAB)
    with pytest.raises(state.GraphNotFound):
        writes.delete_graph(snap, "ds", "g9", NOW, VOCAB)
    assert writes.delete_graph(snap, "ds", "g9", NOW, VOCAB, silent=True) is snap
    with pytest.raises(state.GraphNotFound):
        writes.copy_live_graph(snap, "ds", "g9", NOW, VOCAB)
    with pytest.raises(ValueError, match="blank node"):
        writes.append(snap, "ds", quads(("s", "p", "o", "_:g")), NOW, VOCAB)
    assert writes.revert_graph(snap, "ds", "g1", NOW, VOCAB)[0] == "not-found"


def test_revert_keeps_graph_held_elsewhere(spark, blank, quads):
    snap = start(spark, blank, quads, [])
    snap = snap.but(draftsets=workflow.create_draftset(snap.draftsets, "other", "bob", NOW, VOCAB))
    snap = settled(writes.append(snap, "ds", quads(N3, ("x", "p", "g3", "g4")), NOW, VOCAB))
    snap = settled(writes.append(snap, "other", quads(N3), NOW, VOCAB))
    outcome, after = writes.revert_graph(snap, "ds", "g3", NOW, VOCAB)
    assert outcome == "reverted"
    assert {r.lg for r in after.managed_graphs.collect()} == {"g3", "g4", VOCAB.modified_graph}
    mine = writes.split_draft(after, "ds")[0]
    assert {(r.s, r.o) for r in mine.collect()} == {("x", "g3")}
