from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from support import row, shown
from quadweave.functions import terms as T
from quadweave.operators import inference, retention, slices, times, update, workflow, writes
from quadweave.operators import patterns as pt
from quadweave.operators.state import GraphNotFound, ProtectedGraph
from quadweave.plans import views
from quadweave.schema import OWL_THING, QUAD_COLS, RDF_TYPE, RDFS_SUBCLASS, TABLES, Vocabulary, local_table, struct

VOCAB = Vocabulary()
NOW, LATER = "2024-05-01 10:00:00", "2024-05-02 10:00:00"


def table(spark, name, *rows):
    return local_table(spark, rows, TABLES[name])


# Patterns


def test_optional_with_unbound_shared_variable_against_definition(spark):
    values = [None, "1", "2"]
    left = [(k, v) for k in "ab" for v in values]
    right = [(k, v, f"{k}{v}") for k, v in itertools.product("ac", values)]
    iri = lambda c: F.when(F.col(c).isNotNull(), T.iri(F.col(c))).alias(c)
    l_df = local_table(spark, left, struct("k STRING, v STRING")).select(iri("k"), iri("v"))
    r_df = local_table(spark, right, struct("k STRING, v STRING, w STRING")).select(iri("k"), iri("v"), iri("w"))
    expected = []
    for k, v in left:
        hits = [(k, v or rv, w) for rk, rv, w in right if rk == k and (v is None or rv is None or v == rv)]
        expected += hits or [(k, v, None)]
    found = pt.optional(l_df, r_df, maybe_unbound=["v"]).select("k.value", "v.value", "w.value").collect()
    key = lambda t: tuple(x or "" for x in t)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_default_graph_is_a_merge(spark, quads):
    have = quads(("s", "p", "o", "g1"), ("s", "p", "o", "g2"))
    assert pt.pattern(have, "?s", "?p", "?o").count() == 1
    assert pt.pattern(have, "?s", "?p", "?o", "?g").count() == 2


def test_literal_is_not_the_iri(spark, quads):
    have = quads(("s", "p", "http://x", "g"), ("s", "p", "'http://x", "g"))
    assert pt.pattern(have, "?s", "?p", pt.iri("http://x"), "?g").count() == 1
    assert pt.pattern(have, "?s", pt.text("p"), "?o", "?g").count() == 0


def test_no_products(spark, quads):
    have = quads(("s", "p", "o", "g"))
    with pytest.raises(ValueError):
        pt.join(pt.pattern(have, "?a", "?b", "?c", "?d"), pt.pattern(have, "?e", "?f", "?h", "?i"))


def test_first_or_error(spark):
    assert pt.first_or_error(spark.range(0)) is None
    assert pt.first_or_error(spark.range(1)).id == 0
    with pytest.raises(ValueError):
        pt.first_or_error(spark.range(2))


# Views


def published(spark, blank, quads):
    managed = [("l1", True, None), ("l2", True, None), ("l3", False, None), ("l4", False, None)]
    pairs = [("d2", "l2", "ds", None), ("d3", "l3", "ds", None), ("d4", "l4", "ds", None)]
    return blank.but(
        live=quads(("a", "p", "x", "l1"), ("b", "p", "x", "l2"), ("c", "p", "x", "unmanaged")),
        draft=quads(("b", "p", "d3", "d2"), ("d3", "p", "'d3", "d3")),
        managed_graphs=table(spark, "managed_graphs", *managed),
        draft_graphs=table(spark, "draft_graphs", *pairs),
    )


def test_views(spark, blank, quads):
    snap = published(spark, blank, quads)
    assert shown(views.live_view(snap.live, snap.managed_graphs)) == {("a", "p", "x", "l1"), ("b", "p", "x", "l2")}
    mine = {("b", "p", "l3", "l2"), ("l3", "p", "'d3", "l3")}
    assert shown(views.draft_view(snap, "ds")) == mine
    assert shown(views.draft_view(snap, "ds", union_with_live=True)) == mine | {("a", "p", "x", "l1")}


@pytest.mark.parametrize("union, lgs, expected", [
    (True, [], {"l1", "l2"}),
    (True, ["l2", "l3", "l4"], {"l1", "d2", "d3", "d4"}),
    (False, [], set()),
    (False, ["l1", "l2"], {"d1", "d2"}),
])
def test_raw_graphs(spark, blank, quads, union, lgs, expected):
    managed = table(spark, "managed_graphs", ("l1", True, None), ("l2", True, None))
    pairs = local_table(spark, [(lg, lg.replace("l", "d")) for lg in lgs], struct("lg STRING, dg STRING"))
    assert {r.graph for r in views.raw_graphs(pairs, managed, union).collect()} == expected


def test_nothing_visible_is_nothing(spark):
    visible = local_table(spark, [("l1",), ("l2",)], struct("lg STRING"))
    ask = views.effective_dataset(views.Dataset(default=["l1"]), views.Dataset(default=["gone"]))
    default, named = views.restrict(ask, visible)
    assert default.count() == 0 and named.count() == 0
    assert [x.count() for x in views.restrict(views.Dataset(), visible)] == [2, 2]


# Modified times


def test_merged_times(spark):
    from datetime import datetime

    def rows(**times_):
        return local_table(spark, [(g, datetime.fromisoformat(t)) for g, t in times_.items()], struct("graph STRING, modified TIMESTAMP"))

    live = rows(a="2024-01-01T00:00:00+00:00", b="2024-01-05T00:00:00+00:00", c="2024-01-01T00:00:00+00:00")
    draft = rows(a="2024-01-02T00:00:00+00:00", b="2024-01-02T00:00:00+00:00", d="2024-01-02T00:00:00+00:00")
    merged = times.merge_times(live, draft, NOW).select("graph", F.date_format("modified", "MM-dd").alias("m"), "change")
    assert {r.graph: (r.m, r.change) for r in merged.collect()} == {
        "a": ("01-02", "modified"),
        "b": ("05-01", "modified"),  # published later than the draft changed: the time of this publish
        "c": ("01-01", "unmodified"),
        "d": ("01-02", "new"),
    }


def test_times_graph_goes_with_the_last_user_graph(spark, blank, quads):
    snap = blank.but(draftsets=workflow.create_draftset(blank.draftsets, "ds", "ann", NOW, VOCAB))
    snap = writes.append(snap, "ds", quads(("s", "p", "o", "g")), NOW, VOCAB)
    assert snap.graph_modified.count() == 2 and snap.draft_graphs.count() == 2
    version = snap.draftsets.first().version
    _, after = writes.revert_graph(snap, "ds", "g", LATER, VOCAB)
    assert after.graph_modified.count() == 0 and after.draft_graphs.count() == 0 and after.managed_graphs.count() == 0
    assert after.draftsets.first().version != version


# Update batches


def ops(spark, *rows):
    done = []
    for seq, op, silent, q in rows:
        done.append((seq, op, silent, *(row(*q) if len(q) == 4 else (q[0], *[None] * 7))))
    return local_table(spark, done, update.UPDATE_OPS)


def with_draft(spark, blank, quads, *live):
    graphs = {q[3] for q in live}
    return blank.but(
        live=quads(*live),
        managed_graphs=table(spark, "managed_graphs", *[(g, True, None) for g in graphs]),
        draftsets=workflow.create_draftset(blank.draftsets, "ds", "ann", NOW, VOCAB),
    )


def test_update_order_matters(spark, blank, quads):
    snap = with_draft(spark, blank, quads, ("s", "p", "o", "g"))
    q, r = ("x", "p", "y", "g"), ("z", "p", "y", "g")
    done = update.update(snap, "ds", ops(
        spark, (1, "insert", False, q), (2, "drop", False, ("g",)), (3, "insert", False, r), (4, "delete", False, r), (5, "insert", False, r),
    ), NOW, VOCAB)
    assert {(s, o) for s, _, o, _ in shown(done.draft)} == {("z", "y")}


def test_update_limits(spark, blank, quads):
    snap = with_draft(spark, blank, quads, *[(f"s{i}", "p", "o", "g") for i in range(4)])
    one = ("x", "p", "y", "g")
    with pytest.raises(update.CannotCopy):
        update.update(snap, "ds", ops(spark, (1, "insert", False, one)), NOW, VOCAB, max_size=3)
    with pytest.raises(update.TooLarge):
        update.update(snap, "ds", ops(spark, (1, "insert", False, one), (2, "drop", False, ("g",))), NOW, VOCAB, max_size=1)
    with pytest.raises(update.Unprocessable):
        update.update(snap, "ds", ops(spark, (1, "load", False, one)), NOW, VOCAB)
    with pytest.raises(ProtectedGraph):
        update.update(snap, "ds", ops(spark, (1, "insert", False, ("x", "p", "y", VOCAB.modified_graph))), NOW, VOCAB)
    with pytest.raises(GraphNotFound):
        update.update(snap, "ds", ops(spark, (1, "drop", False, ("nowhere",))), NOW, VOCAB)
    assert update.update(snap, "ds", ops(spark, (1, "drop", True, ("nowhere",))), NOW, VOCAB) is snap
    done = update.update(snap, "ds", ops(spark, (1, "drop", False, ("g",))), NOW, VOCAB, max_size=3)
    assert done.draft.count() == 0 and done.draft_graphs.filter("lg = 'g'").count() == 1


def test_drop_of_large_draft_is_refused(spark, blank, quads):
    snap = with_draft(spark, blank, quads)
    snap = writes.append(snap, "ds", quads(*[(f"s{i}", "p", "o", "g") for i in range(4)]), NOW, VOCAB)
    with pytest.raises(update.CannotCopy):
        update.update(snap, "ds", ops(spark, (1, "drop", False, ("g",))), NOW, VOCAB, max_size=3)


# Retention


MANIFEST = struct("hash STRING, file STRING, livemod BIGINT, draftmod BIGINT, size_bytes BIGINT, last_access BIGINT")
GB = 1 << 30


def manifest(spark, *rows):
    return local_table(spark, [(h, f"f{i}", lm, dm, size, at) for i, (h, lm, dm, size, at) in enumerate(rows)], MANIFEST)


def files(df):
    return {r.file for r in df.collect()}


@pytest.mark.parametrize("rows, expected", [
    ([("h", 1, None), ("k", 5, 6)], set()),
    ([("h", 9_999_999, None), ("h", 1, None)], {"f1"}),
    ([("h", 100, 105), ("h", 100, 999)], {"f0"}),
    ([("h", 1, None), ("h", 101, 105)], {"f0"}),
    ([("h", None, None), ("h", 100, None)], {"f0"}),
    ([("h", None, None)], set()),
    ([("h", None, 4), ("h", None, 7), ("k", 1, None)], {"f0"}),
])
def test_expired(spark, rows, expected):
    assert files(retention.expired(manifest(spark, *[(h, a, b, 1, 0) for h, a, b in rows]))) == expected


def test_oldest_to_free(spark):
    one = manifest(spark, ("h", 1, None, GB, 5))
    assert files(retention.oldest_to_free(one, 1)) == {"f0"} and files(retention.oldest_to_free(one, 0)) == set()
    two = manifest(spark, ("h", 1, None, GB, 5), ("k", 1, None, GB, 9))
    assert files(retention.oldest_to_free(two, GB)) == {"f0"}
    assert files(retention.oldest_to_free(two, 9 * GB)) == {"f0", "f1"}


def test_oldest_to_free_with_ties_against_running_total(spark):
    import hashlib

    rng = random.Random(5)
    rows = [("h", 1, None, rng.randint(0, 50), rng.choice([7, 8, 10**12])) for _ in range(80)]
    df = manifest(spark, *rows)
    order = sorted(range(80), key=lambda i: (rows[i][4], hashlib.md5(f"f{i}".encode()).hexdigest()))
    for wanted in (1, 300, 900, 1500):
        expected, freed = set(), 0
        for i in order:
            if freed >= wanted:
                break
            expected.add(f"f{i}")
            freed += rows[i][3]
        assert files(retention.oldest_to_free(df, wanted)) == expected


def test_removal_plan(spark):
    df = manifest(spark, ("h", 1, None, 6 * GB, 1), ("h", 2, None, 6 * GB, 2))
    assert files(retention.removal_plan(df, 9 * GB, 7 * GB)) == {"f0"}
    assert files(retention.removal_plan(df, 9 * GB, 1 * GB)) == {"f0", "f1"}
    assert files(retention.removal_plan(df, 12 * GB, 1 * GB)) == set()


# Inference


def test_closure_with_cycle(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x")]
    found = {tuple(r) for r in inference.closure(local_table(spark, chain, struct("sub STRING, sup STRING"))).collect()}
    expected = {(f"c{i}", f"c{j}") for i in range(10) for j in range(i + 1, 10)} | {(a, b) for a in "xy" for b in "xy"}
    assert found == expected


def test_inherited_types(spark, quads):
    have = quads(
        ("Tiger", RDFS_SUBCLASS, "Cat", "t"), ("Cat", RDFS_SUBCLASS, "Mammal", "t"), ("Dog", RDFS_SUBCLASS, "Mammal", "t"),
        ("Terrier", RDFS_SUBCLASS, "Dog", "t"), ("Tigger", RDF_TYPE, "Tiger", "d"), ("Stevie", RDF_TYPE, "Terrier", "d"),
    )
    assert pt.pattern(have, "?t", pt.iri(RDF_TYPE), pt.iri("Dog"), "?g").count() == 0
    view = inference.with_inference(have)
    assert pt.pattern(view, "?t", pt.iri(RDF_TYPE), pt.iri("Dog"), "?g").first().t.value == "Stevie"
    mammals = pt.pattern(view, "?t", pt.iri(RDF_TYPE), pt.iri("Mammal"), "?g").collect()
    assert {r.t.value for r in mammals} == {"Stevie", "Tigger"}
    assert inference.inferred_types(have, with_thing=True).filter(F.col("o") == OWL_THING).count() == 2


# Workflow


def fold(log, users):
    """The plain reading of a log: one action after the other."""
    state, outcomes = {}, {}
    for r in sorted(log, key=lambda r: (r[0], r[1])):
        ds, seq, actor, action, target, permission = r[:6]
        s = state.get(ds)
        if action == "create":
            outcomes[ds, seq] = "exists" if s else "ok"
            state.setdefault(ds, {"owner": actor, "sub": None, "cu": None, "cp": None, "shares": set()})
            continue
        if s is None:
            outcomes[ds, seq] = "not-found"
        elif action == "claim":
            ok = s["owner"] == actor or (s["owner"] is None and s["sub"] == actor) or s["cu"] == actor or s["cp"] in users[actor]
            outcomes[ds, seq] = "ok" if ok else "forbidden"
            if ok:
                s.update(owner=actor, cu=None, cp=None)
        elif s["owner"] != actor:
            outcomes[ds, seq] = "ignored"
        else:
            outcomes[ds, seq] = "ok"
            if action.startswith("submit"):
                user = action == "submit_to_user"
                s.update(owner=None, sub=actor, cu=target if user else None, cp=None if user else permission)
            elif action == "unshare":
                s["shares"] = set()
            elif action.startswith("share"):
                s["shares"].add((target, None) if action == "share_with_user" else (None, permission))
    return state, outcomes


def test_replay_against_fold(spark):
    rng = random.Random(11)
    users = {f"u{i}": ([f"p{i % 2}"] if i > 1 else []) for i in range(4)}
    actions = ["submit_to_user", "submit_to_permission", "claim", "claim", "claim", "share_with_user", "share_with_permission", "unshare"]
    log = []
    for ds in ("a", "b", "c"):
        for seq in range(40 if ds != "a" else 120):
            action = "create" if seq in (3, 30) else rng.choice(actions)
            log.append((ds, seq, f"u{rng.randrange(4)}", action, f"u{rng.randrange(4)}", f"p{rng.randrange(2)}", None, None))
    people = spark.createDataFrame(list(users.items()), "user STRING, permissions ARRAY<STRING>")
    replayed = workflow.replay(local_table(spark, log, workflow.LOG), people)
    state, outcomes = fold(log, users)
    assert {(r.draftset, r.seq): r.outcome for r in replayed.collect()} == outcomes
    for r in workflow.current_state(replayed).collect():
        s = state[r.draftset]
        assert (r.owner, r.submitted_by, r.claim_user, r.claim_permission) == (s["owner"], s["sub"], s["cu"], s["cp"])
        assert {(u, None) for u in r.view_users} | {(None, p) for p in r.view_permissions} == s["shares"]


# Charts


def test_slices(spark):
    runs = [("x.y.appendTest_1k_10g_0pc", 1.0), ("x.y.appendTest_10k_10g_0pc", 3.0), ("x.y.dropTest_1k_1g_5p", 2.0), ("bad", 0.0)]
    results = spark.createDataFrame([(n, s, "s", "v1") for n, s in runs], "benchmark STRING, score DOUBLE, unit STRING, version STRING")
    parsed, bad = slices.parse_benchmarks(results)
    assert bad.count() == 1
    found = slices.slices(parsed).collect()
    assert [(r.x_axis, r.short_name, r.x, r.y) for r in found] == [("statements", "append", [1000, 10000], [1.0, 3.0])]


def test_quads_have_fixed_columns():
    assert QUAD_COLS == TABLES["live"].fieldNames()
