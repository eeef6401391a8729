from __future__ import annotations

import pytest

from support import shown
from quadweave.plans.workspace import DraftsetExists, DraftsetNotFound, NotOwner, StaleCommit, Workspace
from quadweave.session import release, stage
from quadweave.sources import sinks
from quadweave.streaming import ingest

A, B = ("s1", "p", "o", "g1"), ("s2", "p", "g1", "g2")


@pytest.fixture
def space(spark, tmp_path):
    ticks = iter(f"2024-05-01 10:{i:02d}:00" for i in range(60))
    return Workspace(spark, str(tmp_path / "space"), clock=lambda: next(ticks), buckets=8)


def test_life_of_a_draft(space, quads):
    first = space.create_draftset("ann", "One")
    space.append(first, quads(A, B))
    assert shown(space.view(first)) == {A, B} and shown(space.view()) == set()
    space.publish(first)
    assert shown(space.view()) == {A, B} and space.draftsets("ann").count() == 0
    second = space.create_draftset("bob")
    before = space.snapshot()
    space.delete(second, quads(B))
    assert shown(space.view(second)) == set() and shown(space.view(second, union_with_live=True)) == {A}
    assert shown(space.view()) == {A, B}
    space.copy_live_graph(second, "g2")
    space.append(second, quads(("s3", "p", "o", "any")), graph="g2")
    assert shown(space.quads(second, union_with_live=True)) == {A, B, ("s3", "p", "o", "g2")}
    assert space.quads(second, graph="g2").columns[0] == "s"
    space.delete_graph(second, "g1")
    assert space.revert_graph(second, "g2") == "reverted" and space.revert_graph(second, "g2") == "not-found"
    space.publish(second)
    assert shown(space.view()) == {B}
    assert before.draftsets.count() == 1, "readers of an earlier commit keep reading it"
    assert {r.graph for r in space.modification_times().collect()} == {"g1", "g2", space.vocab.modified_graph}
    assert space.endpoints().count() == 1


def test_writes_touch_only_their_buckets(space, quads):
    first = space.create_draftset("ann")
    space.append(first, quads(*[("s", "p", "o", f"g{i}") for i in range(20)]))
    space.publish(first)
    before = space._manifest()["live"]
    second = space.create_draftset("ann")
    space.append(second, quads(("t", "p", "o", "g3")))
    assert space._manifest()["live"] == before
    space.publish(second)
    after = space._manifest()["live"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert space.view().count() == 21


def test_workflow_actions(space):
    ds = space.create_draftset("ann", "T")
    assert space.submit_to_user(ds, "bob", "eve") == "ignored"
    assert space.share_with_user(ds, "ann", "eve") == "ok"
    assert space.draftsets("eve").count() == 1 and space.draftsets("eve", include="claimable").count() == 0
    assert space.unshare(ds, "ann") == "ok" and space.draftsets("eve").count() == 0
    assert space.submit_to_permission(ds, "ann", "x:claim") == "ok"
    assert space.claim(ds, "eve") == "forbidden" and space.claim("nope", "eve") == "not-found"
    assert space.draftsets("eve", ["x:claim"], "claimable").count() == 1
    assert space.claim(ds, "eve", ["x:claim"]) == "ok"
    assert space.draftsets("eve", include="owned").first().submitted_by == "ann"
    space.set_metadata(ds, description="D")
    found = space.draftsets("eve", include="owned").first()
    assert (found.title, found.description) == ("T", "D")
    space.delete_draftset(ds)
    assert space.draftsets("eve").count() == 0


def test_failed_batch_keeps_finished_ones_and_replay_changes_nothing(space, spark, quads, tmp_path):
    """A batch that fails leaves the earlier ones in place; running again completes without duplicates."""
    ds = space.create_draftset("ann")
    rows = [(f"s{i}", "p", "o", "g1") for i in range(12)]
    sinks.quad_lines(quads(*rows)).repartition(3).write.text(str(tmp_path / "in"))
    lines = ingest.read_line_stream(spark, str(tmp_path / "in"), 1)

    def fragile(batch, batch_id):
        space.append(ds, batch)
        if batch_id == 1 and not (tmp_path / "again").exists():
            raise RuntimeError("lost after the write, before the checkpoint")

    with pytest.raises(Exception, match="lost after the write"):
        ingest.run(lines, fragile, str(tmp_path / "cp"), once=True).awaitTermination()
    kept = space.view(ds).count()
    assert 0 < kept < 12
    (tmp_path / "again").touch()
    ingest.run(lines, fragile, str(tmp_path / "cp"), once=True).awaitTermination()
    assert shown(space.view(ds)) == set(rows)


def test_ledger_applies_batches_together_once(space, spark, quads, tmp_path):
    ds = space.create_draftset("ann")
    written = []

    def write(found):
        if found.filter("s = 'bad'").count():
            raise RuntimeError("refused")
        written.append(found.count())
        space.append(ds, found)

    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"), write, 2)
    batches = [quads((f"s{i}", "p", "o", "g"), (f"t{i}", "p", "o", "g")) for i in range(5)]
    for i, batch in enumerate(batches[:4]):
        ledger.take(batch, i)
    assert written == [4, 4] and ledger.applied() == 3 and ledger.pending() == []
    ledger.take(batches[0], 3)  # a replayed batch is skipped
    ledger.take(quads(("bad", "p", "o", "g")), 4)
    with pytest.raises(RuntimeError):
        ledger.flush()
    assert ledger.pending() == [4] and space.view(ds).count() == 8
    again = ingest.Ledger(spark, str(tmp_path / "ledger"), write, None)  # a restart; the batch runs again and replaces itself
    again.take(batches[4], 4)
    assert again.flush() == 1 and again.flush() == 0 and space.view(ds).count() == 10


def test_streams_restart_where_they_failed(space, spark, quads, tmp_path):
    ds = space.create_draftset("ann")
    rows = [(f"s{i}", "p", "o", "g1") for i in range(12)]
    lines = sinks.quad_lines(quads(*rows))
    lines.repartition(3).write.text(str(tmp_path / "in"))
    commits = space.latest()
    stream = lambda: ingest.read_line_stream(spark, str(tmp_path / "in"), 1)
    ingest.append_stream(stream(), space, ds, str(tmp_path / "cp"), once=True).awaitTermination()
    assert shown(space.view(ds)) == set(rows) and space.latest() == commits + 1
    sinks.quad_lines(quads(("new", "p", "o", "g2"))).write.mode("append").text(str(tmp_path / "in"))
    ingest.append_stream(stream(), space, ds, str(tmp_path / "cp"), once=True).awaitTermination()
    assert shown(space.view(ds)) == {*rows, ("new", "p", "o", "g2")} and space.latest() == commits + 2
    ingest.delete_stream(stream(), space, ds, str(tmp_path / "cp2"), every=2, once=True).awaitTermination()
    assert space.view(ds).count() == 0


def test_unknown_draftsets_and_other_owners_are_refused(space, quads):
    ds = space.create_draftset("ann", id="one")
    with pytest.raises(DraftsetExists):
        space.create_draftset("bob", id="one")
    start = space.latest()
    verbs = [
        lambda d, u: space.append(d, quads(A), user=u),
        lambda d, u: space.delete(d, quads(A), user=u),
        lambda d, u: space.delete_graph(d, "g1", silent=True, user=u),
        lambda d, u: space.copy_live_graph(d, "g1", user=u),
        lambda d, u: space.revert_graph(d, "g1", user=u),
        lambda d, u: space.set_metadata(d, "x", user=u),
        lambda d, u: space.publish(d, user=u),
        lambda d, u: space.delete_draftset(d, user=u),
    ]
    for verb in verbs:
        with pytest.raises(DraftsetNotFound):
            verb("no-such-draftset", None)
        with pytest.raises(NotOwner):
            verb(ds, "bob")
    assert space.latest() == start
    space.append(ds, quads(A), user="ann")
    assert shown(space.view(ds)) == {A}


def test_no_write_is_lost(space, spark, quads):
    """Of two writers from one commit, the second joins the first's commit or fails."""
    ds = space.create_draftset("ann", id="mine")
    space.append(ds, quads(*[("s", "p", "o", f"g{i}") for i in range(8)]))
    space.publish(ds)
    other = Workspace(spark, space.root, clock=space.clock, buckets=8)
    stale = space.snapshot()
    other.create_draftset("bob", id="theirs")
    with pytest.raises(StaleCommit):
        space.commit(stale, stale.but(draftsets=stale.draftsets.limit(0)))
    assert {r.draftset for r in space.snapshot().draftsets.collect()} == {"theirs"}
    # Other tables: both changes are there.
    stale = space.snapshot()
    other.create_draftset("bob", id="third")
    space.commit(stale, stale.but(shares=spark.createDataFrame([("theirs", "eve", None)], stale.shares.schema)))
    now = space.snapshot()
    assert {r.draftset for r in now.draftsets.collect()} == {"theirs", "third"} and now.shares.count() == 1
    # Other buckets of the same table join, the same bucket does not.
    by_bucket = {}
    for i in range(8):
        by_bucket.setdefault(next(iter(space._buckets_for(space._one(f"g{i}"), 8))), f"g{i}")
    first, second = list(by_bucket.values())[:2]
    for mine, theirs, fails in ((first, second, False), (first, first, True)):
        graph = space._one(mine)
        stale = space.snapshot(live=graph)
        later = other.snapshot(live=space._one(theirs))
        other.commit(later, later.but(live=later.live.unionByName(quads(("new", "p", "o", theirs)))), live=space._one(theirs))
        change = stale.but(live=stale.live.unionByName(quads(("newer", "p", "o", mine))))
        if fails:
            with pytest.raises(StaleCommit):
                space.commit(stale, change, live=graph)
        else:
            space.commit(stale, change, live=graph)
            assert {("new", "p", "o", theirs), ("newer", "p", "o", mine)} <= shown(space.view())


def test_old_commits_expire_and_buckets_follow_the_rows(space, spark, quads):
    ds = space.create_draftset("ann")
    space.append(ds, quads(*[("s", "p", "o", f"g{i}") for i in range(9)]))
    space.append(ds, quads(("t", "p", "o", "g1")))
    shown_before, count = shown(space.view(ds)), len(space.commits())
    assert space.expire() == count - 1 and len(space.commits()) == 1 and space.expire() == 0
    assert shown(space.view(ds)) == shown_before
    space.rebucket()
    assert space._bucket_count(space._manifest(), "draft") == 16
    space.append(ds, quads(("u", "p", "o", "g2")))
    assert shown(space.view(ds)) == shown_before | {("u", "p", "o", "g2")}


def test_staged_folders_are_released(spark):
    release(spark)
    kept = stage(spark.range(5))
    assert kept.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        kept.count()
