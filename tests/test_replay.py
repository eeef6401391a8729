"""Replay of long logs against a plain walk, whatever the stretches and blocks."""

from __future__ import annotations

import random

import pytest

from quadweave.operators import replay, workflow
from quadweave.schema import local_table

ACTIONS = ["submit_to_user", "submit_to_permission", "claim", "claim", "claim", "share_with_user", "unshare", "create"]


def plain(log, users):
    owners, out = {}, {}
    for ds, seq, actor, action, target, permission, *_ in sorted(log, key=lambda r: (r[0], r[1])):
        s = owners.get(ds)
        if action == "create":
            out[ds, seq] = "exists" if s else "ok"
            owners.setdefault(ds, ["own", actor])
        elif s is None:
            out[ds, seq] = "not-found"
        elif action == "claim":
            mine = s[0] == "own" and s[1] == actor and actor is not None
            free = s[0] == "sub" and actor is not None and (actor in s[1:3] or s[3] is not None and s[3] in users.get(actor, []))
            out[ds, seq] = "ok" if mine or free else "forbidden"
            if free:
                owners[ds] = ["own", actor]
        elif s[0] != "own" or s[1] != actor or actor is None:
            out[ds, seq] = "ignored"
        else:
            out[ds, seq] = "ok"
            if action == "submit_to_user":
                owners[ds] = ["sub", actor, target, None]
            elif action == "submit_to_permission":
                owners[ds] = ["sub", actor, None, permission]
    return out


def made(rows, draftsets, people, seed):
    """A log in which a draftset has most of the actions."""
    rng = random.Random(seed)
    names = [f"u{i}" for i in range(people)]
    users = {n: [f"p{i % 3}"] if i % 2 else ["p0", "p1"] for i, n in enumerate(names)}
    log = []
    for i in range(rows):
        ds = "hot" if rng.random() < 0.6 else f"ds{rng.randrange(draftsets)}"
        actor = None if rng.random() < 0.01 else rng.choice(names)
        log.append((ds, 7 * i + rng.randrange(7), actor, rng.choice(ACTIONS), rng.choice([*names, None]), f"p{rng.randrange(4)}", None, None))
    return log, users


@pytest.fixture
def cut(spark):
    """Sessions in which ranges stay as many as asked for."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rows,draftsets,people,parts,fan", [(100_000, 40, 30, 6, 256), (900, 5, 4, 13, 2), (300, 2, 3, 17, 3), (40, 30, 2, 5, 2)])
def test_outcomes_are_those_of_a_walk(spark, cut, rows, draftsets, people, parts, fan):
    log, users = made(rows, draftsets, people, rows)
    cut(parts)
    people = spark.createDataFrame(list(users.items()), "user STRING, permissions ARRAY<STRING>")
    got = replay.outcomes(local_table(spark, log, workflow.LOG), people, fan)
    assert got.columns == [*workflow.LOG.fieldNames(), "outcome"]
    assert {(r.draftset, r.seq): r.outcome for r in got.collect()} == plain(log, users)
    assert got.count() == rows


def test_outcomes_of_nothing(spark):
    people = spark.createDataFrame([("u", ["p"])], "user STRING, permissions ARRAY<STRING>")
    assert replay.outcomes(local_table(spark, [], workflow.LOG), people).collect() == []


def test_stretches_compose_in_any_grouping():
    log, users = made(400, 1, 5, 3)
    log = [r for r in log if r[0] == "hot"]

    def function(rows):
        made_ = replay.Composed()
        for at, (_, _, actor, action, target, permission, *_) in enumerate(rows):
            made_.act(at, replay.answers(action, actor, users.get(actor)), replay.after(action, actor, target, permission))
        return {k: (at, state) for k, at, state in made_.entries()}

    whole = function(log)
    cuts = [0, 17, 18, 90, 200, len(log)]
    parts = [function(log[a:b]) for a, b in zip(cuts, cuts[1:])]
    left = replay.composed([replay.composed(parts[:3]), replay.composed(parts[3:])])
    right = replay.composed([parts[0], replay.composed(parts[1:])])
    states = {k: v[1] for k, v in whole.items()}
    assert {k: v[1] for k, v in left.items()} == {k: v[1] for k, v in right.items()} == states
    assert replay.applied(None, left) == replay.applied(None, whole)
