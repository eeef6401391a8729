"""Differences by digests against sets."""

from __future__ import annotations

import random

import pytest

from quadweave.operators import compare, lookup
from support import shown


def made(seed, n, graphs):
    rng = random.Random(seed)
    return {(f"s{rng.randrange(40)}", "p", rng.choice(["o", "'o", "_:o", f"x{rng.randrange(9)}"]), "hot" if rng.random() < 0.5 else f"g{rng.randrange(graphs)}") for _ in range(n)}


@pytest.mark.parametrize("ranges", [1, 7, 256])
@pytest.mark.parametrize("few", [0, 200])
def test_gaps_are_those_of_sets(quads, monkeypatch, ranges, few):
    monkeypatch.setattr(lookup, "PUSHDOWN_KEYS", few)
    a = made(1, 400, 12)
    b = (a - set(sorted(a)[:9])) | made(2, 12, 15)
    left, right = quads(*a), quads(*b)
    found = compare.gaps(left, right, ranges).cache()
    plain = lambda rows: {t for t in rows}
    assert shown_sides(found, 1) == plain(a - b) and shown_sides(found, -1) == plain(b - a)
    assert shown(compare.minus(left, right, ranges)) == shown(lookup.minus(left, right))
    found.unpersist()


def shown_sides(found, side):
    return {(r.s, r.p, ("'" if r.o_kind == "literal" else "") + r.o, r.g) for r in found.filter(f"side = {side}").collect()}


def test_equal_sets_differ_nowhere(quads):
    a = sorted(made(3, 300, 5))
    left, right = quads(*a), quads(*reversed(a))
    assert compare.unequal(left, right, "g").count() == 0
    assert compare.gaps(left, right).count() == 0 and compare.gaps(quads(), quads()).count() == 0
    assert compare.gaps(left, quads()).count() == len(a)


def test_only_unequal_parts_are_compared(quads):
    a = made(4, 300, 5)
    one = next(t for t in sorted(a) if t[3] == "hot")
    changed = quads(*(a - {one}))
    left = quads(*a).withColumn("_range", compare._range(64))
    parts = compare.unequal(left, changed.withColumn("_range", compare._range(64)), "g", "_range").collect()
    assert [(r.g) for r in parts] == ["hot"]
