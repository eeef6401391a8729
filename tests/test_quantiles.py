"""The digest of weights against running totals."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quadweave.operators import quantiles, retention
from quadweave.schema import local_table, struct

FILES = struct("file STRING, hash STRING, livemod BIGINT, draftmod BIGINT, size_bytes BIGINT, last_access BIGINT")


def totals(keys, weights):
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    out, sum_ = [], 0
    for i in order:
        sum_ += weights[i]
        out.append((keys[i], sum_))
    return out


@pytest.mark.parametrize("rows,cells,lots", [(2000, 8, 5), (300, 64, 1), (5000, 4, 40), (50, 100, 7)])
def test_interval_holds_the_crossing_key(rows, cells, lots):
    rng = random.Random(rows)
    keys = [(rng.choice([3, 4, rng.randrange(1000)]), rng.randrange(50)) for _ in range(rows)]
    weights = [rng.choice([0, 1, 7, 500]) for _ in keys]
    parts = []
    for lot in range(lots):
        mine = range(lot, rows, lots)
        parts.append(quantiles.of_rows(*[np.array([x[i] for i in mine], np.int64) for x in ([k[0] for k in keys], [k[1] for k in keys], weights)], cells))
    while len(parts) > 1:
        some = [np.concatenate(x) for x in zip(*parts[:3])]
        parts = [*parts[3:], quantiles.merged(some, cells)]
    running = totals(keys, weights)
    whole = running[-1][1]
    assert int(parts[0][4].sum()) == whole and quantiles.interval(parts[0], whole + 1) is None
    for wanted in (1, whole // 7, whole // 2, whole):
        low, high = quantiles.interval(parts[0], wanted)
        crossing = next(k for k, total in running if total >= wanted)
        assert low < crossing <= high


def manifest(spark, n, seed):
    rng = random.Random(seed)
    rows = [(f"f{i}", "h", 1, None, rng.choice([None, 0, rng.randrange(1, 9000)]) if i % 9 else 5, None if i % 31 == 0 else rng.choice([7, rng.randrange(400)])) for i in range(n)]
    return rows, local_table(spark, rows, FILES)


@pytest.mark.parametrize("cells,lot,fan", [(1024, 1 << 20, 256), (4, 50, 2), (16, 7, 3)])
def test_oldest_files_against_a_running_total(spark, monkeypatch, cells, lot, fan):
    monkeypatch.setattr(quantiles.digest, "__defaults__", (cells, lot))
    monkeypatch.setattr(quantiles, "FAN", fan)
    rows, table = manifest(spark, 700, cells)
    known = sorted((r for r in rows if r[5] is not None), key=lambda r: (r[5], hashlib.md5(r[0].encode()).hexdigest()[:15]))
    whole = sum(r[4] or 0 for r in known)
    for wanted in (1, whole // 5, whole // 2, whole):
        want, freed = set(), 0
        for r in known:
            if freed >= wanted:
                break
            want.add(r[0])
            freed += r[4] or 0
        assert {r.file for r in retention.oldest_to_free(table.repartition(5), wanted).collect()} == want
    assert retention.oldest_to_free(table, whole + 1).count() == 700
    assert retention.oldest_to_free(table.limit(0), 5).count() == 0
