"""A mergeable digest of weights over ordered keys: where a running total falls, from one pass.

A cell (low, high, weight) says that rows of this weight have keys above ``low`` and up to ``high``. A lot of
rows becomes at most ``CELLS`` cells of about equal weight, exact at their edges; digests merge by
joining neighbouring cells. The total up to any key is then known between two bounds, so the key at
which it reaches a wanted amount lies in an interval that holds about a ``CELLS``-th of all weight, and
only rows inside it have to be looked at. Digests are merged in groups of ``FAN``, so no task and
not the driver holds more than that many.

Keys are pairs of longs in their order, as one text cannot be: (time, rank of a name).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.session import send_package, stage

#: Cells of a digest, rows of a lot, digests merged in one group.
CELLS, LOT, FAN = 1024, 1 << 20, 256
Key = tuple[int, int]
LEAST: Key = (-(1 << 63), -(1 << 63))
_NAMES = ["lot", "low0", "low1", "high0", "high1", "weight"]
_FIELDS = ", ".join(f"{n} long" for n in _NAMES)

Cells = list[np.ndarray]


def _cut(weights: np.ndarray, cells: int) -> np.ndarray:
    """First index of each stretch, of about equal weight, in a row of weights."""
    ends = np.cumsum(weights, dtype=np.float64)
    place = np.floor((ends - weights / 2) * cells / max(ends[-1], 1.0)).astype(np.int64)
    return np.flatnonzero(np.append(True, place[1:] != place[:-1]))


def of_rows(first: np.ndarray, second: np.ndarray, weight: np.ndarray, cells: int = CELLS) -> Cells:
    """The digest of rows: low0, low1, high0, high1 and weight of each cell. Equal keys are in one cell."""
    order = np.lexsort((second, first))
    first, second, weight = first[order], second[order], weight[order]
    fresh = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    first, second, weight = first[fresh], second[fresh], np.add.reduceat(weight, fresh)
    starts = _cut(weight, cells)
    last = np.append(starts[1:], len(weight)) - 1
    low = [np.append(least, x[last[:-1]]) for least, x in zip(LEAST, (first, second))]
    return [*low, first[last], second[last], np.add.reduceat(weight, starts)]


def merged(digests: Cells, cells: int = CELLS) -> Cells:
    """Cells of several digests as at most about ``cells``; neighbours by their upper end are joined."""
    low0, low1, high0, high1, weight = digests
    order = np.lexsort((high1, high0))
    low0, low1, high0, high1, weight = (x[order] for x in (low0, low1, high0, high1, weight))
    if len(weight) <= cells:
        return [low0, low1, high0, high1, weight]
    starts = _cut(weight, cells)
    ends = np.append(starts[1:], len(weight))
    least = [a + int(np.lexsort((low1[a:b], low0[a:b]))[0]) for a, b in zip(starts.tolist(), ends.tolist())]
    return [low0[least], low1[least], high0[ends - 1], high1[ends - 1], np.add.reduceat(weight, starts)]


def _batch(lot: int, cells: Cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), lot, np.int64)), *map(pa.array, cells)], _NAMES)


def digest(df: DataFrame, first: Column, second: Column, weight: Column, cells: int = CELLS, lot: int = LOT) -> Cells:
    """The digest of a table in one pass over it; rows with a null key are left out, a null weight is none."""
    send_package(df.sparkSession)
    slim = df.select(first.cast("long").alias("a"), second.cast("long").alias("b"), F.coalesce(weight, F.lit(0)).cast("long").alias("w"))
    slim = slim.filter("a is not null and b is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            return _batch(0, of_rows(*[np.concatenate([b[i].to_numpy() for b in held]) for i in range(3)], cells))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= lot:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    def join(key: tuple, given: pa.Table) -> pa.Table:
        parts = [given[n].to_numpy() for n in _NAMES[1:]]
        return pa.Table.from_batches([_batch(0, merged(parts, cells))])

    found = stage(slim.mapInArrow(run, _FIELDS))
    while (size := found.count()) > FAN * cells:
        groups = -(-size // (FAN * cells))
        found = stage(found.groupBy(F.pmod(F.xxhash64("high0", "high1", "weight"), F.lit(groups))).applyInArrow(join, _FIELDS))
    rows = found.select(*_NAMES[1:]).collect()  # at most FAN * CELLS cells
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return merged(columns, cells * FAN) if rows else columns


def interval(cells: Cells, wanted: int) -> tuple[Key, Key] | None:
    """(low, high]: keys among which the running total reaches ``wanted``; None if it never does."""
    low0, low1, high0, high1, weight = cells
    if not len(weight) or int(weight.sum()) < wanted:
        return None
    by_high = np.lexsort((high1, high0))
    high = by_high[int(np.searchsorted(np.cumsum(weight[by_high]), wanted))]
    # Everything up to a key weighs at most all cells that begin below it.
    by_low = np.lexsort((low1, low0))
    begins = list(zip(low0[by_low].tolist(), low1[by_low].tolist()))
    before = np.cumsum(weight[by_low]) - weight[by_low]
    low = LEAST
    for i, key in enumerate(begins):
        if (i == 0 or key != begins[i - 1]) and before[i] < wanted:
            low = key
    return low, (int(high0[high]), int(high1[high]))


def beyond(first: Column, second: Column, key: Key) -> Column:
    """Is (first, second) above the key?"""
    return (first > F.lit(key[0])) | ((first == F.lit(key[0])) & (second > F.lit(key[1])))
