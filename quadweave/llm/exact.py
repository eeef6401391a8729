"""Exact de-duplication by a tree merge of sorted digest runs that partitions exchange.

An entry is a text's digest and byte length with the identifier that stays and the number of rows.
Every partition of the input sorts its entries into a run with one entry per text. Runs have numbers, and
in each round those whose numbers differ in a few bits only exchange pieces: a run is cut where
these bits of the digest change, and each of the runs takes its own piece from all. A piece is still
sorted, so a task merges the pieces of its run multiway, and entries whose digest and length both
agree become one with the extreme identifier. With one bit a round this is a binomial exchange
between pairs; ``bits`` let 2 ** bits runs meet in one round. After log2(runs) / bits rounds a run holds all
entries of its range of digests. Every task holds one run of bounded length, and a text that a third
of all rows share is one entry per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.arrow import Batches, mapped
from quadweave.llm.common import lower_ascii, pick_rows, whole
from quadweave.session import stage

#: Entries of a sorted run at its start, entries wanted in a run after a round, and bits exchanged in one.
START, RUN_ROWS, BITS = 1 << 18, 1 << 19, 3
#: A key is the digest and the length, 32 and 8 bytes.
_KEY = np.dtype("S40")
_PIECE = "run long, keys binary, ids binary, counts binary"


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, in lower-case hex."""
    return F.sha2(lower_ascii(whole(text)), 256)


class Run:
    """Sorted entries: keys, identifiers (the worst possible number for none), and counts of rows."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.ids, self.counts = keys, ids, counts

    @classmethod
    def of(cls, piece: dict) -> Run:
        return cls(np.frombuffer(piece["keys"], _KEY), np.frombuffer(piece["ids"], np.int64), np.frombuffer(piece["counts"], np.int64))

    def merge(self, other: Run) -> Run:
        """Both runs in order; every entry goes behind those of the other run that are less."""
        size = len(self.keys) + len(other.keys)
        mine = np.arange(len(self.keys)) + np.searchsorted(other.keys, self.keys, side="left")
        theirs = np.arange(len(other.keys)) + np.searchsorted(self.keys, other.keys, side="right")
        out = Run(np.empty(size, _KEY), np.empty(size, np.int64), np.empty(size, np.int64))
        for at, run in ((mine, self), (theirs, other)):
            out.keys[at], out.ids[at], out.counts[at] = run.keys, run.ids, run.counts
        return out

    def folded(self, largest: bool) -> Run:
        """One entry per key, with the extreme identifier."""
        if not len(self.keys):
            return self
        starts = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1]))
        best = np.maximum if largest else np.minimum
        return Run(self.keys[starts], best.reduceat(self.ids, starts), np.add.reduceat(self.counts, starts))

    def pieces(self, shift: int, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(value of the digest's ``bits`` above ``shift`` of its first 32, keys, ids, counts) of each stretch."""
        if not len(self.keys):
            return
        part = prefixes(self.keys) >> np.uint64(shift) & np.uint64((1 << bits) - 1)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for start, end in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist()):
            yield int(part[start]), self.keys[start:end].tobytes(), self.ids[start:end].tobytes(), self.counts[start:end].tobytes()


def prefixes(keys: np.ndarray) -> np.ndarray:
    """The first 32 bits of the digests."""
    raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), _KEY.itemsize)
    return np.ascontiguousarray(raw[:, :4]).view(">u4").reshape(-1).astype(np.uint64)


def multiway(runs: list[Run], largest: bool) -> Run:
    """Runs merged two by two, equal entries joined at every level."""
    while len(runs) > 1:
        runs = [runs[i].merge(runs[i + 1]).folded(largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0].folded(largest)


def _plan(runs: int, bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of each round: how far from the end of the digest's first 32 bits, and how many."""
    left, done, out = runs.bit_length() - 1, 0, []
    while done < left:
        now = min(bits, left - done)
        done += now
        out.append((32 - done, now))
    return out


def _sent(number: int, run: Run, runs: int, shift: int, bits: int) -> pa.RecordBatch:
    """The pieces of a run under the numbers of the runs that take them: its own but for the bits of this round."""
    low = shift - (32 - (runs.bit_length() - 1))
    keep = number & ~(((1 << bits) - 1) << low)
    found = list(run.pieces(shift, bits))
    columns = [pa.array([keep | part << low for part, *_ in found], pa.int64())]
    columns += [pa.array([x[i] for x in found], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays(columns, ["run", "keys", "ids", "counts"])


def _first_runs(runs: int, shift: int, bits: int, largest: bool, none: int) -> object:
    def run(batches: Batches) -> Batches:
        part, done = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            data = pa.Table.from_batches(held)
            raw = np.empty((data.num_rows, _KEY.itemsize), np.uint8)
            raw[:, :32] = np.frombuffer(b"".join(data["digest"].to_pylist()), np.uint8).reshape(-1, 32)
            raw[:, 32:] = data["n_bytes"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            keys = raw.reshape(-1).view(_KEY)
            ids = data["doc_id"].fill_null(none).to_numpy().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            own = Run(keys[order], ids[order], np.ones(len(keys), np.int64)).folded(largest)
            return _sent((part * 0x9E3779B1 + done) % runs, own, runs, shift, bits)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= START:
                yield flush()
                held, rows, done = [], 0, done + 1
        if rows:
            yield flush()

    return run


def _merging(answer) -> object:
    """Rows sorted by run: ``answer`` for each run's number and pieces."""

    def run(batches: Batches) -> Batches:
        number, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch["run"][i].as_py()
                if held and now != number:
                    yield answer(number, held)
                    held = []
                number = now
                held.append(Run.of({c: batch[c][i].as_buffer() for c in ("keys", "ids", "counts")}))
        if held:
            yield answer(number, held)

    return run


def merge_runs(entries: DataFrame, largest: bool = True, runs: int | None = None, bits: int = BITS) -> DataFrame:
    """(digest, n_bytes, doc_id) rows to one (digest, n_bytes, keep_id, group_size) per text.

    Identifiers are integers; a null one stays only in a group that has no other. ``runs`` is a
    power of two; if none is given, one that lets a run have about ``RUN_ROWS`` entries.
    """
    spark = entries.sparkSession
    if runs is None:
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RUN_ROWS))
        runs = 1 << min(30, (wanted - 1).bit_length())
    if runs < 1 or runs & (runs - 1):
        raise ValueError("the number of runs is a power of two")
    if entries.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("identifiers are integers")
    none = -(1 << 63) if largest else (1 << 63) - 1
    rounds = _plan(runs, bits) or [(32, 0)]
    slim = entries.select(F.unhex("digest").alias("digest"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("doc_id").cast("long").alias("doc_id"))
    level = mapped(slim, _first_runs(runs, *rounds[0], largest, none), _PIECE)

    def exchange(shift: int, width: int):
        return _merging(lambda number, held: _sent(number, multiway(held, largest), runs, shift, width))

    for shift, width in rounds[1:]:
        level = mapped(level.repartition(runs, "run").sortWithinPartitions("run"), exchange(shift, width), _PIECE)

    def last(number: int, held: list[Run]) -> pa.RecordBatch:
        own = multiway(held, largest)
        raw = np.frombuffer(own.keys.tobytes(), np.uint8).reshape(-1, _KEY.itemsize)
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :32]))]).cast(pa.binary())
        lengths = np.ascontiguousarray(raw[:, 32:]).view(">i8").reshape(-1).astype(np.int64)
        ids = pa.array(own.ids, mask=own.ids == none)
        return pa.RecordBatch.from_arrays([digests, pa.array(lengths), ids, pa.array(own.counts)], ["digest", "n_bytes", "keep_id", "group_size"])

    merged = mapped(level.repartition(runs, "run").sortWithinPartitions("run"), _merging(last), "digest binary, n_bytes long, keep_id long, group_size long")
    kind = entries.schema["doc_id"].dataType
    return stage(merged.select(F.lower(F.hex("digest")).alias("digest"), "n_bytes", F.col("keep_id").cast(kind).alias("keep_id"), "group_size"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest identifier stays (the
    smallest with ``largest=False``); rows that repeat text and identifier are one group, and exactly
    one of them stays. Other columns of ``docs`` are not read.
    """
    hashed = docs.select(
        F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.octet_length(whole(text)).alias("n_bytes")
    )
    winners = merge_runs(hashed, largest).select(
        F.col("digest").alias("_d"), F.col("n_bytes").alias("_n"), "keep_id", "group_size"
    )
    joined = hashed.join(winners, (F.col("digest") == F.col("_d")) & (F.col("n_bytes") == F.col("_n")))
    again = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select(
        "doc_id", "keep_id", "group_size", (kept & (again == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat text and identifier one stays, whatever their other columns hold.
    """
    kept = dedup(docs, text, doc_id, largest).filter("kept")
    return pick_rows(docs, kept, [F.col(doc_id), digest(F.col(text))], ["doc_id", "text_sha256"]).select("row.*")
