"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import quadweave

Batches = Iterator[pa.RecordBatch]

#: Bytes of text that a task holds decoded at once.
SLICE_BYTES = 8 << 20


def send_package(spark: SparkSession) -> None:
    """Send this package, once a context, to executors that may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quadweave_sent", False):
        return
    root = Path(quadweave.__file__).parent
    package = Path(tempfile.mkdtemp(prefix="quadweave-code-")) / "quadweave.zip"
    with zipfile.ZipFile(package, "w") as made:
        for file in sorted(root.rglob("*.py")):
            made.write(file, file.relative_to(root.parent))
    context.addPyFile(str(package))
    context._quadweave_sent = True


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow``, with this package on every executor."""
    send_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes (list elements) of ``column``, or of one row."""
    for batch in batches:
        values = batch[column]
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        ends = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def lists(flat: np.ndarray, lengths: np.ndarray | list[int]) -> pa.ListArray:
    """A list array from its values end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
