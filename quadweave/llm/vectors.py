"""Integer vectors: components of embeddings scaled and floored, packed in blocks of rows for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component; one that would be larger stays at it.
LIMIT = 1 << 50
#: Up to this size of components, squared distances and inner products are computed in 64 bits.
NARROW = 1 << 24
LONGEST = (1 << 63) - 1


def quantised(table: DataFrame, scale: int = 256, vector: str = "embedding", own: str = "vec_id", size: int | None = None) -> DataFrame:
    """(vec_id, q): floor(scale * x) of the components of vectors that are whole.

    A null vector, and one with a null, infinite or NaN component, is left out, as is one without
    exactly ``size`` components where that is given.
    """
    q = F.col(vector)
    real = F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.filter(q.isNotNull() & real & (F.lit(True) if size is None else F.size(q) == size))
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    return kept.select(F.col(own).alias("vec_id"), F.transform(q, lambda x: held(x).cast("long")).alias("q"))


def pieces(batch: pa.RecordBatch, rows: int, elements: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and elements of ``q``, or of one row."""
    ends = np.cumsum(pc.list_value_length(batch["q"]).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, done + elements, side="right"))), at + rows)
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def packed(values: np.ndarray) -> bytes:
    """Signed integers in the narrowest of 16, 32 and 64 bits."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(data) // count if count else 0, np.int64)
    return np.frombuffer(data, kind).astype(np.int64)


def exact(*values: np.ndarray) -> list[np.ndarray]:
    """The arrays, as Python's integers where 64 bits could overflow."""
    if all(np.abs(v).max(initial=0) <= NARROW for v in values):
        return list(values)
    return [v.astype(object) for v in values]


def as_long(values: np.ndarray) -> np.ndarray:
    """Integers of any size as 64 bits; what does not fit becomes the nearest that does."""
    return values if values.dtype == np.int64 else np.clip(values, -LONGEST - 1, LONGEST).astype(np.int64)
