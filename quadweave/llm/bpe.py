"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.arrow import binaries, lists, mapped, sliced
from quadweave.llm.common import whole

#: Texts longer than this many characters are cut into pieces of about that many.
PIECE = 1 << 16
#: Ids that a task decodes at once.
SLICE_IDS = 1 << 20
#: No match of the pattern spans from a character that is not white space to one that is, and what
#: comes after such a place has no part in a match before it.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The encoding of a rank file, loaded once in each Python worker."""
    import tiktoken

    lines = (line.split() for line in Path(ranks).read_bytes().splitlines() if line.strip())
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(k): int(v) for k, v in lines}, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces whose tokens, end to end, are the tokens of the whole text."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str, ranks: str, pattern: str, size: int = PIECE) -> np.ndarray:
    encode = encoding(ranks, pattern).encode_ordinary
    if len(text) <= size:
        return np.array(encode(text), np.int32)
    return np.concatenate([np.array(encode(x), np.int32) for x in pieces(text, size)])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) for every row of ``docs``; a null or empty text has no ids.

    Special tokens' strings are ordinary text. Texts of any length are encoded whole, in pieces cut
    where no match of the pattern can span. Rows that repeat are encoded again; other columns of
    ``docs`` are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids = [encode_text(x, ranks, pattern) for x in batch["text"].to_pylist()]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists(flat, [len(x) for x in ids])], ["doc_id", "ids"])

    return mapped(slim, run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``encoded`` (doc_id, ids) with the raw bytes of the ids as ``decoded``; null ids decode to nothing.

    The bytes need not be UTF-8: a list of ids may end inside a character.
    """
    empty = F.array().cast("array<int>")
    slim = encoded.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids), empty).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoding(ranks, pattern).decode_bytes
        for batch in sliced(batches, "ids", SLICE_IDS):
            out = binaries([back(batch["ids"][i].values.to_numpy().tolist()) for i in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], out], ["doc_id", "ids", "decoded"])

    return mapped(slim, run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *extra: str) -> DataFrame:
    """doc_id, ``extra`` columns, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        *extra,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
