"""Token ids in wavelet-matrix shards: one succinct record per shard, with access, counting and lookup.

A shard's ids are kept as bit-planes, highest bit first; each plane is in the order that a stable
partition by the planes above gives. Counts of ones before every 512 bits let a plane answer rank, and
by search select, from its packed bits. Shards are rows of a Parquet folder written by Spark itself, so
that any storage Spark reads will do: the matrix in one binary column, the documents' identifiers and
lengths beside it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadweave.llm.arrow import binaries, lists, mapped, sliced
from quadweave.llm.common import running, whole

#: Tokens in a shard; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Bits between two entries of a plane's rank directory.
BLOCK = 512
#: Words a task remembers with their ids, and words encoded in one call.
MEMO, TOGETHER = 800_000, 2_000
# Characters that end the word before them, if that is a letter or a digit.
_ENDING = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER_END = re.compile("[A-Za-z0-9À-ÖØ-öø-ɏ]$")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


class Matrix:
    """A sequence of ids as packed bit-planes with rank directories."""

    def __init__(self, size: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray) -> None:
        self.size, self.planes, self.ranks, self.zeros = size, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> Matrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = np.asarray(ids).astype(np.uint16 if depth <= 16 else np.uint32)
        blocks = len(ids) // BLOCK + 1
        planes = np.zeros((depth, blocks * BLOCK // 8), np.uint8)
        zeros = np.zeros(depth, np.int64)
        for level in range(depth):
            bit = (ids & ids.dtype.type(1 << (depth - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            low = ids[~bit]
            zeros[level] = len(low)
            ids = np.concatenate([low, ids[bit]])
        ones = np.bitwise_count(planes.view(np.uint64)).reshape(depth, blocks, -1).sum(axis=2, dtype=np.int64)
        ranks = np.zeros((depth, blocks), np.uint32)
        ranks[:, 1:] = np.cumsum(ones, axis=1)[:, :-1]
        return cls(int(zeros[0] + (np.bitwise_count(planes[0]).sum(dtype=np.int64))), planes, ranks, zeros)

    def to_bytes(self) -> bytes:
        head = np.array([self.size, *self.planes.shape], np.int64)
        return b"".join(x.tobytes() for x in (head, self.zeros, self.ranks, self.planes))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Matrix:
        size, depth, width = np.frombuffer(blob, np.int64, 3).tolist()
        zeros = np.frombuffer(blob, np.int64, depth, 24)
        blocks = width * 8 // BLOCK
        ranks = np.frombuffer(blob, np.uint32, depth * blocks, 24 + 8 * depth).reshape(depth, blocks)
        planes = np.frombuffer(blob, np.uint8, depth * width, 24 + 8 * depth + 4 * depth * blocks).reshape(depth, width)
        return cls(size, planes, ranks, zeros)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        at = np.asarray(at, np.int64)
        words = self.planes[level].view(np.uint64)
        block = at // BLOCK
        counts = self.ranks[level][block].astype(np.int64)
        word, rest = at // 64, (at % 64).astype(np.uint64)
        for step in range(BLOCK // 64):
            inside = block * (BLOCK // 64) + step
            full = inside < word
            counts += np.where(full, np.bitwise_count(words[np.where(full, inside, 0)]), 0)
        last = np.where(rest > 0, words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << rest) - np.uint64(1)), np.uint64(0))
        return counts + np.bitwise_count(last)

    def bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(len(self.zeros)):
            bit = self.bit(level, at).astype(bool)
            ones = self.rank(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def all(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        depth = len(self.zeros)
        ids = np.zeros(self.size, np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            back = np.empty_like(ids)
            zeros = int(self.zeros[level])
            back[~bit] = ids[:zeros]
            back[bit] = ids[zeros:] | ids.dtype.type(1 << (depth - 1 - level))
            ids = back
        return ids.astype(np.uint32)

    def _range(self, token: int) -> tuple[int, int]:
        """The token's run below the last plane."""
        depth = len(self.zeros)
        if token < 0 or token >> depth:
            return 0, 0
        low, high = 0, self.size
        for level in range(depth):
            a, b = self.rank(level, np.array([low, high])).tolist()
            zeros = int(self.zeros[level])
            low, high = (zeros + a, zeros + b) if token >> (depth - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int) -> int:
        low, high = self._range(token)
        return high - low

    def _select(self, level: int, which: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the which-th (from 0) one or zero of a plane, by search among the ranks."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.size, np.int64)
        while np.any(low < high):
            middle = (low + high) // 2
            before = self.rank(level, middle + 1)
            before = before if ones else middle + 1 - before
            short = (before <= which) & (low < high)
            low, high = np.where(short, middle + 1, low), np.where(short, high, np.where(low < high, middle, high))
        return low

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, from below upwards."""
        low, high = self._range(token)
        at = np.arange(low, high, dtype=np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(token >> (len(self.zeros) - 1 - level) & 1)
            at = self._select(level, at - (int(self.zeros[level]) if one else 0), one)
        return np.sort(at)


class Numbers(dict):
    """Words by number; a new word gets the next one and waits to be learnt."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.waiting.append(word)
        self[word] = number = len(self)
        return number


class Words:
    """A tokenizer over texts, with the ids of words remembered.

    For vocabularies that lower-case, drop white space and cut words at changes between letters,
    digits and other signs: there the ids of a text are those of its words, and the signs after a
    word can be taken alone if the word, composed and lower-cased, ends in a letter or a digit.
    All ids learnt stand end to end; a word is a stretch of them.
    With ``added``, a text that may have an added token's string in it goes whole to the tokenizer as
    it is in the file, which gives that string its one id; without, it is text like any other.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges for words of a-z alone, which have nothing to normalise or to cut.
        self.plain = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | {"normalizer": None}))
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.tokenizer.encode_special_tokens = True
        self.unchanged = Tokenizer.from_file(path)
        tokens = list(self.unchanged.get_added_tokens_decoder().values()) if added else []
        # Strings looked for in the text as it is, by what all of them begin with, and in the lower-cased one.
        exact = [t.content.encode() for t in tokens if not t.normalized]
        begins = os.path.commonprefix(exact)
        self.exact = [begins] if begins else exact
        self.loose = [t.content.lower().encode() for t in tokens if t.normalized]
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.starts, self.lengths = array("q"), array("q")
        self.ids = array("I")
        # Stretches of the parts of words: start << 32 | length.
        self.cores: dict[bytes, int] = {b"": 0}

    def _learn(self) -> None:
        parts = []
        for word in self.numbers.waiting:
            if word.isalnum():
                parts.append((word.lower(), b""))
                continue
            core = word.rstrip(_ENDING)
            tail = word[len(core) :]
            if tail and not (core and (core[-1] in _PLAIN or _LETTER_END.search(unicodedata.normalize("NFC", core.decode()).lower()))):
                core, tail = word, b""
            parts.append((core.lower() if core.isascii() else core, tail))
        self.numbers.waiting.clear()
        cores = self.cores
        fresh = {x for pair in parts for x in pair}.difference(cores)
        plain = [x for x in fresh if x.isalpha()]
        for at in range(0, len(plain), TOGETHER):
            self._encode_letters(plain[at : at + TOGETHER], self.plain)
        others = [x for x in fresh if not x.isascii() and _LETTERS.match(x.decode())]
        for at in range(0, len(others), TOGETHER):
            self._encode_letters(others[at : at + TOGETHER], self.tokenizer)
        self._encode([x for x in fresh if x not in cores])
        mask, ids = (1 << 32) - 1, self.ids
        for core, tail in parts:
            at = cores[core]
            if tail:
                start, more = len(ids), cores[tail]
                for x in (at, more):
                    ids.extend(ids[x >> 32 : (x >> 32) + (x & mask)])
                at = start << 32 | ((at & mask) + (more & mask))
            self.starts.append(at >> 32)
            self.lengths.append(at & mask)

    def _encode(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for word, e in zip(words, found):
            self.cores[word] = len(self.ids) << 32 | len(e.ids)
            self.ids.extend(e.ids)

    def _encode_letters(self, words: list[bytes], tokenizer) -> None:
        """Words of letters alone, encoded as one text: each ends with the one token that ends words."""
        (found,) = tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words):
            return
        starts = np.concatenate([[0], ends[:-1]])
        self.cores.update(zip(words, (((starts + len(self.ids)) << 32) | (ends - starts)).tolist()))
        self.ids.frombytes(ids.tobytes())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        marked = [i for i, x in enumerate(texts) if any(t in x for t in self.exact)]
        if self.loose:
            marked = [i for i, x in enumerate(texts) if any(t in x for t in self.exact) or any(t in x.lower() for t in self.loose)]
        if not marked:
            return self._encode_words(texts)
        rest = list(texts)
        for i in marked:
            rest[i] = b""
        ids, lengths = self._encode_words(rest)
        pieces = np.split(ids, np.cumsum(lengths)[:-1])
        found = self.unchanged.encode_batch_fast([texts[i].decode() for i in marked], add_special_tokens=False)
        for i, e in zip(marked, found):
            pieces[i] = np.array(e.ids, np.uint32)
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))

    def _encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > MEMO:
            self.forget()
        split = [x.split() for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.numbers.waiting:
            self._learn()
        lengths = np.frombuffer(self.lengths, np.int64)[words] if len(words) else words
        starts = np.frombuffer(self.starts, np.int64)[words] if len(words) else words
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts - ends + lengths, lengths) + np.arange(total)
        ids = np.frombuffer(self.ids, np.uint32)[at] if total else np.empty(0, np.uint32)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(edges)


@lru_cache(maxsize=1)
def words_of(path: str, added: bool = False) -> Words:
    return Words(path, added)


def shards_of(docs: Iterable[tuple[object, np.ndarray]], limit: int = SHARD_TOKENS) -> Iterator[tuple[list, list[int], Matrix]]:
    """Documents in order as (identifiers, lengths, matrix) of about ``limit`` ids."""
    names, lengths, parts = [], [], []
    for name, ids in docs:
        if names and sum(lengths) + len(ids) > limit:
            yield names, lengths, Matrix.build(np.concatenate(parts))
            names, lengths, parts = [], [], []
        names.append(name)
        lengths.append(len(ids))
        parts.append(ids)
    if names:
        yield names, lengths, Matrix.build(np.concatenate(parts))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, text: str = "text", doc_id: str = "doc_id", added: bool = False) -> None:
    """Encode whole texts and write them as shards, in ascending order of identifier.

    A null text counts as empty; every document ends with ``end_id``, if one is given. Nulls come
    first in order, rows with one identifier in the order of a hash of their text. An empty table
    makes a folder without shards. Documents are put in order by range, so a task holds one shard at
    a time, and each shard says how many ids come before it in its part (the task that wrote it).
    With ``added``, strings of the tokenizer's added tokens have their single ids, as in the library's
    own encoding.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered = ordered.select("doc_id", F.col("text").cast("binary").alias("text"))
    end = np.array([] if end_id is None else [end_id], np.uint32)
    names_type = pa.list_(to_arrow_schema(slim.schema).field("doc_id").type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        words = words_of(tokenizer, added)

        def encoded():
            for batch in sliced(batches, "text"):
                ids, lengths = words.encode(batch["text"].to_pylist())
                for name, own in zip(batch["doc_id"].to_pylist(), np.split(ids, np.cumsum(lengths)[:-1])):
                    yield name, np.concatenate([own, end])

        for names, lengths, matrix in shards_of(encoded()):
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([matrix.size], pa.int64())]
            columns += [pa.array([names], names_type), pa.array([lengths], pa.list_(pa.int64())), binaries([matrix.to_bytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "size", "doc_ids", "lengths", "matrix"])
            before += matrix.size

    schema = f"part int, before long, size long, doc_ids array<{kind}>, lengths array<long>, matrix binary"
    mapped(ordered, run, schema).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the number of ids before them in all: sums over parts, one row each."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("size").alias("_size"))
    starts = running(parts, [], F.col("part"), [F.col("part")], F.col("_size"), "_start").select(F.col("part").alias("_p"), "_start")
    return shards.join(F.broadcast(starts), F.col("part") == F.col("_p")).withColumn("start", F.col("_start") + F.col("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit, as binary."""
    shards = placed(spark, path).select("start", "doc_ids", "lengths", "matrix")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, lengths = batch["doc_ids"][i].values, batch["lengths"][i].values.to_numpy()
                ids = Matrix.from_bytes(batch["matrix"][i].as_buffer()).all()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                blobs = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [names, pa.array(starts + batch["start"][i].as_py()), pa.array(lengths), binaries(blobs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return mapped(shards, run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def _per_shard(spark: SparkSession, path: str, answer: Callable[[Matrix], np.ndarray], name: str) -> DataFrame:
    shards = placed(spark, path).select("start", "matrix")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.asarray(answer(Matrix.from_bytes(batch["matrix"][i].as_buffer())), np.int64)
                start = pa.array(np.full(len(found), batch["start"][i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([start, pa.array(found)], ["start", name])

    return mapped(shards, run, f"start long, {name} long")


def count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row (n): how often a token occurs in all shards."""
    counts = _per_shard(spark, path, lambda m: [m.count(token)], "n")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position): every place of a token among all ids, found from the planes alone."""
    return _per_shard(spark, path, lambda m: m.occurrences(token), "at").select((F.col("start") + F.col("at")).alias("position"))


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
