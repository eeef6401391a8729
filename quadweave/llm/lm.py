"""Language-model scoring with an n-gram trie in Elias-Fano levels, sharded over the cluster.

The corpus is cut into chunks of whole documents, each with its own short word numbers. Level by level
a chunk sends its distinct n-grams, with their counts in training documents, to the shard of their
context; the shard sums the counts, builds its part of the trie's level, and answers each chunk's
n-grams from it by successor search within their context. Every document contributes, an n-gram is
sent once per chunk however often it occurs, and the sub-ranges of a frequent context are shards of
their own, so no task gathers a whole level.

Level 1 numbers the words by the rank of their hash and keeps their counts. From level 2 on, a level
has the sorted numbers of its contexts, monotone pointers to their successors, and the successors
themselves, each raised by its context's rank times the vocabulary so that the whole list is monotone:
all Elias-Fano. Beside a successor stands its quantised log probability, smoothed by
(count + k * p of the next shorter context) / (count of the context + k).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadweave.llm.arrow import Batches, binaries, mapped, send_package, sliced
from quadweave.llm.common import whole
from quadweave.llm.succinct import EliasFano, bundle, smallest, unbundle
from quadweave.session import owned, shared_folder, stage

#: Tokens in a chunk; a longer document has a chunk of its own.
CHUNK_TOKENS = 1 << 20
#: Training occurrences of a context beyond which its successors are spread over several shards.
HOT = 1 << 20
#: Smoothing by order, from pairs up.
STRENGTH = (500.0, 10.0, 10.0, 10.0)
#: Steps of a quantised log10 probability; codes beyond EVEN grow by a part of GROWTH each, down to 1e-300 and below.
STEPS, EVEN, GROWTH = 3000, 60_000, 2000
_KEY_BITS = 62
END, START = b" ", b"  "


def quantise(log10: np.ndarray) -> np.ndarray:
    """Codes of 16 bits: even steps to 1e-20, then steps in proportion, so that nothing is clipped."""
    steps = -log10 * STEPS
    far = steps > EVEN
    if far.any():
        steps = np.where(far, EVEN + GROWTH * np.log(np.maximum(steps, EVEN) / EVEN), steps)
    return np.rint(steps).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    steps = codes.astype(np.float64)
    far = steps > EVEN
    if far.any():
        steps = np.where(far, EVEN * np.exp((steps - EVEN) / GROWTH), steps)
    return steps / -STEPS


def steps_of(places: np.ndarray) -> np.ndarray:
    """Places that never fall, -1 for none, as small numbers: 0 for none, else one more than the step from the last."""
    out, there = np.zeros(len(places), np.int64), places >= 0
    out[there] = np.diff(places[there], prepend=0) + 1
    return out


def places_of(steps: np.ndarray) -> np.ndarray:
    out, there = np.full(len(steps), -1, np.int64), steps > 0
    out[there] = np.cumsum(steps[there].astype(np.int64) - 1)
    return out


def in_order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by (context, word), by one key where both fit in it."""
    wide = int(word.max(initial=0)) + 1
    if int(context.max(initial=0)) < (1 << 62) // wide:
        return np.argsort(context * wide + word)
    return np.lexsort((word, context))


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42) >> (64 - _KEY_BITS)


def _range_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a word key: equal ranges in the order of keys."""
    return ((keys >> np.uint64(_KEY_BITS - 31)) * np.uint64(shards)) >> np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Level:
    """A shard's part of a level from 2 on."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.universe = int(arrays[0][0])
        self.contexts, self.pointers, self.successors = (EliasFano.of(arrays[1 + 3 * i : 4 + 3 * i]) for i in range(3))
        self.codes, self.backoffs = arrays[10], arrays[11]

    @staticmethod
    def arrays(contexts: np.ndarray, lengths: np.ndarray, words: np.ndarray, codes: np.ndarray, backoffs: np.ndarray) -> list[np.ndarray]:
        """``contexts`` sorted, each with ``lengths`` successors, sorted ``words`` with their codes."""
        universe = int(words.max()) + 1 if len(words) else 1
        raised = words.astype(np.uint64) + np.repeat(np.arange(len(contexts)), lengths).astype(np.uint64) * np.uint64(universe)
        pointers = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
        lists = [EliasFano.parts(x) for x in (contexts, pointers, raised)]
        return [np.array([universe], np.int64), *lists[0], *lists[1], *lists[2], codes, backoffs]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the context, index of the successor), -1 where there is none."""
        edges = np.flatnonzero(contexts[1:] != contexts[:-1]) + 1  # asked for once where equal ones follow each other
        edges = np.concatenate([[0], edges]) if len(contexts) else edges
        rank = np.repeat(self.contexts.find(contexts[edges]), np.diff(edges, append=len(contexts)))
        there = np.flatnonzero((rank >= 0) & (words < self.universe))
        at = np.full(len(rank), -1, np.int64)
        raised = words[there].astype(np.uint64) + rank[there].astype(np.uint64) * np.uint64(self.universe)
        at[there] = self.successors.find(raised)
        return rank, at


class Chunk:
    """The tokens of some whole documents, and what the levels so far have answered about them."""

    def __init__(self, data: bytes) -> None:
        self.lengths, self.training, self.tokens = unbundle(data)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[(np.cumsum(self.lengths) - self.lengths).astype(np.int64)] = True
        self.trained = np.repeat(self.training.astype(bool), self.lengths)

    def learn_words(self, ids: np.ndarray, counts: np.ndarray, totals: Totals) -> None:
        """Words' numbers (-1: not in training) and counts, in the chunk's own numbering."""
        self.word = ids[self.tokens]
        self.known = counts[self.tokens]
        self.base_logs = np.log10(totals.base(counts))[self.tokens]
        self.logs = self.base_logs.copy()
        self.order = 1
        # The context of the next order: the word before, or the start.
        self.gram, self.gram_count = self.word, self.known
        self.start = (totals.words, totals.documents)
        self._contexts()

    def _contexts(self) -> None:
        context, count = np.roll(self.gram, 1), np.roll(self.gram_count, 1)
        start = self.start if self.order == 1 else (-1, 0)
        self.context = np.where(self.first, start[0], context)
        self.context_count = np.where(self.first, start[1], count)

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Distinct (context, word) pairs of known parts with the contexts' counts; keeps where each is asked."""
        self.asked = np.flatnonzero((self.context >= 0) & (self.word >= 0) & (self.context_count > 0))
        order = in_order(self.context[self.asked], self.word[self.asked])
        c, w = self.context[self.asked][order], self.word[self.asked][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        self.slot = np.empty(len(order), np.int64)
        self.slot[order] = np.cumsum(fresh) - 1
        self.at = self.asked[order[fresh]]
        return c[fresh], w[fresh], self.context_count[self.at]

    def grams(self) -> tuple[np.ndarray, ...]:
        """(context, word, occurrences in training, the context's count, code of the next shorter order) of the pairs."""
        context, word, count = self.pairs()
        trained = np.bincount(self.slot[self.trained[self.asked]], minlength=len(self.at))
        return context, word, trained, count, quantise(self.logs[self.at])

    def learn_level(self, codes: np.ndarray, ids: np.ndarray | None, counts: np.ndarray | None, strength: float) -> None:
        """The answers for :meth:`pairs`; an unknown word after a known context, not asked for, backs off."""
        self.order += 1
        rest = np.flatnonzero((self.context >= 0) & (self.context_count > 0) & (self.word < 0))
        self.logs[rest] += np.log10(strength / (self.context_count[rest] + strength))
        self.logs[self.asked] = dequantise(codes)[self.slot]
        if ids is not None:
            self.gram, self.gram_count = np.full(len(self.tokens), -1, np.int64), np.zeros(len(self.tokens), np.int64)
            self.gram[self.asked], self.gram_count[self.asked] = ids[self.slot], counts[self.slot]
            self._contexts()


class Totals:
    """Training tokens, distinct ones and documents, and where each shard's word numbers begin."""

    def __init__(self, tokens: int, words: int, documents: int, bases: dict[int, int]) -> None:
        self.tokens, self.words, self.documents, self.bases = tokens, words, documents, bases

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))


def shard_of(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, shards: int, hot: int) -> np.ndarray:
    """Contexts' shards; the words after a hot context are spread in proportion to its count."""
    mixed, spread = _mixed(contexts.astype(np.uint64)), np.flatnonzero(counts >= hot)
    mixed[spread] += _mixed(words[spread].astype(np.uint64)) % (counts[spread] // hot + 1).astype(np.uint64)
    return (_mixed(mixed) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """The order by shard, stable; numbers of 16 bits are sorted by their digits."""
    return np.argsort(smallest(shard), kind="stable")


def groups(batches: Batches, key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows by equal ``key``; the input is sorted by it. A group is one chunk or one shard."""
    name, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i] for c in batch.schema.names}
            now = row[key].as_py()
            if held and now != name:
                yield name, held
                held = []
            name = now
            held.append(row)
    if held:
        yield name, held


def chunks_of(docs: DataFrame, training: Column, text: str, doc_id: str, limit: int = CHUNK_TOKENS) -> DataFrame:
    """(chunk, doc_ids, words, data): words' keys in the order of their numbers, and the tokens."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole(text).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names_type = pa.list_(to_arrow_schema(slim.schema).field("doc_id").type)

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = number = len(self)
            return number

    def run(batches: Batches) -> Batches:
        base, done = TaskContext.get().partitionId() << 32, 0

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, numbers), np.uint64, len(numbers))
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[np.concatenate(parts)]
            data = bundle(smallest(np.array([len(x) for x in parts])), np.array(flags, np.uint8), smallest(tokens))
            columns = [pa.array([base + done]), pa.array([names], names_type), binaries([bundle(keys[order])]), binaries([data])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "words", "data"])

        numbers, parts, flags, names, held = Numbers(), [], [], [], 0
        for batch in sliced(batches, "text"):
            for name, raw, flag in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["training"].to_pylist()):
                words = raw.lower().split()
                words.append(END)
                if names and held + len(words) > limit:
                    yield flush()
                    numbers, parts, flags, names, held, done = Numbers(), [], [], [], 0, done + 1
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                flags.append(flag)
                names.append(name)
                held += len(words)
        if names:
            yield flush()

    return mapped(slim, run, f"chunk long, doc_ids array<{kind}>, words binary, data binary")


_ASK = "shard int, chunk long, data binary"
_ANSWER = "chunk long, shard int, data binary, tokens long, distinct long, documents long"


def _asks(chunk: int, shard: np.ndarray, columns: Sequence[np.ndarray], pack: Callable[..., bytes]) -> pa.RecordBatch:
    """A row for every shard: its entries of the columns, in their order."""
    order = _by_shard(shard)
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    blobs = [pack(*[x[part] for x in columns]) for part in np.split(order, edges[1:])] if len(order) else []
    found = pa.array(shard[order][edges] if len(order) else [], pa.int32())
    return pa.RecordBatch.from_arrays([found, pa.array(np.full(len(blobs), chunk, np.int64)), binaries(blobs)], ["shard", "chunk", "data"])


def _answers(shard: int, rows: list[dict], answers: list[bytes], model: bytes, tokens: int = 0, distinct: int = 0, documents: int = 0) -> pa.RecordBatch:
    """The answers to the chunks, then the shard's part of the level, as chunk -1."""
    n = len(rows)
    columns = [pa.array([r["chunk"].as_py() for r in rows] + [-1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), binaries([*answers, model])]
    columns += [pa.array([0] * n + [x], pa.int64()) for x in (tokens, distinct, documents)]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "data", "tokens", "distinct", "documents"])


def _ask_words(shards: int) -> Callable[[Batches], Batches]:
    end = word_key(END)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                (keys,), chunk = unbundle(batch["words"][i].as_py()), Chunk(batch["data"][i].as_py())
                counts = np.bincount(chunk.tokens[chunk.trained], minlength=len(keys))
                yield _asks(batch["chunk"][i].as_py(), _range_of(keys, shards).astype(np.int64), [keys, counts], lambda k, c: bundle(k, smallest(c)))

    def answer(batches: Batches) -> Batches:
        for shard, rows in groups(batches, "shard"):
            sent = [unbundle(r["data"].as_py()) for r in rows]
            keys, back = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([s[1] for s in sent]).astype(np.float64), minlength=len(keys)).astype(np.int64)
            own, seen = keys[counts > 0], counts[counts > 0]
            low = own[0] if len(own) else np.uint64(0)
            parts = EliasFano.parts(own - low)
            level = EliasFano.of(parts)
            inside = np.where(keys >= low, keys - low, np.uint64((1 << _KEY_BITS) - 1))
            rank = level.find(inside)
            number = rank[back]
            total = np.where(rank >= 0, seen[np.maximum(rank, 0)] if len(seen) else 0, 0)[back]
            ends = np.cumsum([len(s[0]) for s in sent])[:-1]
            out = [bundle(smallest(steps_of(a)), smallest(b)) for a, b in zip(np.split(number, ends), np.split(total, ends))]
            documents = int(counts[keys == end].sum())
            model = bundle(np.array([low]), *parts, smallest(seen))
            yield _answers(shard, rows, out, model, int(counts.sum()), len(own), documents)

    run.answer = answer
    return run


def _prepared(data: bytes, answers: pa.Table, shards: int, totals: Totals, order: int, strength: Sequence[float], hot: int) -> Chunk:
    """A chunk from its own data and the answers of all levels so far."""
    levels, places = answers["level"].to_numpy(), answers["shard"].to_numpy()

    def given(level: int) -> list[tuple[int, list[np.ndarray]]]:
        rows = np.flatnonzero(levels == level)
        return [(int(places[i]), unbundle(answers["data"][int(i)].as_py())) for i in rows[np.argsort(places[rows])]]

    chunk = Chunk(data)
    ids, counts = [], []
    for shard, (number, count) in given(1):
        number = places_of(number)
        ids.append(np.where(number >= 0, number + totals.bases[shard], -1))
        counts.append(count.astype(np.int64))
    chunk.learn_words(np.concatenate(ids), np.concatenate(counts), totals)
    for level in range(2, order + 1):
        place = _by_shard(shard_of(*chunk.pairs(), shards, hot))
        found = given(level)
        columns = [np.concatenate([a[0] for _, a in found])] if found else [np.empty(0, np.uint16), *[np.empty(0, np.int64)] * 2]
        if found and len(found[0][1]) > 1:
            numbers = [places_of(a[1]) for _, a in found]
            numbers = [np.where(n >= 0, n * shards + shard, -1) for n, (shard, _) in zip(numbers, found)]
            columns += [np.concatenate(numbers), np.concatenate([a[2] for _, a in found]).astype(np.int64)]
        spread = [np.empty_like(c) for c in columns]
        for a, b in zip(spread, columns):
            a[place] = b
        chunk.learn_level(spread[0], *(spread[1:] or [None, None]), strength[level - 2])
    return chunk


def _with_answers(chunks: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` for each chunk with its row and its answers; the answers come to the chunks, which stay where they are."""

    def both(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(key[0].as_py(), own, given)))

    send_package(chunks.sparkSession)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)


def _ask_level(
    level: int, shards: int, totals: Totals, strength: Sequence[float], more: bool, hot: int, keep: bool, turn: int = 0, turns: int = 1
) -> Callable[[Batches], Batches]:
    """Asks of a level for the shards whose number leaves ``turn`` when divided by ``turns``."""
    def pack(contexts: np.ndarray, words: np.ndarray, trained: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
        edges = np.flatnonzero(np.diff(contexts, prepend=-1))
        lengths = np.diff(edges, append=len(contexts))
        return bundle(smallest(np.diff(contexts[edges], prepend=0)), smallest(lengths), smallest(counts[edges]), smallest(words), smallest(trained), codes)

    def run(name: int, own: pa.Table, given: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk = _prepared(own["data"][0].as_py(), given, shards, totals, level - 1, strength, hot)
        grams = chunk.grams()
        shard = shard_of(grams[0], grams[1], grams[3], shards, hot)
        mine = np.flatnonzero(shard % turns == turn)
        yield _asks(name, shard[mine], [g[mine] for g in grams], pack)

    def answer(batches: Batches) -> Batches:
        k = strength[level - 2]
        for shard, rows in groups(batches, "shard"):
            sent = [[x.astype(np.int64) if i < 5 else x for i, x in enumerate(unbundle(r["data"].as_py()))] for r in rows]
            context = np.concatenate([np.repeat(np.cumsum(s[0]), s[1]) for s in sent])
            total = np.concatenate([np.repeat(s[2], s[1]) for s in sent])
            word, trained, lower = (np.concatenate([s[i] for s in sent]) for i in (3, 4, 5))
            order = in_order(context, word)
            c, w = context[order], word[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
            group = np.cumsum(fresh) - 1
            back = np.empty(len(order), np.int64)
            back[order] = group
            count = np.add.reduceat(trained[order], np.flatnonzero(fresh)) if len(order) else trained
            c, w, total, lower = c[fresh], w[fresh], total[order][fresh], dequantise(lower[order][fresh])
            edge = np.flatnonzero(np.diff(c, prepend=-1))
            seen = count > 0
            smoothed = np.log10((count + k * 10.0**lower) / (total + k))
            lengths = np.add.reduceat(seen.astype(np.int64), edge) if len(edge) else np.empty(0, np.int64)
            backoffs = quantise(np.log10(k / (total[edge] + k)))
            arrays = Level.arrays(c[edge].astype(np.uint64), lengths, w[seen], quantise(smoothed[seen]), backoffs)
            trie = Level(arrays)
            rank, at = trie.find(c.astype(np.uint64), w)
            own = trie.codes[np.maximum(at, 0)] if len(trie.codes) else np.zeros(len(at), np.uint16)
            backed = quantise(dequantise(trie.backoffs[rank]) + lower)
            code = np.where(at >= 0, own, backed)[back]
            ends = np.cumsum([len(s[3]) for s in sent])[:-1]
            out = [code]
            if more:
                out += [at[back], count[back]]
            parts = [np.split(x, ends) for x in out]
            answers = [bundle(p[0], *[smallest(x) for x in (steps_of(p[1]), p[2])]) if more else bundle(p[0]) for p in zip(*parts)]
            yield _answers(shard, rows, answers, bundle(*arrays) if keep else b"", int(count.sum()), int(seen.sum()))

    run.answer = answer
    return run


def score(
    docs: DataFrame,
    training: Column,
    order: int = 2,
    strength: Sequence[float] = STRENGTH,
    text: str = "text",
    doc_id: str = "doc_id",
    hot: int = HOT,
    keep: bool = True,
    turns: int = 2,
) -> tuple[DataFrame, list[DataFrame]]:
    """Scores of all documents by a model of those marked ``training``, and the model's levels.

    The first table has doc_id, training, n_tokens, n_known, train_tokens, base_score and score for
    every row of ``docs``, repeated ones too: A-Z are lower-cased, tokens are the words and one end
    token, a null or empty text has the end token alone. Scores are log10 probabilities of the whole
    text, ``base_score`` by smoothed counts of single tokens, ``score`` by the model of ``order``
    words. A null ``training`` counts as false; without a training document every token has the
    probability that one unseen token has. The levels are tables (shard, data) in the shared folder;
    with ``keep=False`` a level from 2 on lives only in the tasks that build it and answer from it. The
    last level is asked for in ``turns``, a part of its shards at a time, so that its n-grams are never
    all on disk at once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 2 * partitions
    with _files_removed(spark):
        chunks = _bucketed(chunks_of(docs, training, text, doc_id), partitions)
        ask = _ask_words(shards)
        answered = _answered(mapped(chunks.select("chunk", "words", "data"), ask, _ASK), ask, shards)
        levels = [answered.filter("chunk < 0").select("shard", "data")]
        # One row of numbers per shard.
        found = answered.filter("chunk < 0").select("shard", "tokens", "distinct", "documents").orderBy("shard").collect()
        before, bases = 0, {}
        for r in found:
            bases[r["shard"]] = before
            before += r["distinct"]
        totals = Totals(sum(r["tokens"] for r in found), before, sum(r["documents"] for r in found), bases)
        answers = _given(answered, 1)
        for level in range(2, order + 1):
            parts, known, model = (turns if level == order else 1), answers, None
            for turn in range(parts):
                ask = _ask_level(level, shards, totals, strength, level < order, hot, keep, turn, parts)
                asked = _with_answers(chunks.select("chunk", "data"), known, ask, _ASK)
                answered = _answered(asked, ask, shards)
                own = answered.filter("chunk < 0").select("shard", "data")
                model = own if model is None else model.unionByName(own)
                answers = answers.unionByName(_given(answered, level))
            levels += [model] if keep else []
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def sums(_: int, own: pa.Table, given: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk = _prepared(own["data"][0].as_py(), given, shards, totals, order, strength, hot)
        starts = (np.cumsum(chunk.lengths) - chunk.lengths).astype(np.int64)
        add = lambda x: np.add.reduceat(x, starts)
        columns = [own["doc_ids"][0].values, pa.array(chunk.training.astype(bool)), pa.array(chunk.lengths.astype(np.int64))]
        columns += [pa.array(add((chunk.known > 0).astype(np.int64))), pa.array(np.full(len(starts), totals.tokens, np.int64))]
        columns += [pa.array(add(chunk.base_logs)), pa.array(add(chunk.logs))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(chunks.select("chunk", "data", "doc_ids"), answers, sums, schema), levels


def _answered(asked: DataFrame, ask: Callable, shards: int) -> DataFrame:
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
    return stage(mapped(dealt, ask.answer, _ANSWER))


def _given(answered: DataFrame, level: int) -> DataFrame:
    return answered.filter("chunk >= 0").select("chunk", F.lit(level).alias("level"), "shard", "data")


@contextmanager
def _files_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the write that made them, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    """The chunks written in buckets of their number in the shared folder: each pass reads them without a shuffle."""
    spark, name = chunks.sparkSession, f"quadweave_chunks_{uuid.uuid4().hex}"
    owned(f"{shared_folder(spark)}/{name}", name)
    chunks.write.bucketBy(buckets, "chunk").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
