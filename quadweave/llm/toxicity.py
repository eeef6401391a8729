"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

The model is fitted in one task on a bounded sample of labelled rows and is a sparse list of weights,
which goes to every task; texts of any number are then scored whole where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.arrow import Batches, mapped, sliced
from quadweave.llm.common import whole

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their identifier.
SAMPLE = 20_000
BITS = 20
# Characters that are cut from the ends of a word.
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Ftrl:
    """Rates of the learner: ``alpha`` and ``beta`` set the per-coordinate rate, ``l1`` the sparsity;
    pairs count ``pair_value`` as much as words, and toxic rows ``positive`` times."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    rounds: int = 6
    pair_value: float = 0.3
    positive: float = 5.0


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features that have one; the last cell is the intercept."""

    cells: np.ndarray
    weights: np.ndarray
    pair_value: float

    def dense(self) -> np.ndarray:
        table = np.zeros((1 << BITS) + 1)
        table[self.cells] = self.weights
        return table


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of a text's words, and those of its pairs of words at distance one and two."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    pairs = [hashes[:-k] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[k:] + np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F) for k in (1, 2)]
    return np.unique(hashes >> shift).astype(np.int64), np.unique(np.concatenate(pairs) >> shift).astype(np.int64)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights learnt from (word cells, pair cells, label) rows, in their order."""
    size = 1 << BITS
    z, n, l1 = np.zeros(size + 1), np.zeros(size + 1), np.full(size + 1, how.l1)
    l1[size] = 0.0

    def weight(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -pull / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)

    for _ in range(how.rounds):
        for words, pairs, label in rows:
            # A word and a pair may share a cell: each cell is updated once.
            own = pairs[~np.isin(pairs, words, assume_unique=True)]
            at = np.concatenate([words, own, [size]])
            value = np.concatenate([np.ones(len(words)), np.full(len(own), how.pair_value), [1.0]])
            w = weight(at)
            gradient = (_sigmoid(w @ value) - label) * value * (how.positive if label else 1.0)
            step = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / how.alpha
            z[at] += gradient - step * w
            n[at] += gradient * gradient
    found = weight(slice(None))
    cells = np.flatnonzero(found)
    return cells, found[cells]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, how: Ftrl = Ftrl()) -> Model:
    """A model of ``labels`` (identifier and 0/1 label), fitted on at most ``sample`` labelled rows.

    Null identifiers and labels are left out; a row labelled twice is toxic if one label says so; of
    documents that share an identifier the least text is taken. Without a label there are no weights,
    and every score is one half.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_doc"), whole(text).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = rows.select(F.xxhash64("_id").alias("_order"), F.col("_text").cast("binary").alias("_text"), "_y")

    def cut(batches: Batches) -> Batches:
        for batch in sliced(batches, "_text"):
            cells = [features(x) for x in batch["_text"].to_pylist()]
            columns = [pa.array([c[i] for c in cells], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["_order"], batch["_y"], *columns], ["_order", "_y", "_words", "_pairs"])

    cells = mapped(rows, cut, "_order long, _y int, _words array<long>, _pairs array<long>")

    def learn(batches: Batches) -> Batches:
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                words, pairs = (batch[c][i].values.to_numpy().astype(np.int32) for c in ("_words", "_pairs"))
                held.append((batch["_order"][i].as_py(), words, pairs, batch["_y"][i].as_py()))
        held.sort(key=lambda r: (r[0], r[3]))
        at, weights = fit_rows([r[1:] for r in held], how)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights)], ["cell", "weight"])

    found = mapped(cells.repartition(1), learn, "cell long, weight double").toPandas()
    found = found.sort_values("cell")
    return Model(found["cell"].to_numpy(np.int64), found["weight"].to_numpy(float), how.pair_value)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the model's probability that the whole text is toxic.

    Null and empty texts get the intercept's score. Only the text is an input; repeated rows get the
    same score.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole(text).cast("binary").alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        table = model.dense()
        for batch in sliced(batches, "_text"):
            found = []
            for raw in batch["_text"].to_pylist():
                words, pairs = features(raw)
                own = pairs[~np.isin(pairs, words, assume_unique=True)]
                found.append(_sigmoid(table[words].sum() + model.pair_value * table[own].sum() + table[-1]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.float64())], ["doc_id", "score"])

    return mapped(slim, run, f"doc_id {kind}, score double")
