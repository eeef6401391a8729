"""Exact k-means with ns-bounds: stored distances loosen by how far a centroid is from where it was then.

Every vector keeps its distance to its own centroid and a lower bound for every other one, each with the
round in which it was evaluated. The centroids of all rounds are kept (rounds x k x dims integers), so a
bound is loosened by the norm of the centroid's total displacement since that round, which is never more
than the sum of the drifts between. A centroid whose loosened bound is above the distance to the own one
cannot be nearer; every other one is evaluated again, in integers. Bounds only save work: the
assignment is that of plain k-means, ties going to the smaller number.

Vectors stay in blocks of rows where the scan put them and are never shuffled. A round reads the blocks
that the round before wrote, writes them with their new bounds and their sums by cluster, and only
k * (dims + 1) totals reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm.arrow import Batches, mapped
from quadweave.llm.vectors import LONGEST, as_long, exact, packed, pieces, quantised, unpacked
from quadweave.schema import local_table
from quadweave.session import hadoop_path, shared_folder, stage

#: Vectors in a block.
ROWS = 4096
#: Room for rounding when a bound, held in 32 bits, is compared.
SLACK = 1e-6
_STATE = "q binary, own binary, upper binary, upper_at binary, lower binary, lower_at binary, sums array<long>, scanned long"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, or to one each."""
    return ((vectors - centroids) ** 2).sum(axis=1)


def _norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


class Block:
    """Some vectors with their assignment and bounds."""

    def __init__(self, q: np.ndarray, own: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> None:
        self.q, self.own, self.upper, self.upper_at, self.lower, self.lower_at = q, own, upper, upper_at, lower, lower_at
        self.scanned = 0

    @classmethod
    def fresh(cls, q: np.ndarray, centroids: np.ndarray) -> Block:
        """All distances evaluated, in round 0."""
        n, k = len(q), len(centroids)
        block = cls(q, np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.uint8), np.empty((n, k), np.float32), np.zeros((n, k), np.uint8))
        q, centroids = exact(q, centroids)
        best = squared(q, centroids[0])
        for j in range(k):
            found = squared(q, centroids[j])
            block.lower[:, j] = _norms(found)
            nearer = found < best
            best[nearer], block.own[nearer] = found[nearer], j
        block.upper = _norms(best)
        block.scanned = n * k
        return block

    @classmethod
    def of(cls, row: dict, dims: int, k: int) -> Block:
        own = np.frombuffer(row["own"], np.int32).copy()
        read = lambda c, kind: np.frombuffer(row[c], kind).copy()
        q = unpacked(row["q"], len(own) * dims).reshape(-1, dims)
        return cls(q, own, read("upper", np.float64), read("upper_at", np.uint8), read("lower", np.float32).reshape(-1, k), read("lower_at", np.uint8).reshape(-1, k))

    def assign(self, history: np.ndarray) -> None:
        """Bounds are loosened to the last centroids of ``history``; what they cannot exclude is evaluated."""
        now, k = len(history) - 1, history.shape[1]
        centroids = history[now]
        # Displacements are up to 2 ** 55: float64 holds their squares well within SLACK.
        moved = np.sqrt(((history - centroids).astype(np.float64) ** 2).sum(axis=2))
        low = self.lower * (1 - SLACK) - moved[self.lower_at, np.arange(k)]
        low[np.arange(len(low)), self.own] = np.inf
        high = self.upper + moved[self.upper_at, self.own]
        failed = np.flatnonzero((low <= high[:, None] * (1 + SLACK)).any(axis=1))
        if not len(failed):
            return
        q, centroids = exact(self.q[failed], centroids)
        best = squared(q, centroids[self.own[failed]])
        before = self.own[failed]
        self.lower[failed, before], self.lower_at[failed, before] = _norms(best), now
        self.scanned += len(failed)
        low, limit, own = low[failed], _norms(best) * (1 + SLACK), before.copy()
        for j in range(k):
            asked = np.flatnonzero(low[:, j] <= limit)
            if not len(asked):
                continue
            found = squared(q[asked], centroids[j])
            self.lower[failed[asked], j], self.lower_at[failed[asked], j] = _norms(found), now
            self.scanned += len(asked)
            nearer = (found < best[asked]) | ((found == best[asked]) & (j < own[asked]))
            won = asked[nearer]
            best[won], own[won] = found[nearer], j
            limit[won] = _norms(best[won]) * (1 + SLACK)
        self.own[failed], self.upper[failed], self.upper_at[failed] = own, _norms(best), now

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances to the own centroids."""
        q, centroids = exact(self.q, centroids)
        return as_long(squared(q, centroids[self.own]))

    def sums(self, k: int) -> np.ndarray:
        """Components summed by cluster, then the counts."""
        dims = self.q.shape[1]
        out = np.zeros(k * (dims + 1), np.int64)
        for j in np.unique(self.own).tolist():
            out[j * dims : (j + 1) * dims] = self.q[self.own == j].sum(axis=0)
        out[k * dims :] = np.bincount(self.own, minlength=k)
        return out

    def columns(self, k: int) -> list[pa.Array]:
        blobs = [packed(self.q), *[x.tobytes() for x in (self.own, self.upper, self.upper_at, self.lower, self.lower_at)]]
        return [*[pa.array([b], pa.binary()) for b in blobs], pa.array([self.sums(k)], pa.list_(pa.int64())), pa.array([self.scanned], pa.int64())]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/vectors-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    folder, files = hadoop_path(spark, path)
    files.delete(folder, True)


def kmeans(
    table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vector: str = "embedding", own: str = "vec_id"
) -> tuple[DataFrame, np.ndarray, int]:
    """((vec_id, cluster, distance) of every vector, the final centroids, how many distances the rounds evaluated).

    Components are floor(scale * x), held to 2 ** 50 in size; a vector that is null, that has not
    exactly ``dims`` components, or a null or non-finite one, is left out. The first centroids are the k
    vectors with the smallest SHA-256 of ``seed:id`` (a null identifier as an empty string, ties by
    components), fewer if there are fewer vectors. Each round assigns every vector to the nearest
    centroid, the smaller number on ties, and replaces a centroid that has vectors by the floor of
    their mean; then vectors are assigned once more. ``distance`` is squared; one beyond a long is the
    largest long. Repeated rows each get a row, an empty table gives none. Of two rounds' blocks in
    the shared folder the older are removed when the newer are written.
    """
    spark = table.sparkSession
    vectors = quantised(table, scale, vector, own, dims)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if rounds < 1:
        raise ValueError("at least one round")
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), np.empty((0, dims), np.int64), 0
    history = np.array([[r["q"] for r in first]], np.int64)
    k = len(first)
    names = ["ids", *[c.split()[0] for c in _STATE.split(", ")]]
    schema = f"ids array<{kind}>, {_STATE}"

    def start(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, ROWS, ROWS * dims):
                q = piece["q"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), piece["vec_id"])
                yield pa.RecordBatch.from_arrays([ids, *Block.fresh(q, history[0]).columns(k)], names)

    def again(history: np.ndarray, last: bool):
        def run(batches: Batches) -> Batches:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block.of({c: batch[c][i].as_py() for c in names[1:7]}, dims, k)
                    block.assign(history)
                    if not last:
                        yield pa.RecordBatch.from_arrays([batch["ids"].slice(i, 1), *block.columns(k)], names)
                        continue
                    columns = [batch["ids"][i].values, pa.array(block.own), pa.array(block.distances(history[-1]))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

        return run

    held, path = _written(mapped(vectors, start, schema))
    evaluated = 0
    for number in range(rounds):
        totals = held.select(F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
        found = {r["place"]: int(r["total"]) for r in totals.collect()}
        evaluated += held.agg(F.sum("scanned")).first()[0]
        fresh = history[-1].copy()
        for j in range(k):
            if count := found[k * dims + j]:
                fresh[j] = [found[j * dims + i] // count for i in range(dims)]
        history = np.concatenate([history, fresh[None]])
        if number == rounds - 1:
            labels = stage(mapped(held, again(history, True), f"vec_id {kind}, cluster int, distance long"))
            _remove(spark, path)
            return labels, history[-1], evaluated
        newer, newer_path = _written(mapped(held, again(history, False), schema))
        _remove(spark, path)
        held, path = newer, newer_path


def report(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every row of ``labels``.

    Inertias are sums of squared distances, one beyond a long being the largest long. The k sums and
    digests come to the driver and go back to the rows as a table of k rows.
    """
    sums = {r["cluster"]: int(r["total"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, min(total, LONGEST), min(whole, LONGEST), digests[j]) for j, total in sorted(sums.items())]
    known = local_table(labels.sparkSession, rows, T.StructType.fromDDL("_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return labels.join(F.broadcast(known), F.col("cluster") == F.col("_cluster")).drop("_cluster")
