"""Exact top-k by inner product: term-at-a-time accumulation over blocks of candidates.

A block of candidates is turned into postings: for each component (term) the rows where it is not zero
and their weights. A query visits the postings of its own non-zero terms and adds weight times
weight to a dense array with one score per row of the block; every candidate is scored, none is
skipped. The best of each block are cut by partition selection, merged in the task and then per
query over all tasks.

Queries and candidates meet in cells of (query block, candidate group), both of bounded size, so that a
task holds one cell whatever the number of either. Candidates are sent once per query block and queries
once per candidate group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.arrow import Batches, mapped, send_package
from quadweave.llm.vectors import as_long, exact, packed, pieces, quantised, unpacked
from quadweave.session import stage

#: Rows and components of a block of candidates; queries and components in a query block; components in a candidate group.
ROWS, ELEMENTS = 4096, 1 << 19
QUERIES, GROUP_ELEMENTS = 4096, 1 << 22

Posting = tuple[np.ndarray | slice, np.ndarray]


def postings(flat: np.ndarray, lengths: np.ndarray) -> dict[int, Posting]:
    """Rows and weights by component, of vectors end to end; all rows are one slice."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    there = np.flatnonzero(flat)
    there = there[np.argsort(term[there], kind="stable")]
    terms, starts = np.unique(term[there], return_index=True)
    found = {}
    for t, part in zip(terms.tolist(), np.split(there, starts[1:])):
        found[t] = (slice(None) if len(part) == len(lengths) else row[part], flat[part])
    return found


def accumulate(query: np.ndarray, lists: dict[int, Posting], rows: int) -> np.ndarray:
    """The inner product of a query with every row."""
    scores = np.zeros(rows, query.dtype)
    for term in np.flatnonzero(query).tolist():
        if term in lists:
            where, weights = lists[term]
            scores[where] += query[term] * weights
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of all scores that are not below the k-th best."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


def _blocks(vectors: DataFrame, kind: str) -> DataFrame:
    """(block, rows, elements, ids, lengths, flat): blocks of rows, numbered by partition and place."""

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, ROWS, ELEMENTS):
                flat = piece["q"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.array([len(x) for x in piece["q"]], np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), piece["vec_id"])
                columns = [pa.array([x], pa.int64()) for x in (number, len(lengths), len(flat))]
                blobs = [pa.array([x], pa.binary()) for x in (lengths.tobytes(), packed(flat))]
                yield pa.RecordBatch.from_arrays([*columns, ids, *blobs], ["block", "rows", "elements", "ids", "lengths", "flat"])
                number += 1

    return stage(mapped(vectors, run, f"block long, rows long, elements long, ids array<{kind}>, lengths binary, flat binary"))


def _opened(lengths: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(lengths, np.int32).astype(np.int64)
    return sizes, unpacked(flat, int(sizes.sum()))


def _asked(blocks: DataFrame, every: int, kind: str) -> DataFrame:
    """(block, place, query_id, q) of the rows whose identifier ``every`` divides."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, block = batch["ids"][i].values, batch["block"][i].as_py()
                places = [at for at, x in enumerate(ids.to_pylist()) if x is not None and x % every == 0]
                sizes, flat = _opened(batch["lengths"][i].as_py(), batch["flat"][i].as_py())
                ends = np.cumsum(sizes)
                vectors = [flat[ends[at] - sizes[at] : ends[at]] for at in places]
                columns = [pa.array([block] * len(places), pa.int64()), pa.array(places, pa.int32()), ids.take(pa.array(places, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.int64()))], ["block", "place", "query_id", "q"])

    return stage(mapped(blocks, run, f"block long, place int, query_id {kind}, q array<long>"))


def search(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vector: str = "embedding", own: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows for every query, by inner product.

    Components are floor(scale * x), held to 2 ** 50 in size. Vectors that are null or have null or
    non-finite components take no part; components that one of two vectors lacks count as zero, so
    vectors of any lengths meet. Queries are the rows whose identifier ``every`` divides, candidates
    all rows but the query's own, also others with its identifier. Ties go to the smaller
    identifier, a null one last; a query with fewer candidates gets all of them. A score beyond a long
    becomes the nearest long. Repeated query rows each have their ranks.
    """
    spark = table.sparkSession
    vectors = quantised(table, scale, vector, own)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    blocks = _blocks(vectors, kind)
    queries = _asked(blocks, every, kind)
    size = blocks.agg(F.sum("elements").alias("elements"), F.count("*").alias("blocks")).first()
    asked = queries.agg(F.count("*").alias("n"), F.sum(F.size("q").cast("long")).alias("elements")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = max(1, -(-asked.n // QUERIES), -(-(asked.elements or 0) // ELEMENTS))
    groups = max(1, -(-(size.elements or 0) // GROUP_ELEMENTS), min(size.blocks, -(-partitions // cuts)))
    every_cut, every_group = F.sequence(F.lit(0), F.lit(cuts - 1)), F.sequence(F.lit(0), F.lit(groups - 1))
    left = queries.withColumns({"cut": F.pmod(F.xxhash64("block", "place"), F.lit(cuts)).cast("int"), "group": F.explode(every_group)})
    right = blocks.withColumns({"group": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "cut": F.explode(every_cut)})

    def cell(key: tuple, wanted: pa.Table, given: pa.Table) -> pa.Table:
        found = _cell(wanted, given, k) if wanted.num_rows else []
        of = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
        own = wanted.select(["block", "place", "query_id"]).take(of)
        scores = as_long(np.array([-x[0] for best in found for x in best], object))
        ids = pa.array([x[2] for best in found for x in best], given["ids"].type.value_type)
        return own.append_column("vec_id", ids).append_column("score", pa.array(scores, pa.int64()))

    send_package(spark)
    met = left.groupBy("cut", "group").cogroup(right.groupBy("cut", "group")).applyInArrow(cell, f"block long, place int, query_id {kind}, vec_id {kind}, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cell(wanted: pa.Table, given: pa.Table, k: int) -> list[list[tuple]]:
    """For each query of a cell the ``k`` best of its candidates: (-score, null identifier?, identifier)."""
    queries = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in wanted["q"]]
    together = np.concatenate(queries)
    homes = list(zip(wanted["block"].to_pylist(), wanted["place"].to_pylist()))
    held: list[list[tuple]] = [[] for _ in queries]
    for b in range(given.num_rows):
        block, ids = given["block"][b].as_py(), given["ids"][b].values.to_pylist()
        sizes, flat = _opened(given["lengths"][b].as_py(), given["flat"][b].as_py())
        flat = exact(flat, together)[0]
        lists = postings(flat, sizes)
        for i, query in enumerate(queries):
            scores = accumulate(query.astype(flat.dtype), lists, len(sizes))
            own = homes[i][1] if homes[i][0] == block else -1
            found = [(-scores[at], ids[at] is None, ids[at]) for at in best(scores, k + 1).tolist() if at != own]
            held[i] = sorted(held[i] + found, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
    return held
