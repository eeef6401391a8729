"""Sharding by longest-processing-time scheduling: whole groups, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm.common import fill_rank, whole
from quadweave.schema import local_table

#: Light groups are scheduled in so many bundles per shard; a group above the mean bundle is scheduled alone.
BUNDLES_PER_SHARD = 1024
#: About so many rows are ranked in one task.
RANK_ROWS = 250_000


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Items by falling size (ties by name), each to the shard with the least load (ties: the lowest)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", bundles: int = BUNDLES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    The size of a row is the bytes of its text (null: none) plus 8; rows with equal texts form a group
    that stays in one shard (null is a text of its own), and the law is ``bytes``: sizes near equal.
    Slots run from 0 in each shard, and ``grown_shard`` is null: only placing by key has one.

    Groups larger than total / (shards * bundles) are scheduled one by one: there are fewer than shards *
    bundles of them, by their size. All other groups fall into shards * bundles bundles by the hash of
    their text, and the bundles are scheduled with them. So the heap works on at most twice shards *
    bundles items however many rows there are, and the difference between shards stays within about one
    bundle. Slots come from counts of (shard, part) and a rank in each part, so no task ranks a whole
    shard. Repeated rows get slots of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(whole(text)).alias("text_crc32"),
        F.when(F.col(text).isNull(), "null").otherwise(F.sha2(text, 256)).alias("group"),
    )
    limit = shards * bundles
    bundle = F.pmod(F.xxhash64("group"), F.lit(limit))
    groups = slim.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    total = slim.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    heavy = F.col("size") * limit > (total.size or 0)
    item = F.when(heavy, F.col("group")).otherwise(bundle.cast("string"))
    items = groups.groupBy(item.alias("item")).agg(F.sum("size").alias("size")).collect()
    placed = schedule([(r["item"], r["size"]) for r in items], shards)
    alone = [(k, s) for k, s in placed.items() if not k.isdigit() or len(k) == 64]
    bundled = [(int(k), s) for k, s in placed.items() if k.isdigit() and len(k) < 64]
    heavy_side = F.broadcast(local_table(spark, alone, T.StructType.fromDDL("_group string, _alone int")))
    light_side = F.broadcast(local_table(spark, bundled, T.StructType.fromDDL("_bundle long, _bundled int")))
    placed_rows = (
        slim.join(heavy_side, F.col("group") == F.col("_group"), "left")
        .join(light_side, bundle == F.col("_bundle"), "left")
        .withColumn("shard", F.coalesce("_alone", "_bundled"))
    )
    parts = max(1, -(-total.rows // (RANK_ROWS * shards)))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    slim = placed_rows.select("doc_id", "size", "text_crc32", "group", "shard")
    ranked = fill_rank(slim, "shard", part, [F.col("doc_id"), F.col("group")], "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
