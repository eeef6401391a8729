"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by hash, form one stream of words, read again from its start when it
ends. The stream is cut into blocks of equal length, and a schedule says which source's next block
comes in which slot of the mix: the golden-ratio points ``n * a mod M``, with ``a`` next to M / phi and
coprime to the number of slots M, are mapped through the sources' cumulative numbers of blocks. The
points are a permutation of 0..M-1, so every source gets exactly the blocks it needs, and any stretch
of the mix holds nearly its share of every source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import pick_rows, running, whole, word_count
from quadweave.session import stage

#: Words in a block.
BLOCK = 1024
#: Cells of the grid through which points meet sources, upper bits that split a source's shuffled
#: documents, and slots ranked in one task.
GRID, STREAM_PARTS, RANK_SLOTS = 4096, 4096, 1 << 18
PHI = (1 + math.sqrt(5)) / 2


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes; no
    target passes ``most`` times its source's size, and what that cuts off is shared by weight among
    the others until none is above. That fixed point is one water level: with sources in the order of
    size / weight, those below the level get their limit and the rest their weight's share of what is
    left. One row per source is put in order, never one per document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighed = sizes.withColumn("_w", F.element_at(cycle, turn.cast("int")))
    weighed = weighed.withColumns({"_cap": F.col("source_size") * most, "_all": F.sum("source_size").over(Window.partitionBy())})
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("_all") * share - F.coalesce(F.sum("_cap").over(below), F.lit(0))
    weighed = weighed.withColumn("_level", left / F.sum("_w").over(onward))
    # The level is that of the first source whose limit is not below it; later ones are lower.
    level = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(Window.partitionBy())
    share_of = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return weighed.withColumn("target", share_of).select("source", "source_size", "target")


def _stride(slots: int) -> int:
    """The number next to slots / phi that is coprime to ``slots``."""
    middle = round(slots / PHI)
    for step in range(slots + 1):
        for x in (middle + step, middle - step):
            if 0 < x and math.gcd(x, slots) == 1:
                return x
    return 1


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, turn, length): which source's next block comes in which slot.

    ``turn`` counts a source's blocks from 0; every block has ``block`` words but a source's last,
    which ends at its target, rounded to whole words.
    """
    spark = plan.sparkSession
    needs = plan.withColumn("_words", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * 2)))
    needs = needs.withColumn("_blocks", F.ceil(F.col("_words") / block).cast("long")).filter("_blocks > 0")
    order = Window.orderBy(F.col("source").isNull(), "source")
    needs = needs.withColumn("_to", F.sum("_blocks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    needs = needs.withColumn("_from", F.col("_to") - F.col("_blocks")).select("source", "_words", "_from", "_to")
    slots = needs.agg(F.max("_to")).first()[0] or 0
    wide = lambda x: F.lit(x).cast("decimal(19,0)")
    point = (F.col("slot").cast("decimal(19,0)") * wide(_stride(slots)) % wide(max(slots, 1))).cast("long")
    cell = lambda at: (at.cast("decimal(19,0)") * wide(GRID) / wide(max(slots, 1))).cast("decimal(38,9)")
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("_point", point)
    points = points.withColumn("_cell", F.floor(cell(F.col("_point"))).cast("long"))
    first, last = F.floor(cell(F.col("_from"))).cast("long"), F.floor(cell(F.col("_to") - 1)).cast("long")
    spans = needs.withColumn("_cell", F.explode(F.sequence(first, last)))
    inside = (F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))
    mapped = points.join(spans, "_cell").filter(inside).select("slot", "source", "_words")
    ranked = running(mapped, ["source"], F.shiftright("slot", RANK_SLOTS.bit_length() - 1), [F.col("slot")], F.lit(1).cast("long"), "turn")
    length = F.least(F.lit(block).cast("long"), F.col("_words") - F.col("turn") * block)
    return ranked.select("slot", "source", "turn", length.alias("length"))


def streams(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, size, mixed, at): each document's place in its source's shuffled stream of words.

    ``mixed`` is the hash that shuffles.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(whole(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("mixed"),
    )
    part = F.shiftrightunsigned("mixed", 64 - (STREAM_PARTS.bit_length() - 1))
    order = [F.col("mixed"), F.col("doc_id"), F.col("size")]
    return running(slim, ["source"], part, order, F.col("size"), "at")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, streams, targets) of a mix of ``docs``.

    A piece (slot, source, at, lap, first, words) says that in a slot of the mix come ``words`` words of
    the document that starts at word ``at`` of its source's stream, from its word ``first`` on, in the
    first or second reading (``lap``) of the stream. A null text has no words and no pieces; null
    sources are a source of their own, last in order; repeated rows have places of their own. The
    order is that of a hash of the seed, the identifier and the text, so reruns agree. The texts are read
    once; the streams stand in the shared folder.
    """
    placed = stage(streams(docs, text, doc_id, source, seed))
    plan = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    slots = schedule(plan, block).select(F.col("source").alias("_s"), "turn", "slot", "length")
    sizes = plan.select(F.col("source").alias("_of"), "source_size")
    begin = F.col("at") + F.col("lap") * F.col("source_size")
    laid = placed.filter("size > 0").join(sizes, F.col("source").eqNullSafe(F.col("_of")))
    laid = laid.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>"))).withColumn("_begin", begin)
    laid = laid.withColumn("_end", F.col("_begin") + F.col("size"))
    turns = F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block))
    cut = laid.withColumn("_turn", F.explode(turns))
    hit = cut.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_turn") == F.col("turn")))
    start = F.greatest(F.col("_begin"), F.col("turn") * block)
    words = F.least(F.col("_end"), F.col("turn") * block + F.col("length")) - start
    pieces = hit.select("slot", "source", "at", "lap", (start - F.col("_begin")).alias("first"), words.alias("words"))
    return pieces.filter("words > 0"), placed, plan


def taken(pieces: DataFrame, placed: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, source, mixed, size, source_size, target, taken and full for every document.

    ``full`` is the number of readings in which at least half of the document's words are taken.
    """
    laps = pieces.groupBy("source", "at", "lap").agg(F.sum("words").alias("_lap_words"))
    per = laps.groupBy("source", "at").agg(F.sum("_lap_words").alias("taken"), F.collect_list("_lap_words").alias("_laps"))
    per = per.select(F.col("source").alias("_s"), F.col("at").alias("_a"), "taken", "_laps")
    mine = (F.col("size") > 0) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_a"))
    sums = plan.select(F.col("source").alias("_of"), "source_size", "target")
    both = placed.join(per, mine, "left").join(sums, F.col("source").eqNullSafe(F.col("_of")), "left")
    full = F.size(F.filter(F.coalesce("_laps", F.array().cast("array<long>")), lambda x: x * 2 >= F.col("size")))
    return both.select(
        "doc_id", "source", "mixed", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), full.alias("full")
    )


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each once for every reading that takes at least half of its words.

    Of rows that repeat identifier, text and source, one stands for all, as often as they all are taken.
    """
    found = taken(*mix(docs, weights, share, text, doc_id, source, seed=seed))
    copies = found.groupBy("doc_id", "source", "mixed").agg(F.sum("full").cast("int").alias("copies")).filter("copies > 0")
    marked = pick_rows(
        docs, copies, [F.col(doc_id), F.col(source), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))], ["doc_id", "source", "mixed"], "copies"
    )
    return marked.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
