"""Which versioned artefacts to keep: a manifest ``(hash, file, livemod, draftmod, size_bytes, last_access)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quadweave.operators import quantiles
from quadweave.session import stage

# Fixed value: file names are livemod[-draftmod][_version][.ext], "empty" standing for no livemod.
_NAME = r"^(empty|[0-9]+)(?:-([0-9]+))?(?:_[^.]*)?(?:\.[^.]*)?$"
FANOUT = 4096


def parse_names(files: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(files with livemod and draftmod, rejects)."""
    good = F.col(name).rlike(_NAME)
    live = F.regexp_extract(name, _NAME, 1)
    draft = F.regexp_extract(name, _NAME, 2)
    parsed = files.filter(good).withColumns(
        {
            "livemod": F.when(live != "empty", live).try_cast("bigint"),
            "draftmod": F.when(draft != "", draft).try_cast("bigint"),
        }
    )
    return parsed, files.filter(~good | F.col(name).isNull())


def _latest_drafts(manifest: DataFrame) -> DataFrame:
    """Per hash the newest livemod and the newest draftmod on it: two aggregates, combined map-side."""
    per_live = manifest.groupBy("hash", "livemod").agg(F.max("draftmod").alias("_draft"))
    # max_by ignores NULL ordering values, so "no livemod" ranks below every time.
    rank = F.coalesce(F.col("livemod"), F.lit(-1).cast("bigint"))
    return per_live.groupBy("hash").agg(
        F.max("livemod").alias("_live"), F.max_by("_draft", rank).alias("_draft")
    )


def with_expiry(manifest: DataFrame) -> DataFrame:
    """Adds ``expired``: not on the newest livemod of its hash, or a draft older than its newest draft."""
    joined = manifest.join(_latest_drafts(manifest), "hash")
    current = F.col("livemod").eqNullSafe(F.col("_live")) & (
        F.col("draftmod").isNull() | (F.col("draftmod") == F.col("_draft"))
    )
    return joined.withColumn("expired", ~F.coalesce(current, F.lit(False))).drop("_live", "_draft")


def expired(manifest: DataFrame) -> DataFrame:
    return with_expiry(manifest).filter("expired").drop("expired")


def total_size(manifest: DataFrame) -> int:
    return manifest.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n")).first().n


def _crossing(df: DataFrame, key: Column, wanted: int) -> tuple[int, int] | None:
    """(k, sum of sizes before k): the key value in ascending order where the running size reaches ``wanted``.

    Narrows the range of keys ``FANOUT`` at a time: each pass is one aggregate with at most
    ``FANOUT`` result rows, so no task ever sees a whole running total.
    """
    keyed = df.select(key.alias("k"), "size_bytes")
    bounds = keyed.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if bounds.lo is None:
        return None
    lo, hi, before = bounds.lo, bounds.hi, 0
    while True:
        width = (hi - lo) // FANOUT + 1
        bucket = F.floor((F.col("k") - F.lit(lo)) / F.lit(width)).cast("bigint")
        if width > 1:
            bucket = F.expr(f"(k - {lo}) div {width}")
        sums = (
            keyed.filter(F.col("k").between(lo, hi))
            .groupBy(bucket.alias("b"))
            .agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n"))
            .orderBy("b")
            .collect()
        )
        for row in sums:
            if before + row.n >= wanted:
                lo, hi = lo + row.b * width, min(hi, lo + (row.b + 1) * width - 1)
                break
            before += row.n
        else:
            return None
        if lo == hi:
            return lo, before


def _tie_rank(file: Column) -> Column:
    """60 bits of a hash: a fixed order among files with the same access time."""
    return F.conv(F.substring(F.md5(file), 1, 15), 16, 10).cast("bigint")


def oldest_to_free(manifest: DataFrame, wanted: int, file: str = "file") -> DataFrame:
    """Oldest files by last access, just enough to free ``wanted`` bytes; the file that crosses is included.

    Files with equal access time are taken in the order of a hash of their name. One pass makes a
    digest of sizes over (time, hash); a second one sums what is surely freed and writes the few
    files between which the total crosses. Files of unknown time go only when all do.
    """
    if wanted <= 0:
        return manifest.limit(0)
    time, rank = F.col("last_access").cast("bigint"), _tie_rank(F.col(file))
    between = quantiles.interval(quantiles.digest(manifest, time, rank, F.col("size_bytes")), wanted)
    if between is None:
        return manifest
    low, high = between
    below, inside = ~quantiles.beyond(time, rank, low), quantiles.beyond(time, rank, low) & ~quantiles.beyond(time, rank, high)
    sure = Observation()
    size = F.coalesce(F.sum(F.when(below, F.col("size_bytes"))), F.lit(0)).cast("bigint")
    cell = stage(manifest.observe(sure, size.alias("n")).filter(inside))
    key, left = _crossing_key(cell, time, rank, wanted - sure.get["n"])
    return manifest.filter(below).unionByName(_through(cell, time, rank, key, left, file))


def _crossing_key(cell: DataFrame, time: Column, rank: Column, wanted: int) -> tuple[tuple[int, int], int]:
    """(key that crosses, bytes still wanted at it) among the few files of a cell."""
    when, before = _crossing(cell, time, wanted)
    last, freed = _crossing(cell.filter(time == when), rank, wanted - before)
    return (when, last), wanted - before - freed


def _through(cell: DataFrame, time: Column, rank: Column, key: tuple[int, int], wanted: int, file: str) -> DataFrame:
    """The files of a cell before a key, and those of it, by name, until ``wanted`` bytes are freed.

    Names whose hashes collide are the only rows put in order.
    """
    own = (time == key[0]) & (rank == key[1])
    previous = Window.partitionBy("_rank").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    edge = cell.filter(own).withColumn("_rank", rank).withColumn("_freed", F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))).over(previous), F.lit(0)))
    edge = edge.filter(F.col("_freed") < F.lit(wanted)).drop("_rank", "_freed")
    return cell.filter(~quantiles.beyond(time, rank, key) & ~own).unionByName(edge)


def removal_plan(manifest: DataFrame, archive_at: int, archive_until: int, file: str = "file") -> DataFrame:
    """Files to remove, with ``reason`` expired or old.

    Nothing up to ``archive_at`` bytes. Beyond it all expired files go, and if that does not get
    below ``archive_until``, the oldest others as well.
    """
    if not 0 <= archive_until <= archive_at:
        raise ValueError("0 <= archive_until <= archive_at")
    flagged = stage(with_expiry(manifest))
    sizes = flagged.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("expired"), F.col("size_bytes"))), F.lit(0)).alias("expired"),
    ).first()
    none = manifest.limit(0).withColumn("reason", F.lit(""))
    if sizes.total <= archive_at:
        return none
    plan = flagged.filter("expired").drop("expired").withColumn("reason", F.lit("expired"))
    if archive_until <= sizes.total - sizes.expired:
        rest = flagged.filter(~F.col("expired")).drop("expired")
        old = oldest_to_free(rest, sizes.total - archive_until - sizes.expired, file)
        plan = plan.unionByName(old.withColumn("reason", F.lit("old")))
    return plan


def past_ttl(archived: DataFrame, now_millis: int, ttl_millis: int, moved_at: str = "moved_at") -> DataFrame:
    """Archived files moved before the cut-off."""
    return archived.filter(F.col(moved_at) < F.lit(now_millis - ttl_millis))
