"""Retention of versioned artefacts; the manifest is derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.operators import retention
from quadweave.plans import fixtures as fx
from quadweave.plans.catalog import register

HOUR = 3_600_000


def manifest(spark, sf_dir):
    """One artefact per event: hash per user, livemod per day, some drafts, access times with ties."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return fx.read(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hash"),
        F.concat(F.lit("f"), k.cast("string")).alias("file"),
        F.when(k % 13 != 0, (F.floor(millis / (HOUR * 240))) * (HOUR * 240)).alias("livemod"),
        F.when(k % 3 == 0, F.floor(millis / HOUR) * HOUR).alias("draftmod"),
        (1000 + k % 977).alias("size_bytes"),
        (F.floor(millis / (HOUR * 24)) * (HOUR * 24)).alias("last_access"),
    )


_MANIFEST = f"""
WITH manifest AS (SELECT 'h'||user_id AS hash, 'f'||event_id AS file,
  CASE WHEN event_id % 13 <> 0 THEN (epoch_us(ts) // 1000) // {HOUR * 240} * {HOUR * 240} END AS livemod,
  CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000) // {HOUR} * {HOUR} END AS draftmod,
  1000 + event_id % 977 AS size_bytes, (epoch_us(ts) // 1000) // {HOUR * 24} * {HOUR * 24} AS last_access FROM events),
latest AS (SELECT hash, max(livemod) AS live FROM manifest GROUP BY hash),
flagged AS (SELECT m.*, NOT (m.livemod IS NOT DISTINCT FROM l.live AND (m.draftmod IS NULL OR m.draftmod =
  (SELECT max(x.draftmod) FROM manifest x WHERE x.hash = m.hash AND x.livemod IS NOT DISTINCT FROM l.live))) AS expired FROM manifest m JOIN latest l USING (hash)),
total AS (SELECT sum(size_bytes) AS n, coalesce(sum(size_bytes) FILTER (expired), 0) AS gone FROM flagged)
"""
_OLDEST = "sum(size_bytes) OVER (ORDER BY last_access, md5(file) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("e1_expired_versions", _MANIFEST + "SELECT file FROM flagged WHERE expired")
def expired_versions(spark, sf_dir):
    return retention.expired(manifest(spark, sf_dir)).select("file")


@register(
    "e2_oldest_to_free",
    _MANIFEST + f"SELECT file FROM (SELECT file, coalesce({_OLDEST}, 0) AS before FROM manifest) WHERE before < (SELECT n // 3 FROM total)",
)
def oldest_to_free(spark, sf_dir):
    """The oldest files holding a third of all bytes."""
    rows = manifest(spark, sf_dir)
    return retention.oldest_to_free(rows, retention.total_size(rows) // 3).select("file")


@register(
    "e3_removal_plan",
    _MANIFEST
    + f"""SELECT file, 'expired' AS reason FROM flagged WHERE expired
    UNION ALL SELECT file, 'old' FROM (SELECT file, coalesce({_OLDEST}, 0) AS before FROM flagged WHERE NOT expired)
    WHERE before < (SELECT n - n // 20 - gone FROM total) AND (SELECT n // 20 <= n - gone FROM total)""",
)
def removal_plan(spark, sf_dir):
    """Beyond half of the present size, shrink to a twentieth of it."""
    rows = manifest(spark, sf_dir)
    size = retention.total_size(rows)
    return retention.removal_plan(rows, size // 2, size // 20).select("file", "reason")


@register("e4_past_ttl", _MANIFEST + f"SELECT file FROM manifest WHERE last_access < {1704067200000 + 20 * 24 * HOUR} - {10 * 24 * HOUR}")
def past_ttl(spark, sf_dir):
    now = 1_704_067_200_000 + 20 * 24 * HOUR
    return retention.past_ttl(manifest(spark, sf_dir), now, 10 * 24 * HOUR, moved_at="last_access").select("file")


@register(
    "e5_version_file_names",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS livemod,
    CASE WHEN event_id % 4 = 2 THEN epoch_us(ts) // 1000 + 5 END AS draftmod, event_id % 4 = 3 AS rejected FROM events""",
)
def version_file_names(spark, sf_dir):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    name = (
        F.when(k % 4 == 0, F.lit("empty_1a2b.json"))
        .when(k % 4 == 1, F.concat(millis.cast("string"), F.lit(".srj")))
        .when(k % 4 == 2, F.concat(millis.cast("string"), F.lit("-"), (millis + 5).cast("string"), F.lit("_ab-cd")))
        .otherwise(F.lit("notes.txt"))
    )
    files = fx.read(spark, sf_dir, "events").select("event_id", name.alias("file_name"))
    good, bad = retention.parse_names(files)
    none = F.lit(None).cast("bigint")
    return good.select("event_id", "livemod", "draftmod", F.lit(False).alias("rejected")).unionByName(
        bad.select("event_id", none.alias("livemod"), none.alias("draftmod"), F.lit(True).alias("rejected"))
    )
