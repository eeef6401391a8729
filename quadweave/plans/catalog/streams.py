"""Streams of statement lines applied to drafts, and the roll-up of modified times."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadweave.plans import fixtures as fx
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import P, sql
from quadweave.plans.workspace import Workspace
from quadweave.session import shared_folder
from quadweave.sources import sinks
from quadweave.streaming import ingest

FILES_PER_BATCH = 2


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def _line_files(quads, path: str):
    """Statement lines in as many files as the table has partitions, and one with a line that is no statement."""
    broken = quads.sparkSession.range(1).select(F.lit("this is no statement").alias("value"))
    lines = sinks.quad_lines(quads).unionByName(broken)
    lines.write.text(path)
    return path


def _workspace(spark) -> tuple[Workspace, str]:
    space = Workspace(spark, buckets=16, clock=lambda: fx.NOW)
    return space, space.create_draftset("ann", "Streamed")


@register("k1_streamed_append", sql("SELECT g, s, p, o FROM live_q"))
def streamed_append(spark, sf_dir):
    """Published orders streamed into a draft; the bad line goes to the rejects."""
    quads = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    folder = _folder(spark)
    space, draftset = _workspace(spark)
    lines = ingest.read_line_stream(spark, _line_files(quads, f"{folder}/in"), FILES_PER_BATCH)
    ingest.append_stream(lines, space, draftset, f"{folder}/checkpoint", rejects_path=f"{folder}/rejects", once=True).awaitTermination()
    if spark.read.parquet(f"{folder}/rejects").count() != 1:
        raise AssertionError("one line should have been rejected")
    return space.view(draftset).select("g", "s", "p", "o")


@register("k2_streamed_delete", sql("SELECT g, s, p, o FROM live_q WHERE p NOT IN ('http://example.com/p/status', 'http://example.com/p/date')"))
def streamed_delete(spark, sf_dir):
    quads = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    folder = _folder(spark)
    space, draftset = _workspace(spark)
    space.append(draftset, quads)
    gone = quads.filter(F.col("p").isin(P + "status", P + "date"))
    lines = ingest.read_line_stream(spark, _line_files(gone, f"{folder}/in"), FILES_PER_BATCH)
    ingest.delete_stream(lines, space, draftset, f"{folder}/checkpoint", once=True).awaitTermination()
    return space.view(draftset).select("g", "s", "p", "o")


@register("k3_streamed_times", "SELECT 'http://example.com/graph/'||(user_id % 40) AS g, epoch_us(max(ts)) AS modified FROM events GROUP BY ALL")
def streamed_times(spark, sf_dir):
    """Latest event per graph, updated batch by batch."""
    folder = _folder(spark)
    schema = fx.read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    stamped = events.select(fx.graph_iri(F.col("user_id") % 40).alias("g"), F.col("ts").cast("timestamp").alias("ts"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/times/batch={batch_id}")

    rolled = ingest.modified_rollup(stamped).writeStream.outputMode("update").foreachBatch(keep)
    rolled.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    times = spark.read.parquet(f"{folder}/times").groupBy("g").agg(F.max("modified").alias("modified"))
    return times.select("g", F.unix_micros("modified").alias("modified"))


