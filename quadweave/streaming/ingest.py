"""Streams of statement lines applied to a draftset batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadweave.operators import lookup
from quadweave.schema import QUAD_COLS, QUADS
from quadweave.session import hadoop_path, stage
from quadweave.sources.quads import Parsed, assign_graph, graph_problems, parse_lines


def read_line_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files as they arrive in a folder, with the file they came from."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"))
    )


def parsed_batch(lines: DataFrame, graph: str | None = None) -> Parsed:
    """Quads and rejects of a batch. A bad line or graph goes to the rejects, the rest goes on."""
    parsed = parse_lines(lines, "value", F.col("_file") if "_file" in lines.columns else None, keep=stage)
    quads = assign_graph(parsed.quads, graph) if graph else parsed.quads
    bad = graph_problems(quads).select(F.concat_ws(" ", "s", "p", "o").alias("line"), "reason")
    good = quads.filter(F.col("g").isNotNull() & ~F.startswith("g", F.lit("_:")))
    return Parsed(good.select(*QUAD_COLS), parsed.rejects.unionByName(bad))


class Ledger:
    """Batches of quads kept in a folder until they are applied, and the number up to which they have been.

    A batch is a folder of its own, so one that runs again replaces itself; one that was already applied
    is skipped. What is applied together is one write, whatever the number of batches. Applying adds
    or removes whole quads of a set, so a failure between the write and its mark does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, apply: Callable[[DataFrame], None], every: int | None) -> None:
        self.spark, self.folder, self.apply, self.every = spark, folder, apply, every

    def _numbers(self, name: str) -> list[int]:
        folder, files = hadoop_path(self.spark, f"{self.folder}/{name}")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit())

    def applied(self) -> int:
        """Number of the last batch applied, -1 without any."""
        return max(self._numbers("applied"), default=-1)

    def pending(self) -> list[int]:
        done = self.applied()
        return [n for n in self._numbers("batches") if n > done]

    def take(self, quads: DataFrame, batch_id: int) -> None:
        if batch_id <= self.applied():
            return
        quads.select(*QUAD_COLS).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")
        if self.every and len(self.pending()) >= self.every:
            self.flush()

    def flush(self) -> int:
        """Apply what is pending in one write; returns the number of batches."""
        waiting = self.pending()
        if not waiting:
            return 0
        self.apply(lookup.kept(self.spark.read.schema(QUADS).parquet(*[f"{self.folder}/batches/{n}" for n in waiting])))
        before = self._numbers("applied")
        mark, files = hadoop_path(self.spark, f"{self.folder}/applied/{waiting[-1]}")
        files.create(mark, True).close()
        for name in [*[f"batches/{n}" for n in self._numbers("batches") if n <= waiting[-1]], *[f"applied/{n}" for n in before]]:
            old, _ = hadoop_path(self.spark, f"{self.folder}/{name}")
            files.delete(old, True)
        return len(waiting)


class Ingest:
    """A streaming query and its ledger; when it ends, also by an error, what has arrived is applied."""

    def __init__(self, query: StreamingQuery, ledger: Ledger) -> None:
        self.query, self.ledger = query, ledger

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        try:
            ended = self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()
        finally:
            if not self.query.isActive:
                self.ledger.flush()
        return ended

    def stop(self) -> None:
        self.query.stop()
        self.ledger.flush()


def run(
    lines: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    graph: str | None = None,
    rejects_path: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Apply each micro-batch with ``apply(quads, batch_id)``.

    Quads are sets and every write carries whole quads, so a batch that runs again after a failure
    changes nothing; rejects are written under their batch number for the same reason.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        parsed = parsed_batch(batch, graph)
        if rejects_path:
            parsed.rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        apply(parsed.quads, batch_id)

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _gathered(lines: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, every: int | None, once: bool, options: dict) -> Ingest:
    ledger = Ledger(lines.sparkSession, f"{checkpoint}-ledger", write, every if every or once else 1)
    return Ingest(run(lines, ledger.take, checkpoint, once=once, **options), ledger)


def append_stream(lines: DataFrame, workspace, draftset: str, checkpoint: str, every: int | None = None, once: bool = False, **options) -> Ingest:
    """Append what arrives: after every batch, after ``every`` batches, or with ``once`` when all that is there has been read."""
    return _gathered(lines, lambda quads: workspace.append(draftset, quads), checkpoint, every, once, options)


def delete_stream(lines: DataFrame, workspace, draftset: str, checkpoint: str, every: int | None = None, once: bool = False, **options) -> Ingest:
    """Delete what arrives; see :func:`append_stream`."""
    return _gathered(lines, lambda quads: workspace.delete(draftset, quads), checkpoint, every, once, options)


def modified_rollup(stamped: DataFrame, time: str = "ts", late: str | None = None, window: str = "1 day") -> DataFrame:
    """Latest time per graph; on a stream, run it in update mode.

    With ``late``, the state of a graph is kept per ``window`` of time and forgotten once the watermark is
    past it; the latest time of a graph is then that of its last window. Without, state grows with the
    number of graphs alone.
    """
    if late is None:
        return stamped.groupBy("g").agg(F.max(time).alias("modified"))
    marked = stamped.withWatermark(time, late)
    return marked.groupBy("g", F.window(time, window)).agg(F.max(time).alias("modified")).drop("window")
