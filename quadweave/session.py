"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Sizing rule: about 128 MB per shuffle partition after AQE coalescing. The initial partition
# number is only an upper bound for AQE, so clusters should set it to a few times their cores.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


_STAGED: list[str] = []
_TABLES: list[str] = []


def build_session(app: str = "quadweave", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if context.master.startswith("local"):
        local = tempfile.mkdtemp(prefix="quadweave-")
        spark.conf.set("spark.checkpoint.dir", local)
        return local
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: its lineage ends there.

    It is computed once, survives lost executors, and is read columnar. A checkpoint would compute
    the last stage twice. The files stay until :func:`release` removes them.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4()}"
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owned(path: str | None = None, table: str | None = None) -> None:
    """A folder or table that :func:`release` removes like staged ones."""
    _STAGED.extend([path] if path else [])
    _TABLES.extend([table] if table else [])


def release(spark: SparkSession) -> int:
    """Remove all that :func:`stage` has written since the last call; results not yet read from it are lost.

    For the end of a unit of work whose results are written. Returns the number of folders.
    """
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{_TABLES.pop()}`")
    paths = [_STAGED.pop() for _ in range(len(_STAGED))]
    for path in paths:
        folder, files = hadoop_path(spark, path)
        files.delete(folder, True)
    return len(paths)


def send_package(spark: SparkSession) -> None:
    """Send this package, once a context, to executors that may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quadweave_sent", False):
        return
    root = Path(__file__).parent
    package = Path(tempfile.mkdtemp(prefix="quadweave-code-")) / "quadweave.zip"
    with zipfile.ZipFile(package, "w") as made:
        for file in sorted(root.rglob("*.py")):
            made.write(file, file.relative_to(root.parent))
    context.addPyFile(str(package))
    context._quadweave_sent = True


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, of whatever kind."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())
