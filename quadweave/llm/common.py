"""Column helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The characters that separate words, for Java patterns and for translate().
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words, without making an array of them: every word ends before white space or the end."""
    pieces = F.size(F.split(text, WHITE + "+"))
    edges = text.rlike(r"\A" + WHITE).cast("int") + text.rlike(WHITE + r"\z").cast("int")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(pieces - edges).cast("long")


def others(docs: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``docs`` that are none of ``names``, out of its rows packed as ``row``."""
    taken = {n.lower() for n in names}
    return [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in taken]


def _key(values: list[Column]) -> Column:
    """Values as one string: different values, nulls among them, give different strings."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in text])


def pick_rows(docs: DataFrame, keys: DataFrame, own: list[Column], names: list[str], *extra: str) -> DataFrame:
    """One row of ``docs``, packed as ``row``, with ``extra`` columns of ``keys`` for each row of ``keys``.

    ``own`` are expressions over ``docs`` that match the columns ``names`` of ``keys``, nulls with
    nulls; of rows that agree in them one is taken. The text is shuffled once: the key that brings rows
    to their keys is the one they are numbered by.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(own).alias("own"))
    keys = keys.select(_key([F.col(n) for n in names]).alias("key"), *extra)
    first = F.row_number().over(Window.partitionBy("own").orderBy("own"))
    return rows.join(keys, F.col("own") == F.col("key")).withColumn("first", first).filter("first = 1").select("row", *extra)


def fill_rank(df: DataFrame, group: str, part: Column, order: list[Column], name: str) -> DataFrame:
    """Adds a gapless rank from 0 within ``group``; no window holds more than one ``part`` of a group.

    ``part`` must be monotone in the order wanted (or the order between parts be of no interest).
    Only the counts of (group, part) are put in order across parts.
    """
    return running(df, [group], part, order, F.lit(1).cast("long"), name)


def running(df: DataFrame, group: list[str], part: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows of ``group`` that come before a row.

    Rows come in the order of ``part``, then ``order``. A group of any size is summed by parts:
    totals of the parts first, then within each part.
    """
    df = df.withColumn("_part", part).withColumn("_amount", amount)
    keys = [*group, "_part"]
    totals = df.groupBy(*keys).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    bases = bases.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_own", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = summed.join(bases, match, "left")
    drop = ["_part", "_amount", "_own", "_base", *[f"_k{i}" for i in range(len(keys))]]
    return joined.withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop(*drop)
