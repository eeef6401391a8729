"""Differences between two sets of quads, read row by row only where order-free digests differ.

The digest of a part is the number of its quads and two sums of their hashes. Sums are mergeable, so a
part of any size is summed map-side, and no quad is shuffled to learn that two stores are equal. Parts are
ranges of hashed subjects within a graph: of a huge graph with one changed quad one range is compared.
Equal digests of different quads would need two 64-bit sums to agree; what is compared is compared by
whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.operators import lookup
from quadweave.schema import QUAD_COLS, SUBJECT_COLS

#: Ranges a graph is cut into.
RANGES = 256
_PART = ["g", "_range"]


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64(*SUBJECT_COLS), F.lit(ranges)).cast("int")


def digests(quads: DataFrame, *parts: str) -> DataFrame:
    """(parts, n, h1, h2): the digest of each part, in one aggregate."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *QUAD_COLS).cast("decimal(20,0)"))
    return quads.groupBy(*parts).agg(F.count("*").alias("n"), wide(1).alias("h1"), wide(2).alias("h2"))


def unequal(a: DataFrame, b: DataFrame, *parts: str) -> DataFrame:
    """The parts whose digests differ, also those that only one side has."""
    sides = digests(a, *parts).unionByName(digests(b, *parts).select(*parts, *[(-F.col(c)).alias(c) for c in ("n", "h1", "h2")]))
    left = sides.groupBy(*parts).agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    return left.filter("n <> 0 or h1 <> 0 or h2 <> 0").select(*parts)


def gaps(a: DataFrame, b: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Quads that only one of two sets has, with ``side`` 1 (only ``a``) or -1 (only ``b``)."""
    a, b = (x.select(*QUAD_COLS).withColumn("_range", _range(ranges)) for x in (a, b))
    parts = lookup.once(unequal(a, b, *_PART))
    graphs = lookup.local(parts.select("g").distinct())
    sides = []
    for quads, sign in ((a, 1), (b, -1)):
        inside = _within(lookup.keep(quads, graphs), parts)
        sides.append(inside.select(*QUAD_COLS, F.lit(sign).alias("_n")))
    summed = sides[0].unionByName(sides[1]).groupBy(*QUAD_COLS).agg(F.sum("_n").cast("int").alias("side"))
    return summed.filter("side <> 0")


def _within(quads: DataFrame, parts: DataFrame) -> DataFrame:
    """Quads of the parts named: by literals if they are few, else by a semi join."""
    if hasattr(parts, "_rows") and len(parts._rows) <= lookup.PUSHDOWN_KEYS:
        keys = [f"{r}|{g}" for g, r in parts._rows]
        return quads.filter(F.concat_ws("|", F.col("_range").cast("string"), F.col("g")).isin(keys))
    side = F.broadcast(parts) if lookup.is_small(parts) else parts
    return quads.join(side, _PART, "left_semi")


def minus(a: DataFrame, b: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Quads of the set ``a`` that the set ``b`` has not, like :func:`lookup.minus` for stores that differ little."""
    return gaps(a, b, ranges).filter("side = 1").select(*QUAD_COLS)
