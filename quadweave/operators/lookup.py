"""Joins against key lists and term dictionaries, broadcast only when their measured size allows.

A dictionary of graph names is usually tiny next to the quads, but nothing guarantees it. Every
helper here measures the small side first, reading at most ``BROADCAST_ROWS + 1`` row sizes of it:

* up to ``LOCAL_ROWS`` rows become a local relation, so the dictionary is computed once however
  often the plan uses it, and Catalyst knows its exact size; up to ``PUSHDOWN_KEYS`` of these are
  literals of one projection or filter, without any join;
* up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes are broadcast;
* beyond that, it is a plain shuffle join, with the dictionary on the side that is repeated: adaptive
  execution cuts the partition of a hot graph, subject or predicate into as many tasks as its size
  asks for, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.schema import GRAPH_REF_POSITIONS, IRI, QUAD_COLS, local_table
from quadweave.session import stage
from quadweave.sources.quads import deal

LOCAL_ROWS = 2_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
PUSHDOWN_KEYS = 200
#: Parts to which Spark deals rows as they come; for more, a task that reads first sorts its rows in memory.
UNSORTED_PARTS = 200
_PLAIN = (T.StringType, T.BooleanType, T.IntegerType, T.LongType)


def _row_size(df: DataFrame) -> Column:
    names = [f.name.replace("`", "``") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return F.expr(" + ".join(["16", *[f"coalesce(octet_length(`{n}`), 0)" for n in names]]))


def settle(df: DataFrame) -> tuple[DataFrame, bool]:
    """(``df``, is it small enough to broadcast?); a very small one comes back as a local relation.

    Reading stops as soon as a bound is passed.
    """
    if _is_local(df):
        return df, True
    fetched = _fetch(df)
    return (df, is_small(df)) if fetched is None else (_localise(df, fetched), True)


def _fetch(df: DataFrame) -> list[tuple] | None:
    """The rows, if at most ``LOCAL_ROWS``. A row far wider than the byte bound allows on average is
    not fetched at all."""
    if _is_local(df):
        return df._rows
    if not all(isinstance(f.dataType, _PLAIN) for f in df.schema.fields):
        raise TypeError("only text, boolean and integer columns can be settled")
    narrow = _row_size(df) <= BROADCAST_BYTES // max(LOCAL_ROWS, 1)
    row = F.when(narrow, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    fetched = df.select(row.alias("row")).limit(LOCAL_ROWS + 1).collect()
    if len(fetched) > LOCAL_ROWS or any(r.row is None for r in fetched):
        return None
    return [tuple(r.row) for r in fetched]


def is_small(df: DataFrame) -> bool:
    """Within the bounds for a broadcast? Reads lengths only, and no more rows than the bound."""
    known = getattr(df, "_small", None)
    if known is None:
        sizes = df.select(_row_size(df).alias("n")).limit(BROADCAST_ROWS + 1)
        total = sizes.agg(F.count("*").alias("rows"), F.sum("n").alias("size")).first()
        known = df._small = total.rows <= BROADCAST_ROWS and (total.size or 0) <= BROADCAST_BYTES
    return known


def _localise(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return _held(df.sparkSession, rows, df.schema)


def _held(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    made = local_table(spark, rows, T.StructType(fields))
    made._settled, made._rows = True, rows
    return made


def local(df: DataFrame) -> DataFrame:
    """``df``, computed once and held as a local relation if it is very small."""
    if _is_local(df):
        return df
    fetched = _fetch(df)
    return df if fetched is None else _localise(df, fetched)


def join(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``a.join(b, on, how)`` (inner, left, left_semi, left_anti); two local relations meet without a job."""
    if not (_is_local(a) and _is_local(b)):
        return a.join(b, on, how)
    at, to = a.columns.index(on), b.columns.index(on)
    found: dict = {}
    for row in b._rows:
        if row[to] is not None:
            found.setdefault(row[to], []).append(row[:to] + row[to + 1 :])
    if how in ("left_semi", "left_anti"):
        return _localise(a, [r for r in a._rows if (r[at] in found) == (how == "left_semi")])
    none = [(None,) * (len(b.columns) - 1)] if how == "left" else []
    rows = [(r[at], *r[:at], *r[at + 1 :], *more) for r in a._rows for more in found.get(r[at], none)]
    rest = [f for f in a.schema.fields if f.name != on] + [T.StructField(f.name, f.dataType) for f in b.schema.fields if f.name != on]
    return _held(a.sparkSession, rows, T.StructType([a.schema[on], *rest]))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """``df.select(*columns)``; of a local relation without planning a query."""
    if not _is_local(df):
        return df.select(*columns)
    if list(columns) == df.columns:
        return df
    at = [df.columns.index(c) for c in columns]
    return _held(df.sparkSession, [tuple(r[i] for i in at) for r in df._rows], T.StructType([df.schema[c] for c in columns]))


def is_empty(df: DataFrame) -> bool:
    return not df._rows if _is_local(df) else df.limit(1).isEmpty()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a.unionByName(b)``; of two local relations one is made without a job."""
    if not (_is_local(a) and _is_local(b)):
        return a.unionByName(b)
    order = [b.columns.index(c) for c in a.columns]
    return _localise(a, [*a._rows, *[tuple(r[i] for i in order) for r in b._rows]])


def once(df: DataFrame) -> DataFrame:
    """``df``, computed once: a local relation if very small, else staged in the shared folder.

    For input that several passes read, such as a batch parsed from text.
    """
    if getattr(df, "_once", False) or _is_local(df):
        return df
    total = Observation()
    counted = df.observe(total, F.count(F.lit(1)).alias("rows"), F.sum(_row_size(df)).alias("size"))
    staged = stage(counted)
    rows, size = total.get["rows"], total.get["size"] or 0
    if rows <= LOCAL_ROWS:
        staged = local(staged)
    staged._once = True
    staged._small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return staged


def kept(df: DataFrame) -> DataFrame:
    """A table read from files that stay while it is used, as :func:`once` returns one, without another copy."""
    df = local(df)
    df._once = True
    return df


def _is_local(df: DataFrame) -> bool:
    return getattr(df, "_settled", False)


def translate(
    df: DataFrame,
    pairs: DataFrame,
    source: str,
    target: str,
    positions: Sequence[tuple[str, str | None]] = GRAPH_REF_POSITIONS,
    mark: str | None = None,
) -> DataFrame:
    """Replace every IRI found in ``pairs[source]`` by ``pairs[target]``; keep all other terms.

    ``positions`` names (value column, kind column); literals and blank nodes are never replaced.
    ``pairs[source]`` must be unique. ``mark`` adds a flag: did any position match?
    """
    pairs, small = settle(pairs if _is_local(pairs) else pairs.select(source, target))
    columns = df.columns
    if _is_local(pairs) and len(pairs._rows) <= PUSHDOWN_KEYS:
        found = _found_in(pairs, source, target, positions)
        out = [F.coalesce(found[c], F.col(f"`{c}`")).alias(c) if c in found else F.col(f"`{c}`") for c in columns]
        hit = F.coalesce(*found.values()).isNotNull() if found else F.lit(False)
        return df.select(*out, *([hit.alias(mark)] if mark else []))
    for i, (value, kind) in enumerate(positions):
        side = pairs.select(F.col(source).alias(f"_k{i}"), F.col(target).alias(f"_v{i}"))
        match = F.col(value) == F.col(f"_k{i}")
        if kind:
            match = match & (F.col(kind) == IRI)
        df = df.join(F.broadcast(side) if small else side, match, "left")
    replaced = {v: F.coalesce(F.col(f"_v{i}"), F.col(v)).alias(v) for i, (v, _) in enumerate(positions)}
    out = [replaced.get(c, F.col(f"`{c}`")) for c in columns]
    if mark:
        out.append(F.coalesce(*[F.col(f"_v{i}") for i in range(len(positions))]).isNotNull().alias(mark))
    return df.select(*out)


def _found_in(pairs: DataFrame, source: str, target: str, positions: Sequence[tuple[str, str | None]]) -> dict[str, Column]:
    """For each position the name that the few ``pairs`` give it, as an expression; NULL where they have none.

    The test by hash set comes first, so only rows that hold one of the names search the map.
    """
    at, to = pairs.columns.index(source), pairs.columns.index(target)
    given = {r[at]: r[to] for r in pairs._rows if r[at] is not None}
    if not given:
        return {}
    known = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    inside = lambda value, kind: F.col(value).isin(list(given)) & (F.col(kind) == IRI if kind else F.lit(True))
    return {value: F.when(inside(value, kind), F.element_at(known, F.col(value))) for value, kind in positions}


def mentions(pairs: DataFrame, names: Sequence[str], positions: Sequence[tuple[str, str | None]]) -> Column | None:
    """Does a row hold an IRI of any of the ``names`` columns of ``pairs``? None if they are too many for a filter."""
    if not _is_local(pairs) or len(pairs._rows) * len(names) > PUSHDOWN_KEYS:
        return None
    at = [pairs.columns.index(n) for n in names]
    known = list(dict.fromkeys(r[i] for r in pairs._rows for i in at if r[i] is not None))
    found = F.lit(False)
    for value, kind in positions if known else []:
        found = found | F.col(value).isin(known) & (F.col(kind) == IRI if kind else F.lit(True))
    return found


def among(keys: DataFrame, key: str, column: str) -> Column | None:
    """Is ``column`` one of ``keys``? None if they are too many for a filter."""
    if not _is_local(keys) or len(keys._rows) > PUSHDOWN_KEYS:
        return None
    at = keys.columns.index(key)
    return F.col(column).isin([r[at] for r in keys._rows])


def _by_key(df: DataFrame, keys: DataFrame, column: str, key: str, how: str) -> DataFrame:
    keys, small = settle(keys if _is_local(keys) else keys.select(key))
    if _is_local(keys) and len(keys._rows) <= PUSHDOWN_KEYS:
        # A literal list reaches the Parquet scan and prunes files and row groups.
        at = keys.columns.index(key)
        inside = F.col(column).isin([row[at] for row in keys._rows])
        return df.filter(inside if how == "left_semi" else ~F.coalesce(inside, F.lit(False)))
    side = keys.select(F.col(key).alias("_key"))
    if small:
        return df.join(F.broadcast(side), F.col(column) == F.col("_key"), how)
    return df.join(side.distinct(), F.col(column) == F.col("_key"), how)


def keep(df: DataFrame, keys: DataFrame, column: str = "g", key: str | None = None) -> DataFrame:
    """Rows whose ``column`` is in ``keys`` (semi join)."""
    return _by_key(df, keys, column, key or keys.columns[0], "left_semi")


def drop(df: DataFrame, keys: DataFrame, column: str = "g", key: str | None = None) -> DataFrame:
    """Rows whose ``column`` is not in ``keys`` (anti join)."""
    return _by_key(df, keys, column, key or keys.columns[0], "left_anti")


def _batch(df: DataFrame, like: DataFrame | None) -> tuple[DataFrame, bool]:
    """Settle a batch of quads, or judge it by ``like``, the same rows before their names were mapped."""
    if like is None:
        return settle(df)
    return (local(df), True) if _is_local(like) else (df, is_small(like))


def _rows_in(df: DataFrame, side: DataFrame, columns: Sequence[str], how: str, small: bool) -> DataFrame:
    """Semi or anti join over whole rows, none of them NULL: by one hash, then by every column.

    Hashing, sorting and comparing a long costs a fraction of the same with eight texts.
    """
    key = F.xxhash64(*columns)
    named = side.select(key.alias("_hash"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(columns)])
    match = F.col("_key") == F.col("_hash")
    for i, c in enumerate(columns):
        match = match & (F.col(c) == F.col(f"_r{i}"))
    return df.withColumn("_key", key).join(F.broadcast(named) if small else named, match, how).drop("_key")


def minus(df: DataFrame, gone: DataFrame, columns: Sequence[str] = QUAD_COLS, like: DataFrame | None = None) -> DataFrame:
    """Set difference over whole terms. A small ``gone`` is broadcast, so ``df`` is not shuffled."""
    columns = list(columns)
    side, small = _batch(gone.select(*columns), like)
    return _rows_in(df, side, columns, "left_anti", small)


def as_set(df: DataFrame) -> DataFrame:
    """The distinct rows of a large table, told apart in tasks that each hold a bounded number of them.

    A plain distinct also holds the rows of every task that reads, before they are shuffled. Stored texts take
    a small part of their size in memory, so such a task, cut by bytes, holds millions of rows and spills.
    """
    return deal(df, *df.columns, most=UNSORTED_PARTS).dropDuplicates()


def add_new(existing: DataFrame, incoming: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Union of two quad sets, ``existing`` already being a set.

    A small batch is reduced to its unseen rows by one broadcast pass over ``existing``, which then
    passes through unshuffled; a large batch pays one shuffle of both sides on the whole row.
    """
    incoming, small = _batch(incoming.select(*QUAD_COLS), like)
    if small:
        seen = _rows_in(existing, incoming, QUAD_COLS, "left_semi", True).select(*QUAD_COLS)
        fresh = _rows_in(incoming.dropDuplicates(), seen, QUAD_COLS, "left_anti", False)
        return existing.select(*QUAD_COLS).unionByName(fresh)
    return as_set(existing.select(*QUAD_COLS).unionByName(incoming))
