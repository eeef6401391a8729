"""Graph patterns over a quads DataFrame, as joins of solutions.

A solution is a row with one term struct per variable; an unbound variable is NULL. All joins are
equi joins on whole terms, so Catalyst chooses broadcast or shuffle and reorders them freely.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.functions.terms import TERM, graph_term, object_term, predicate_term, subject_term
from quadweave.schema import BNODE, IRI, LITERAL, TRIPLE_COLS, XSD, local_table

Constant = tuple[str, str, str, str]  # value, kind, datatype, language


def iri(value: str) -> Constant:
    return (value, IRI, "", "")


def text(value: str, datatype: str = XSD + "string", lang: str = "") -> Constant:
    return (value, LITERAL, datatype, lang)


def var(name: str) -> str:
    return "?" + name


def is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


# position -> (columns holding the parts of a term, the term itself)
_POSITIONS = {
    "s": (["s", "s_kind"], subject_term),
    "p": (["p"], predicate_term),
    "o": (["o", "o_kind", "o_dt", "o_lang"], object_term),
    "g": (["g"], graph_term),
}


def pattern(quads: DataFrame, s, p, o, g=None) -> DataFrame:
    """Match one statement pattern. Each position is a variable ``'?x'`` or a constant term.

    Constants become plain column comparisons, which Parquet scans can use; a draft view first gets
    them in terms of its stored names. A variable used twice means equality. Without ``g`` the pattern matches the default graph: the merge of all graphs.
    """
    given = {"s": s, "p": p, "o": o}
    fixed = {k: (x[0], x[1]) for k, x in {**given, "g": g}.items() if x is not None and not is_var(x)}
    if fixed and hasattr(quads, "_within"):
        quads = quads._within(fixed)
    if g is None:
        quads = quads.select(*TRIPLE_COLS)
    else:
        given["g"] = g
    condition: list[Column] = []
    bound: dict[str, Column] = {}
    for position, x in given.items():
        columns, term = _POSITIONS[position]
        if is_var(x):
            name = x[1:]
            if name in bound:
                condition.append(bound[name] == term())
            else:
                bound[name] = term()
        else:
            condition += [F.col(c) == part for c, part in zip(columns, x)]
            if len(columns) == 1 and x[1] != IRI:
                condition.append(F.lit(False))
    if condition:
        quads = quads.filter(reduce(lambda a, b: a & b, condition))
    if g is None:
        quads = quads.distinct()
    return quads.select(*[t.alias(name) for name, t in bound.items()])


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _loose(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None) -> list[str]:
    """Shared variables that a row may leave unbound: the named ones; by default those with a nullable column."""
    if maybe_unbound is None:
        return [v for v in shared(left, right) if left.schema[v].nullable or right.schema[v].nullable]
    return [v for v in shared(left, right) if v in set(maybe_unbound)]


def _by_bound(df: DataFrame, loose: list[str]) -> list[tuple[frozenset, DataFrame]]:
    """``df`` in parts, one per choice of the ``loose`` variables bound in a row; the unbound are dropped."""
    parts = []
    for flags in product((True, False), repeat=len(loose)):
        bound = frozenset(v for v, has in zip(loose, flags) if has)
        part = df
        for v in loose:
            part = part.filter(F.col(v).isNotNull() if v in bound else F.col(v).isNull())
        parts.append((bound, part.drop(*[v for v in loose if v not in bound])))
    return parts


def _cases(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None) -> list[tuple[DataFrame, list[tuple[DataFrame, list[str]]]]]:
    """For each part of ``left``: the parts of ``right`` with the variables that both have bound.

    An unbound variable is compatible with any value, so two rows match if they agree in those: within
    two parts that is an equi join.
    """
    loose = _loose(left, right, maybe_unbound)
    firm = [v for v in shared(left, right) if v not in loose]
    rights = _by_bound(right, loose)
    return [(part, [(r, [*firm, *sorted(has & bound)]) for has, r in rights]) for bound, part in _by_bound(left, loose)]


def _same_columns(parts: list[DataFrame], columns: Sequence[str], like: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """The union of parts, with the columns that all of them leave unbound as NULL."""
    whole = union(*parts)
    kinds = {f.name: f.dataType for d in (other, like) if d is not None for f in d.schema.fields}
    return whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])


def join(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None = None) -> DataFrame:
    """Natural join on all shared variables; one that is unbound on a side is compatible with any value.

    Variables that may be unbound are named, or else read off the schema (a nullable column). Rows are
    split by which of them are bound, and each pair of parts is an equi join; a pair that shares no bound
    variable would be a product and is refused.
    """
    if not shared(left, right):
        raise ValueError("patterns share no variable; a product of patterns is not supported")
    if not _loose(left, right, maybe_unbound):
        return left.join(right, shared(left, right))
    parts = [l_part.join(r_part, on or _need_shared()) for l_part, rights in _cases(left, right, maybe_unbound) for r_part, on in rights]
    return _same_columns(parts, [*left.columns, *[c for c in right.columns if c not in left.columns]], left, right)


def bgp(*parts: DataFrame) -> DataFrame:
    return reduce(join, parts)


def optional(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None = None) -> DataFrame:
    """Keep all left rows; right variables are unbound where nothing matches.

    Shared variables that may be unbound, any number of them, are handled as in :func:`join`.
    """
    on = shared(left, right) or _need_shared()
    if not _loose(left, right, maybe_unbound):
        return left.join(right, on, "left")
    return union(join(left, right, maybe_unbound), not_exists(left, right, maybe_unbound=maybe_unbound))


def _need_shared():
    raise ValueError("an optional pattern must share a bound variable")


def exists(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None = None) -> DataFrame:
    """Left rows with a compatible right row, each as often as it stands on the left."""
    on = shared(left, right) or _need_shared()
    if not _loose(left, right, maybe_unbound):
        return left.join(right, on, "left_semi")
    parts = []
    for rest, rights in _cases(left, right, maybe_unbound):
        for r_part, keys in rights:
            parts.append(rest.join(r_part, keys or _need_shared(), "left_semi"))
            rest = rest.join(r_part, keys, "left_anti")
    return _same_columns(parts, left.columns, left)


def not_exists(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, maybe_unbound: Iterable[str] | None = None) -> DataFrame:
    """Left rows without a compatible right row; ``on`` limits which variables count as shared."""
    if on:
        right = right.select(*on)
    keys = shared(left, right) or _need_shared()
    if not _loose(left, right, maybe_unbound):
        return left.join(right, keys, "left_anti")
    parts = []
    for rest, rights in _cases(left, right, maybe_unbound):
        for r_part, both in rights:
            rest = rest.join(r_part, both or _need_shared(), "left_anti")
        parts.append(rest)
    return _same_columns(parts, left.columns, left)


def minus(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] | None = None) -> DataFrame:
    """Left rows without a compatible right row that has a bound variable in common.

    With no variable shared, nothing is removed.
    """
    on = shared(left, right)
    if not on or not _loose(left, right, maybe_unbound):
        return left.join(right, on, "left_anti") if on else left
    parts = []
    for rest, rights in _cases(left, right, maybe_unbound):
        for r_part, both in rights:
            rest = rest.join(r_part, both, "left_anti") if both else rest
        parts.append(rest)
    return _same_columns(parts, left.columns, left)


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables missing on one side are unbound there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(spark: SparkSession, name: str, terms: Sequence[Constant]) -> DataFrame:
    """Inline data for one variable; no terms means no rows."""
    schema = T.StructType([T.StructField(name, TERM, False)])
    names = TERM.fieldNames()
    return local_table(spark, [(dict(zip(names, t)),) for t in terms], schema)


def bind(rows: DataFrame, name: str, expression: Column) -> DataFrame:
    """Bind a new variable; an expression that fails should be written to give NULL."""
    if name in rows.columns:
        raise ValueError(f"variable already bound: {name}")
    return rows.withColumn(name, expression)


def select(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*names) if names else rows


def select_distinct(rows: DataFrame, *names: str) -> DataFrame:
    return select(rows, *names).distinct()


def reduced(rows: DataFrame) -> DataFrame:
    """Duplicates may stay, so none are looked for."""
    return rows


def count_having(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("count")).filter(F.col("count") > more_than)


def group_concat(
    rows: DataFrame, keys: Sequence[str], column: Column, separator: str = " ", distinct: bool = False, name: str = "joined"
) -> DataFrame:
    """Joined values per group, sorted because their order is otherwise undefined."""
    collected = F.collect_set(column) if distinct else F.collect_list(column)
    return rows.groupBy(*keys).agg(F.concat_ws(separator, F.array_sort(collected)).alias(name))


def first_or_error(rows: DataFrame):
    """None for no row, the row for one, an error for more."""
    found = rows.limit(2).collect()
    if len(found) > 1:
        raise ValueError("more than one row")
    return found[0] if found else None


def ask(rows: DataFrame) -> DataFrame:
    """One boolean: is there any solution?"""
    return rows.select(F.lit(True).alias("_x")).limit(1).agg((F.count("*") > 0).alias("answer"))


def construct(rows: DataFrame, template: Sequence[tuple]) -> DataFrame:
    """Set of triples from a template of variables and constants.

    A triple with an unbound variable, a literal subject or a predicate that is no IRI is left out.
    All templates are filled in one pass over the solutions.
    """

    def cell(x) -> Column:
        if is_var(x):
            return F.col(x[1:])
        names = ("value", "kind", "dt", "lang")
        return F.struct(*[F.lit(part).alias(n) for n, part in zip(names, x)])

    triples = F.array(*[F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o")) for s, p, o in template])
    t = F.col("t")
    legal = (
        t["s"].isNotNull() & t["p"].isNotNull() & t["o"].isNotNull()
        & t["s"]["kind"].isin(IRI, BNODE) & (t["p"]["kind"] == IRI)
    )
    return (
        rows.select(F.explode(triples).alias("t"))
        .filter(legal)
        .select(
            F.col("t.s.value").alias("s"),
            F.col("t.s.kind").alias("s_kind"),
            F.col("t.p.value").alias("p"),
            F.col("t.o.value").alias("o"),
            F.col("t.o.kind").alias("o_kind"),
            F.col("t.o.dt").alias("o_dt"),
            F.col("t.o.lang").alias("o_lang"),
        )
        .distinct()
    )


def describe(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """All triples about the resources in the first column of ``resources`` (term structs)."""
    name = resources.columns[0]
    keys = resources.select(F.col(f"`{name}`.value").alias("s"), F.col(f"`{name}`.kind").alias("s_kind")).distinct()
    return quads.join(keys, ["s", "s_kind"], "left_semi").select(*TRIPLE_COLS).distinct()
