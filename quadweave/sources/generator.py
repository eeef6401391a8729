"""Deterministic synthetic quads: n statements over k graphs, r of which mention a graph.

Every choice is a hash of (seed, role, row), so a retried task writes the same rows and any two
clusters make the same data. Rows are made from chunks of bounded size: a graph holding most of the
statements is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.schema import XSD

CHUNK = 100_000
# Base IRIs, languages and objects of the synthetic data.
GRAPHS = "http://example.com/graphs/"
SUBJECTS = "http://example.com/subject/"
PREDICATES = "http://example.com/predicate/"
OBJECTS = "http://example.com/object/"
LANGUAGES = ["en", "es", "fr", "de"]


def parse_references(spec: str, statements: int) -> int:
    """``"25"`` is 25 statements, ``"5%"`` is 5 per cent of them."""
    found = re.fullmatch(r"(\d+)(%?)", spec)
    if not found or (found[2] and int(found[1]) > 100):
        raise ValueError(f"invalid reference count: {spec}")
    n = int(found[1])
    return statements * n // 100 if found[2] else min(n, statements)


def _number(seed: int, role: str, row: Column, modulo: Column | int) -> Column:
    """Hash of (seed, role, row) as an integer below ``modulo``."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(role), row.cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), modulo if isinstance(modulo, Column) else F.lit(modulo))


def _name(base: str, seed: int, role: str, row: Column) -> Column:
    return F.concat(F.lit(base), F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(role), row.cast("string"))))


def graph_plan(spark: SparkSession, statements: int, graphs: int, references: int, seed: int = 0) -> DataFrame:
    """``(graph_no, size, refs, start)``: sizes weighted by hash, references spread by ceil(size * share)."""
    ordered = Window.orderBy("graph_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # One row per graph; the number of graphs is a parameter, not data.
    weights = spark.range(1, graphs + 1).select(
        F.col("id").alias("graph_no"), (_number(seed, "size", F.col("id"), 1 << 16) + 1).alias("w")
    )
    # Products of counts pass the range of a long long before the counts do.
    big = "decimal(38,0)"
    share = F.expr(f"cast(cast(w as {big}) * cast({statements} as {big}) div sum(w) over () as bigint)")
    sized = weights.withColumn("size", share)
    left_over = F.lit(statements) - F.sum("size").over(everything)
    sized = sized.withColumn("size", F.col("size") + F.when(F.col("graph_no") == graphs, left_over).otherwise(0))
    wanted = F.expr(
        f"cast((cast(size as {big}) * cast({references} as {big}) + {max(statements - 1, 0)}) div cast({max(statements, 1)} as {big}) as bigint)"
    )
    spread = (
        sized.withColumn("wanted", wanted)
        .withColumn("used", F.coalesce(F.sum("wanted").over(before), F.lit(0)))
        .withColumn("refs", F.greatest(F.lit(0), F.least("wanted", F.lit(references) - F.col("used"))))
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    )
    return spread.select("graph_no", "size", "refs", "start")


def generate(
    spark: SparkSession, statements: int, graphs: int, references: int | str = 0, seed: int = 0
) -> DataFrame:
    """Quads with a dense ``row_id``; the first ``refs`` rows of each graph mention some graph."""
    if isinstance(references, str):
        references = parse_references(references, statements)
    plan = graph_plan(spark, statements, graphs, min(references, statements), seed)
    chunks = plan.filter("size > 0").select(
        "graph_no",
        "refs",
        "start",
        "size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(CHUNK).cast("bigint"))).alias("first"),
    )
    partitions = max(1, statements // CHUNK + graphs)
    rows = chunks.repartition(partitions, "graph_no", "first").select(
        "graph_no",
        "refs",
        "start",
        F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("size")) - 1)).alias("pos"),
    )
    rows = rows.select("graph_no", (F.col("start") + F.col("pos")).alias("row_id"), (F.col("pos") < F.col("refs")).alias("is_ref"))
    return statements_from(rows, graphs, seed)


def statements_from(rows: DataFrame, graphs: int, seed: int = 0) -> DataFrame:
    """Fill in terms for ``(row_id, graph_no, is_ref)``."""
    row = F.col("row_id")
    # Which of s, p, o mention a graph: any non-empty combination, as bits 1, 2 and 4.
    bits = F.when(F.col("is_ref"), _number(seed, "positions", row, 7) + 1).otherwise(0)
    target = F.concat(F.lit(GRAPHS), (_number(seed, "target", row, graphs) + 1).cast("string"))

    def mentions(bit: int) -> Column:
        return F.col("_bits").bitwiseAND(F.lit(bit).cast("bigint")) > 0

    kind = _number(seed, "kind", row, 7)
    word = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("word"), row.cast("string"))), 1, 12)
    number = _number(seed, "number", row, 100_000)
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.pmod(number, F.lit(len(LANGUAGES))) + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(number, F.lit(14)).cast("int")), "yyyy-MM-dd")
    hundredths = F.concat_ws(".", (number / 100).cast("bigint").cast("string"), F.lpad(F.pmod(number, F.lit(100)).cast("string"), 2, "0"))
    objects = [
        T.literal(word),
        T.lang_string(word, lang),
        T.literal(T.boolean_lexical(F.pmod(number, F.lit(2)) == 1), XSD + "boolean"),
        T.literal(number.cast("string"), XSD + "integer"),
        T.literal(hundredths, XSD + "double"),
        T.literal(day, XSD + "date"),
        T.iri(_name(OBJECTS, seed, "o", row)),
    ]
    obj = F.when(mentions(4), T.iri(F.col("_target")))
    for i, choice in enumerate(objects[:-1]):
        obj = obj.when(F.col("_kind") == i, choice)
    filled = rows.select(row, "graph_no", "is_ref", bits.cast("bigint").alias("_bits"), target.alias("_target"), kind.alias("_kind"))
    statement = T.quad(
        F.concat(F.lit(GRAPHS), F.col("graph_no").cast("string")),
        T.iri(F.when(mentions(1), F.col("_target")).otherwise(_name(SUBJECTS, seed, "s", row))),
        F.when(mentions(2), F.col("_target")).otherwise(_name(PREDICATES, seed, "p", row)),
        obj.otherwise(objects[-1]),
    )
    return filled.select("row_id", "is_ref", statement.alias("q")).select("row_id", "is_ref", "q.*")


def delete_subset(quads: DataFrame, statements: int) -> DataFrame:
    """First half of the generated statements."""
    return quads.filter(F.col("row_id") < statements // 2)


def verify(quads: DataFrame) -> DataFrame:
    """Statements per graph; the row with a NULL graph is the total."""
    return quads.rollup("g").agg(F.count("*").alias("statements"))
