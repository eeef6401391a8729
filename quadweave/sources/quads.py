"""Getting quads in: line formats, wide tables, graph assignment, validation and batching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.operators.ranks import dense_rank_by_parts
from quadweave.schema import BNODE, IRI, LITERAL, QUAD_COLS, QUADS, RDF_LANG_STRING, XSD, local_table

# N-Triples / N-Quads. Escapes are masked before matching, so a literal body is one character class
# and texts of any length match without backtracking or recursion.
_MASKS = [("\x01", "\x01a"), ("\\\\", "\x01b"), ('\\"', "\x01c"), ("\x02", "\x01d")]
_IRIREF = r"<([^<>\"{}|^`\x00-\x20]*)>"
_LABEL = r"_:([^\s<>\"]*[^\s<>\".])"
_LITERAL = rf"(\"[^\"]*\")(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRIREF})?"
_LINE = (
    rf"(?s)^\s*(?:{_IRIREF}|{_LABEL})\s*{_IRIREF}\s*(?:{_IRIREF}|{_LABEL}|{_LITERAL})"
    rf"\s*(?:{_IRIREF}|{_LABEL})?\s*\.\s*(?:#.*)?\z"
)
_FIELDS = ["s", "s_bnode", "p", "o", "o_bnode", "o_lit", "o_lang", "o_dt", "g", "g_bnode"]
_SIMPLE_ESCAPES = [("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ("\\'", "'")]
#: Rows of a table in a task that widens them into quads.
DEALT_ROWS = 250_000
_BAD_ESCAPE = r"\\(?![tbnrf']|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"


def _unicode(value: Column, marker: str, digits: int, charset: str) -> Column:
    """Decode ``\\uXXXX`` / ``\\UXXXXXXXX`` after the simple escapes are done."""
    parts = F.split(value, "\\\\" + marker)
    decoded = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x: F.concat(
            F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.substr(x, F.lit(digits + 1))
        ),
    )
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))
    return F.when(F.contains(value, F.lit("\\" + marker)), joined).otherwise(value)


def _unmask(value: Column, quoted: bool = True) -> Column:
    if quoted:
        value = F.when(
            F.contains(value, F.lit("\\")), _unicode(_unicode(_simple(value), "u", 4, "UTF-16BE"), "U", 8, "UTF-32")
        ).otherwise(value)
    plain = value
    for raw, masked in (("\x02", "\x01d"), ('"', "\x01c"), ("\\", "\x01b"), ("\x01", "\x01a")):
        plain = F.replace(plain, F.lit(masked), F.lit(raw))
    return F.when(F.contains(value, F.lit("\x01")), plain).otherwise(value)


def _simple(value: Column) -> Column:
    for escaped, raw in _SIMPLE_ESCAPES:
        value = F.replace(value, F.lit(escaped), F.lit(raw))
    return value


@dataclass(frozen=True)
class Parsed:
    quads: DataFrame  # g is NULL for triples
    rejects: DataFrame  # line, reason


def parse_lines(
    lines: DataFrame,
    line: str = "value",
    document: Column | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> Parsed:
    """Parse one statement per row. Comments and blank lines are skipped, bad lines become rejects.

    ``document`` identifies the file of a row: blank node labels only mean something inside it.
    ``keep`` may stage what became of the lines when both quads and rejects will be read.
    """
    doc = F.lit("") if document is None else F.hex(F.xxhash64(document))
    raw_text = masked_text = F.col(line)
    for raw, masked in _MASKS:
        masked_text = F.replace(masked_text, F.lit(raw), F.lit(masked))
    text = F.when(raw_text.rlike(r"[\\\x01\x02]"), masked_text).otherwise(raw_text)
    joined = "\x02".join(f"${i + 1}" for i in range(len(_FIELDS)))
    split = F.split(F.regexp_replace(F.col("_masked"), _LINE, joined), "\x02")
    # The generator keeps Catalyst from moving the filters below, and with them a second evaluation
    # of the pattern, under this projection.
    rows = (
        lines.filter(~F.col(line).rlike(r"(?s)^\s*(#.*)?\z"))
        .select(F.col(line).alias("line"), text.alias("_masked"), doc.alias("_doc"))
        .select("line", "_doc", F.explode(F.array(split)).alias("f"))
    )
    field = {name: F.get(F.col("f"), F.lit(i)) for i, name in enumerate(_FIELDS)}
    matched = F.size("f") == len(_FIELDS)
    # Only the terms are held to the escapes; a comment after the statement may hold anything.
    bad = F.contains(F.col("line"), F.lit("\\")) & F.exists("f", lambda term: term.rlike(_BAD_ESCAPE))
    reason = F.when(~matched, "not a statement").when(bad, "bad escape")

    def name(iri: Column, label: Column) -> Column:
        return F.when(label != "", F.concat(F.col("_doc"), label)).otherwise(_unmask(iri))

    is_lit = field["o_lit"] != ""
    body = _unmask(F.substring(field["o_lit"], F.lit(2), F.length(field["o_lit"]) - 2))
    dt = (
        F.when(~is_lit, "")
        .when(field["o_lang"] != "", RDF_LANG_STRING)
        .when(field["o_dt"] != "", _unmask(field["o_dt"]))
        .otherwise(XSD + "string")
    )
    has_graph = (field["g"] != "") | (field["g_bnode"] != "")
    terms = [
        F.when(field["g_bnode"] != "", F.concat(F.lit("_:"), F.col("_doc"), field["g_bnode"]))
        .when(has_graph, _unmask(field["g"]))
        .alias("g"),
        name(field["s"], field["s_bnode"]).alias("s"),
        F.when(field["s_bnode"] != "", BNODE).otherwise(IRI).alias("s_kind"),
        _unmask(field["p"]).alias("p"),
        F.when(is_lit, body).otherwise(name(field["o"], field["o_bnode"])).alias("o"),
        F.when(is_lit, LITERAL).when(field["o_bnode"] != "", BNODE).otherwise(IRI).alias("o_kind"),
        dt.alias("o_dt"),
        F.lower(field["o_lang"]).alias("o_lang"),
    ]
    if keep is None:
        return Parsed(rows.filter(reason.isNull()).select(*terms), rows.filter(reason.isNotNull()).select("line", reason.alias("reason")))
    # What is kept is the outcome: a quad, or a line and its reason.
    told = rows.select("line", "_doc", "f", reason.alias("reason"))
    failed = F.col("reason").isNotNull()
    terms = [F.when(~failed, term).alias(c) for term, c in zip(terms, QUAD_COLS)]
    held = keep(told.select(F.when(failed, F.col("line")).alias("line"), "reason", *terms))
    return Parsed(held.filter(~failed).select(*QUAD_COLS), held.filter(failed).select("line", "reason"))


def read_lines(spark: SparkSession, path: str | list[str]) -> Parsed:
    """Read N-Triples or N-Quads files; gzip and other Hadoop codecs are decoded by the text source."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_lines(lines, "value", F.col("_file"))


def assign_graph(statements: DataFrame, graph: str | Column) -> DataFrame:
    """Put all statements in one graph, over whatever graph they carried."""
    g = F.lit(graph) if isinstance(graph, str) else graph
    return statements.withColumn("g", g).select(*QUAD_COLS)


def from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """In-memory statements ``(g, s, s_kind, p, o, o_kind, o_dt, o_lang)`` as a source."""
    return local_table(spark, rows, QUADS)


def from_table(df: DataFrame, graph: Column, subject: Column, attributes: Mapping[str, Column]) -> DataFrame:
    """One quad per row and attribute: ``attributes`` maps predicate IRI to an object term.

    NULL objects give no quad. A single pass: the row is widened in place, nothing is shuffled.
    """
    subject = T.iri(subject)
    cells = [
        F.when(obj["value"].isNotNull(), T.quad(graph, subject, F.lit(p), obj)) for p, obj in attributes.items()
    ]
    return df.select(F.inline(F.filter(F.array(*cells), lambda q: q.isNotNull())))


def deal(df: DataFrame, *by: str | Column, size: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` spread by hash over as many partitions as its rows ask for, ``most`` at most, before it is widened into quads.

    Partitions of files are as few as their bytes ask for; a row of a few numbers becomes several quads of
    eight texts, and tasks that hold too many of them spill.
    """
    parts = max(1, -(-df.count() // (size or DEALT_ROWS)))
    return df.repartition(min(parts, most or parts), *by)


def unpivot_table(df: DataFrame, graph: Column, subject: Column, columns: Mapping[str, str]) -> DataFrame:
    """String columns as plain literals: ``columns`` maps column name to predicate IRI."""
    names = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    wide = df.select(graph.alias("g"), subject.alias("s"), *columns)
    long = wide.unpivot(["g", "s"], list(columns), "_column", "o").filter(F.col("o").isNotNull())
    return long.select(
        "g",
        "s",
        F.lit(IRI).alias("s_kind"),
        names[F.col("_column")].alias("p"),
        "o",
        F.lit(LITERAL).alias("o_kind"),
        F.lit(XSD + "string").alias("o_dt"),
        F.lit("").alias("o_lang"),
    )


def graph_problems(quads: DataFrame) -> DataFrame:
    """Quads whose graph is missing or a blank node, with the reason."""
    reason = F.when(F.col("g").isNull() | (F.col("g") == ""), "missing graph").when(
        F.startswith(F.col("g"), F.lit("_:")), "blank node as graph"
    )
    return quads.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def check_graphs(quads: DataFrame) -> None:
    """Refuse a source with bad graphs, showing up to five of its quads."""
    bad = graph_problems(quads).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.reason}: {r.s} {r.p} {r.o}" for r in bad))


def batch_by_graph(df: DataFrame, order: str, size: int = 75_000, graph: str = "g") -> DataFrame:
    """Number the batches of at most ``size`` rows of one graph each.

    Rows are taken ``4 * size`` at a time in ``order`` (a unique column; its values may be sparse),
    then split by graph, so no window partition exceeds ``4 * size`` rows whatever the size of a graph.
    """
    ranked = dense_rank_by_parts(df, "_rank", order)
    ranked = ranked.withColumn("chunk", F.floor(F.col("_rank") / F.lit(4 * size))).drop("_rank")
    rank = F.row_number().over(Window.partitionBy("chunk", graph).orderBy(order)) - 1
    return ranked.withColumn("batch", F.floor(rank / F.lit(size)))
