"""Getting quads and results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.terms import TERM_DDL, term_syntax, to_syntax
from quadweave.schema import BNODE, IRI, TRIPLE_COLS, XSD, local_table, struct


def _statement(with_graph: bool) -> Column:
    empty = F.lit("")
    parts = [
        term_syntax(F.col("s"), F.col("s_kind"), empty, empty),
        term_syntax(F.col("p"), F.lit(IRI), empty, empty),
        term_syntax(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")),
    ]
    if with_graph:
        parts.append(F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
    return F.concat(F.concat_ws(" ", *parts), F.lit(" ."))


def quad_lines(quads: DataFrame) -> DataFrame:
    """N-Quads, one row per statement."""
    return quads.select(_statement(True).alias("value"))


def triple_lines(triples: DataFrame) -> DataFrame:
    """N-Triples, one row per statement."""
    return triples.select(_statement(False).alias("value"))


def write_quads(quads: DataFrame, path: str, compression: str = "gzip") -> None:
    quad_lines(quads).write.mode("overwrite").option("compression", compression).text(path)


def write_triples(triples: DataFrame, path: str, compression: str = "gzip") -> None:
    triple_lines(triples).write.mode("overwrite").option("compression", compression).text(path)


def statement_table(quads: DataFrame) -> DataFrame:
    """Statements as three columns of plain values; the graph is dropped."""
    return quads.select("s", "p", "o")


def write_statements(quads: DataFrame, path: str, sep: str = ",") -> None:
    """CSV, or TSV with ``sep='\\t'``."""
    statement_table(quads).write.mode("overwrite").option("header", True).option("sep", sep).option(
        "escape", '"'
    ).csv(path)


def _is_term(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == TERM_DDL


def csv_bindings(rows: DataFrame) -> DataFrame:
    """SPARQL CSV: plain values, blank nodes with ``_:``, unbound is empty."""
    out = []
    for c in rows.columns:
        marked = F.when(F.col(f"`{c}`.kind") == BNODE, F.concat(F.lit("_:"), F.col(f"`{c}`.value"))) if _is_term(rows, c) else None
        value = F.coalesce(marked, F.col(f"`{c}`.value")) if _is_term(rows, c) else F.col(f"`{c}`").cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return rows.select(*out)


def tsv_bindings(rows: DataFrame) -> DataFrame:
    """SPARQL TSV: terms in line syntax, unbound is empty."""
    out = []
    for c in rows.columns:
        value = to_syntax(F.col(f"`{c}`")) if _is_term(rows, c) else F.col(f"`{c}`").cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return rows.select(*out)


# Type names of the SPARQL 1.1 JSON results format.
_JSON_TYPES = {"iri": "uri", "bnode": "bnode", "literal": "literal"}


def json_bindings(rows: DataFrame) -> DataFrame:
    """One JSON object of the SPARQL results format per row; unbound variables are left out."""

    def cell(c: str) -> Column:
        if not _is_term(rows, c):
            return F.col(f"`{c}`")
        t = F.col(f"`{c}`")
        kind = F.create_map(*[F.lit(x) for pair in _JSON_TYPES.items() for x in pair])[t["kind"]]
        plain = (t["dt"] == "") | (t["dt"] == XSD + "string") | (t["lang"] != "")
        return F.when(
            t.isNotNull(),
            F.struct(
                kind.alias("type"),
                t["value"].alias("value"),
                F.when(t["lang"] != "", t["lang"]).alias("xml:lang"),
                F.when(~plain, t["dt"]).alias("datatype"),
            ),
        )

    return rows.select(F.to_json(F.struct(*[cell(c).alias(c) for c in rows.columns])).alias("value"))


def tsv_lines(rows: DataFrame) -> DataFrame:
    """SPARQL TSV as lines: the names of the variables first, then one line per row.

    Terms go out as they are, tabs and line ends inside them escaped, so nothing is quoted again.
    """
    header = local_table(rows.sparkSession, [("\t".join(f"?{c}" for c in rows.columns),)], struct("value STRING"))
    terms = tsv_bindings(rows)
    return header.unionByName(terms.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in rows.columns]).alias("value")))


def write_bindings(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Solutions as part files.

    ``csv`` has its header line in every file, ``tsv`` in the first file alone, so that its files end
    to end are one document. ``json`` is one binding object per line, to be read in parallel, without
    the head and results of a whole document; see :func:`json_bindings`.
    """
    if fmt == "json":
        json_bindings(rows).write.mode("overwrite").text(path)
    elif fmt == "csv":
        csv_bindings(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "tsv":
        tsv_lines(rows).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def boolean_result(answer: DataFrame, fmt: str = "text") -> DataFrame:
    """A one-row boolean as text or as a results document."""
    value = F.when(F.col(answer.columns[0]), "true").otherwise("false")
    if fmt == "json":
        value = F.concat(F.lit('{"head":{},"boolean":'), value, F.lit("}"))
    return answer.select(value.alias("value"))


def graph_triples(view: DataFrame, graph: str) -> DataFrame:
    """Triples of one graph of a view."""
    return view.filter(F.col("g") == graph).select(*TRIPLE_COLS).distinct()
