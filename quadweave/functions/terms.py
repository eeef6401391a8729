"""RDF terms as columns: constructors, casts, lexical forms and line syntax.

A bound variable of a solution is one struct ``term(value, kind, dt, lang)``; struct equality is
exactly RDF term equality. Value comparison goes through the casts and only belongs in filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.schema import BNODE, IRI, LITERAL, RDF_LANG_STRING, XSD, struct

TERM = struct("value STRING, kind STRING, dt STRING, lang STRING")
TERM_DDL = TERM.simpleString()


def _text(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def term(value: Column, kind: Column | str, dt: Column | str = "", lang: Column | str = "") -> Column:
    return F.struct(
        value.alias("value"), _text(kind).alias("kind"), _text(dt).alias("dt"), _text(lang).alias("lang")
    )


def iri(value: Column | str) -> Column:
    return term(_text(value), IRI)


def bnode(label: Column | str) -> Column:
    return term(_text(label), BNODE)


def literal(value: Column | str, datatype: str | Column = XSD + "string") -> Column:
    return term(_text(value), LITERAL, datatype)


def lang_string(value: Column | str, lang: Column | str) -> Column:
    lang = _text(lang)
    return term(_text(value), LITERAL, RDF_LANG_STRING, F.lower(lang))


def subject_term() -> Column:
    return term(F.col("s"), F.col("s_kind"))


def predicate_term() -> Column:
    return term(F.col("p"), IRI)


def object_term() -> Column:
    return term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))


def graph_term() -> Column:
    return term(F.col("g"), IRI)


def quad(g: Column, s: Column, p: Column, o: Column) -> Column:
    """One quad struct from a graph IRI column, and term structs for subject and object."""
    return F.struct(
        g.alias("g"),
        s["value"].alias("s"),
        s["kind"].alias("s_kind"),
        p.alias("p"),
        o["value"].alias("o"),
        o["kind"].alias("o_kind"),
        o["dt"].alias("o_dt"),
        o["lang"].alias("o_lang"),
    )


def is_iri(t: Column) -> Column:
    return t["kind"] == IRI


def same_term(a: Column, b: Column) -> Column:
    return a == b


# Casts for value comparison. A lexical form outside the type gives NULL, i.e. an unbound value.


def as_integer(t: Column) -> Column:
    return F.when(t["dt"].isin(XSD + "integer", XSD + "int", XSD + "long"), t["value"].try_cast("bigint"))


def as_double(t: Column) -> Column:
    numeric = [XSD + n for n in ("integer", "int", "long", "double", "float", "decimal")]
    return F.when(t["dt"].isin(numeric), t["value"].try_cast("double"))


def as_boolean(t: Column) -> Column:
    return F.when(t["dt"] == XSD + "boolean", t["value"].isin("true", "1"))


def as_date(t: Column) -> Column:
    return F.when(t["dt"] == XSD + "date", t["value"].try_cast("date"))


def as_timestamp(t: Column) -> Column:
    return F.when(t["dt"] == XSD + "dateTime", t["value"].try_cast("timestamp"))


# Lexical forms for native values.


def datetime_lexical(ts: Column) -> Column:
    """xsd:dateTime text of an instant; milliseconds are always written."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def local_datetime_lexical(ts: Column) -> Column:
    """xsd:dateTime text without a zone; milliseconds are always written."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def date_lexical(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def boolean_lexical(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


# Line syntax (N-Triples / N-Quads) of a term.

_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escape_text(value: Column) -> Column:
    for raw, escaped in _ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def term_syntax(value: Column, kind: Column, dt: Column, lang: Column) -> Column:
    suffix = (
        F.when(lang != "", F.concat(F.lit("@"), lang))
        .when((dt == "") | (dt == XSD + "string"), F.lit(""))
        .otherwise(F.concat(F.lit("^^<"), dt, F.lit(">")))
    )
    return (
        F.when(kind == IRI, F.concat(F.lit("<"), value, F.lit(">")))
        .when(kind == BNODE, F.concat(F.lit("_:"), value))
        .otherwise(F.concat(F.lit('"'), escape_text(value), F.lit('"'), suffix))
    )


def to_syntax(t: Column) -> Column:
    return F.when(t.isNotNull(), term_syntax(t["value"], t["kind"], t["dt"], t["lang"]))
