"""Reading, validating, exporting and generating quads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.operators import patterns as pt
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import sql
from quadweave.schema import QUAD_COLS, XSD
from quadweave.sources import generator, quads, sinks

EX = fx.EX


def _document_quads(spark, sf_dir):
    documents = fx.read(spark, sf_dir, "documents")
    return quads.from_table(
        documents,
        F.concat(F.lit(EX + "source/"), F.md5("source")),
        F.concat(F.lit(EX + "doc/"), F.col("doc_id").cast("string")),
        {fx.P + "text": T.lang_string(F.col("text"), F.lit("en")), fx.P + "source": T.literal(F.col("source"))},
    )


@register(
    "a1_read_quad_lines",
    """
    SELECT 'http://example.com/source/'||md5(source) AS g, 'http://example.com/doc/'||doc_id AS s, 'http://example.com/p/text' AS p,
      md5(text) AS o_md5, CAST(length(text) AS BIGINT) AS o_length, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS o_dt, 'en' AS o_lang FROM documents
    UNION ALL
    SELECT 'http://example.com/source/'||md5(source), 'http://example.com/doc/'||doc_id, 'http://example.com/p/source',
      md5(source), CAST(length(source) AS BIGINT), 'http://www.w3.org/2001/XMLSchema#string', '' FROM documents""",
)
def read_quad_lines(spark, sf_dir):
    """Whole document texts written as statement lines and read back."""
    parsed = quads.parse_lines(sinks.quad_lines(_document_quads(spark, sf_dir))).quads
    return parsed.select(
        "g", "s", "p", F.md5("o").alias("o_md5"), F.length("o").cast("bigint").alias("o_length"), "o_dt", "o_lang"
    )


@register(
    "a1_reject_bad_lines",
    """
    SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'not a statement' ELSE 'bad escape' END AS reason
    FROM orders WHERE o_orderkey % 10 IN (0, 1)""",
)
def reject_bad_lines(spark, sf_dir):
    """One line in ten lacks its dot, one has an unknown escape, one is a comment."""
    k = F.col("o_orderkey")
    kind = k % 10
    body = F.when(kind == 1, F.lit('"a\\q"')).otherwise(F.lit('"a"'))
    end = F.when(kind == 0, F.lit("")).otherwise(F.lit(" ."))
    line = F.concat(
        F.when(kind == 2, F.lit("# ")).otherwise(F.lit("")),
        F.lit(f"<{EX}order/"), k.cast("string"), F.lit(f"> <{EX}p/x> "), body, end,
    )
    lines = fx.read(spark, sf_dir, "orders").select(line.alias("value"))
    rejects = quads.parse_lines(lines).rejects
    return rejects.select(F.regexp_extract("line", r"order/(\d+)", 1).cast("bigint").alias("k"), "reason")


@register("a2_assign_graph", sql("SELECT DISTINCT 'http://example.com/graph/all' AS g, s, p, o FROM live_q"))
def assign_graph(spark, sf_dir):
    live = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    return quads.assign_graph(live, EX + "graph/all").select("g", "s", "p", "o")


@register("a3_order_table_as_quads", sql("SELECT g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM live_q"))
def order_table_as_quads(spark, sf_dir):
    return fx.order_quads(fx.read(spark, sf_dir, "orders"))


@register(
    "a3_unpivot_table",
    """
    SELECT 'http://example.com/customer/'||c_custkey AS s, 'http://example.com/p/name' AS p, c_name AS o FROM customer
    UNION ALL SELECT 'http://example.com/customer/'||c_custkey, 'http://example.com/p/segment', c_mktsegment FROM customer""",
)
def unpivot_table(spark, sf_dir):
    customer = fx.read(spark, sf_dir, "customer")
    found = quads.unpivot_table(
        customer,
        F.lit(EX + "graph/customers"),
        F.concat(F.lit(fx.CUSTOMER), F.col("c_custkey").cast("string")),
        {"c_name": fx.P + "name", "c_mktsegment": fx.P + "segment"},
    )
    return found.select("s", "p", "o")


@register(
    "a4_graph_problems",
    sql(
        """SELECT s, p, o, CASE WHEN k % 5 = 0 THEN 'missing graph' ELSE 'blank node as graph' END AS reason
        FROM live_q WHERE k % 5 IN (0, 1)"""
    ),
)
def graph_problems(spark, sf_dir):
    live = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    k = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 5
    bad = live.withColumn("g", F.when(k == 1, F.lit("_:b")).when(k != 0, F.col("g")))
    return quads.graph_problems(bad).select("s", "p", "o", "reason")


@register(
    "a5_batches_by_graph",
    """
    SELECT chunk, g, batch, count(*) AS n FROM (
      SELECT chunk, g, (row_number() OVER (PARTITION BY chunk, g ORDER BY o_orderkey) - 1) // 100 AS batch FROM (
        SELECT o_orderkey, o_orderkey // 400 AS chunk, 'http://example.com/graph/'||(o_custkey % 3) AS g FROM orders))
    GROUP BY ALL""",
)
def batches_by_graph(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders").select(
        "o_orderkey", fx.graph_iri(F.col("o_custkey") % 3).alias("g")
    )
    numbered = quads.batch_by_graph(orders, "o_orderkey", size=100)
    return numbered.groupBy("chunk", "g", "batch").agg(F.count("*").alias("n"))


_LINE_SQL = """'<'||s||'> <'||p||'> '||CASE WHEN o_kind = 'iri' THEN '<'||o||'>'
  WHEN o_dt = 'http://www.w3.org/2001/XMLSchema#string' THEN '"'||o||'"' ELSE '"'||o||'"^^<'||o_dt||'>' END"""


@register("a6_export_quads", sql(f"SELECT {_LINE_SQL}||' <'||g||'> .' AS value FROM view_q"))
def export_quads(spark, sf_dir):
    return sinks.quad_lines(views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True))


@register(
    "a7_export_graph_triples",
    sql(f"SELECT DISTINCT {_LINE_SQL}||' .' AS value FROM view_q WHERE g = 'http://example.com/graph/2'"),
)
def export_graph_triples(spark, sf_dir):
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    return sinks.triple_lines(sinks.graph_triples(view, fx.GRAPH + "2"))


@register("a8_scope_statements", sql("SELECT g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM content WHERE draftset = 'ds-1'"))
def scope_statements(spark, sf_dir):
    return views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1)


@register("a9_statement_table", sql("SELECT s, p, o FROM live_q"))
def statement_table(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    return sinks.statement_table(views.live_view(snap.live, snap.managed_graphs))


def _status_bindings(spark, sf_dir):
    live = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    status = pt.pattern(live, "?order", pt.iri(fx.P + "priceCents"), "?cents", "?g")
    see = pt.pattern(live, "?order", pt.iri(fx.P + "seeAlso"), "?see", "?g")
    return pt.optional(status, see).select("order", "cents", "see")


_BINDING_SQL = """SELECT a.s AS order_, a.o AS cents, b.o AS see FROM live_q a
  LEFT JOIN live_q b ON a.s = b.s AND a.g = b.g AND b.p = 'http://example.com/p/seeAlso' WHERE a.p = 'http://example.com/p/priceCents'"""


@register("a10_csv_bindings", sql(f"SELECT order_ AS \"order\", cents, coalesce(see, '') AS see FROM ({_BINDING_SQL})"))
def csv_bindings(spark, sf_dir):
    return sinks.csv_bindings(_status_bindings(spark, sf_dir))


@register(
    "a10_tsv_bindings",
    sql(
        f"""SELECT '<'||order_||'>' AS "order", '"'||cents||'"^^<{XSD}integer>' AS cents,
        coalesce('<'||see||'>', '') AS see FROM ({_BINDING_SQL})"""
    ),
)
def tsv_bindings(spark, sf_dir):
    return sinks.tsv_bindings(_status_bindings(spark, sf_dir))


@register(
    "a10_json_bindings",
    sql(
        f"""SELECT '{{"order":{{"type":"uri","value":"'||order_||'"}},"cents":{{"type":"literal","value":"'||cents||
        '","datatype":"{XSD}integer"}}'||coalesce(',"see":{{"type":"uri","value":"'||see||'"}}', '')||'}}' AS value FROM ({_BINDING_SQL})"""
    ),
)
def json_bindings(spark, sf_dir):
    return sinks.json_bindings(_status_bindings(spark, sf_dir))


@register(
    "a10_boolean_result",
    sql("SELECT '{\"head\":{},\"boolean\":'||(count(*) > 0)||'}' AS value FROM live_q WHERE p = 'http://example.com/p/seeAlso'"),
)
def boolean_result(spark, sf_dir):
    live = fx.order_quads(fx.read(spark, sf_dir, "orders"))
    found = pt.pattern(live, "?s", pt.iri(fx.P + "seeAlso"), "?o", "?g")
    return sinks.boolean_result(pt.ask(found), "json")


GRAPHS_MADE, SEED = 20, 7
_HASH = "(CAST('0x'||substr(md5('7|{role}|'||{row}), 1, 8) AS BIGINT) % {modulo})"


def _h(role: str, row: str, modulo: int) -> str:
    return _HASH.format(role=role, row=row, modulo=modulo)


_PICKED = f"""
picked AS (SELECT *, CASE WHEN is_ref THEN {_h("positions", "row_id", 7)} + 1 ELSE 0 END AS bits,
  'http://example.com/graphs/'||({_h("target", "row_id", 20)} + 1) AS target, {_h("kind", "row_id", 7)} AS kind,
  {_h("number", "row_id", 100000)} AS num, substr(md5('7|word|'||row_id), 1, 12) AS word FROM made),
quads AS (SELECT row_id, is_ref, 'http://example.com/graphs/'||i AS g,
  CASE WHEN bits & 1 > 0 THEN target ELSE 'http://example.com/subject/'||md5('7|s|'||row_id) END AS s,
  CASE WHEN bits & 2 > 0 THEN target ELSE 'http://example.com/predicate/'||md5('7|p|'||row_id) END AS p,
  CASE WHEN bits & 4 > 0 THEN target WHEN kind <= 1 THEN word WHEN kind = 2 THEN CASE WHEN num % 2 = 1 THEN 'true' ELSE 'false' END
    WHEN kind = 3 THEN CAST(num AS VARCHAR) WHEN kind = 4 THEN (num // 100)||'.'||lpad(CAST(num % 100 AS VARCHAR), 2, '0')
    WHEN kind = 5 THEN strftime(DATE '2024-01-01' + CAST(num % 14 AS INTEGER), '%Y-%m-%d') ELSE 'http://example.com/object/'||md5('7|o|'||row_id) END AS o,
  CASE WHEN bits & 4 > 0 OR kind = 6 THEN 'iri' ELSE 'literal' END AS o_kind,
  CASE WHEN bits & 4 = 0 AND kind = 1 THEN ['en','es','fr','de'][num % 4 + 1] ELSE '' END AS o_lang
  FROM picked)
"""
_GENERATED = f"""
WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
made AS (SELECT o_orderkey AS row_id, o_custkey % 20 + 1 AS i, o_orderkey % 20 = 0 AS is_ref FROM orders),{_PICKED}"""


def _generated(spark, sf_dir):
    """A synthetic statement per order, in its customer's graph; one in twenty names a graph."""
    key = F.col("o_orderkey").cast("bigint")
    graph = (F.col("o_custkey") % GRAPHS_MADE + 1).cast("bigint")
    rows = fx.read(spark, sf_dir, "orders").select(key.alias("row_id"), graph.alias("graph_no"), (key % 20 == 0).alias("is_ref"))
    return generator.statements_from(rows, GRAPHS_MADE, SEED)


@register("a11_generate_quads", _GENERATED + "SELECT row_id, is_ref, g, s, p, o, o_kind, o_lang FROM quads")
def generate_quads(spark, sf_dir):
    return _generated(spark, sf_dir).select("row_id", "is_ref", "g", "s", "p", "o", "o_kind", "o_lang")


@register(
    "a11_generate_plan",
    f"""
    WITH total AS (SELECT count(*) AS n, count(*) * 15 // 100 AS r FROM orders),
    weights AS (SELECT i, {_h("size", "i", 65536)} + 1 AS w FROM (SELECT unnest(range(1, {GRAPHS_MADE + 1})) AS i)),
    shares AS (SELECT i, w * n // sum(w) OVER () AS part FROM weights, total),
    sizes AS (SELECT i, part + CASE WHEN i = {GRAPHS_MADE} THEN (SELECT n FROM total) - sum(part) OVER () ELSE 0 END AS size FROM shares),
    wanted AS (SELECT i, size, (size * r + n - 1) // n AS wanted FROM sizes, total),
    spread AS (SELECT i, size, coalesce(sum(size) OVER before, 0) AS start,
      greatest(0, least(wanted, (SELECT r FROM total) - coalesce(sum(wanted) OVER before, 0))) AS refs
      FROM wanted WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    made AS (SELECT (start + pos)::BIGINT AS row_id, i, pos < refs AS is_ref FROM (
      SELECT i, start, refs, unnest(range(size::BIGINT)) AS pos FROM spread)),{_PICKED}
    SELECT row_id, is_ref, g, s, p, o, o_kind, o_lang FROM quads""",
)
def generate_by_plan(spark, sf_dir):
    """As many statements as there are orders, in graphs of weighted sizes; 15 % of them mention a graph."""
    statements = fx.read(spark, sf_dir, "orders").count()
    made = generator.generate(spark, statements, GRAPHS_MADE, "15%", SEED)
    return made.select("row_id", "is_ref", "g", "s", "p", "o", "o_kind", "o_lang")


@register("a12_delete_subset", _GENERATED + "SELECT g, s, p, o FROM quads WHERE row_id < (SELECT n // 2 FROM n)")
def delete_subset(spark, sf_dir):
    n = fx.read(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    return generator.delete_subset(_generated(spark, sf_dir), n).select("g", "s", "p", "o")


@register("a13_verify_generated", _GENERATED + "SELECT g, count(*) AS statements FROM quads GROUP BY ROLLUP (g)")
def verify_generated(spark, sf_dir):
    return generator.verify(_generated(spark, sf_dir).select(*QUAD_COLS))
