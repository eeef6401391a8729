"""Query forms over live and draft views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.operators import lookup, rewrite, state
from quadweave.operators import patterns as pt
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.catalog.patterns import of, plain
from quadweave.plans.fixtures import sql

_COLS = "g,s,s_kind,p,o,o_kind,o_dt,o_lang"


def _raw(spark, sf_dir):
    """Stored quads behind the first draftset's view, not yet under published names."""
    snap = fx.snapshot(spark, sf_dir)
    pairs = state.mapping(snap.draft_graphs, snap.managed_graphs, fx.DS1)
    graphs = views.raw_graphs(pairs, snap.managed_graphs, True)
    return lookup.keep(snap.live.unionByName(snap.draft), graphs, key="graph"), pairs, snap


@register(
    "q1_select_on_draft",
    sql("SELECT s, o AS see, g FROM view_q WHERE p = 'http://example.com/p/seeAlso'"),
)
def select_on_draft(spark, sf_dir):
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    return plain(pt.select(of(view, "seeAlso", o="?see"), "s", "see", "g"))


@register("q2_ask", sql("SELECT count(*) > 0 AS answer FROM view_q WHERE p = 'http://example.com/p/shipDate' AND g = 'http://example.com/graph/16'"))
def ask(spark, sf_dir):
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    return pt.ask(of(view, "shipDate", g=pt.iri(fx.GRAPH + "16")))


@register(
    "q3_construct",
    sql(
        """SELECT DISTINCT a.s, 'http://example.com/p/boughtBy' AS p, a.o FROM view_q a WHERE a.p = 'http://example.com/p/customer'
        UNION SELECT a.o, 'http://example.com/p/looksAt', b.o FROM view_q a JOIN view_q b ON a.s = b.s AND a.g = b.g
        WHERE a.p = 'http://example.com/p/customer' AND b.p = 'http://example.com/p/seeAlso'"""
    ),
)
def construct(spark, sf_dir):
    """Unbound ?see drops the second triple; the literal subject of the third is never legal."""
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    rows = pt.optional(of(view, "customer", o="?customer"), of(view, "seeAlso", o="?see"))
    template = [
        ("?s", pt.iri(fx.P + "boughtBy"), "?customer"),
        ("?customer", pt.iri(fx.P + "looksAt"), "?see"),
        (pt.text("no"), pt.iri(fx.P + "looksAt"), "?see"),
    ]
    return pt.construct(rows, template).select("s", "p", "o")


@register(
    "q4_describe",
    sql(
        """SELECT DISTINCT s, p, o FROM view_q WHERE s IN
        (SELECT o FROM view_q WHERE p = 'http://example.com/p/partOf' AND g = 'http://example.com/graph/16')"""
    ),
)
def describe(spark, sf_dir):
    """Everything about the orders that new line items belong to."""
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    wanted = of(view, "partOf", o="?order", g=pt.iri(fx.GRAPH + "16")).select("order")
    return pt.describe(view, wanted).select("s", "p", "o")


@register("q5_live_view", sql(f"SELECT {_COLS} FROM live_q WHERE g IN (SELECT lg FROM managed WHERE is_public)"))
def live_view(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    return views.live_view(snap.live, snap.managed_graphs)


@register("q6_draft_view", sql(f"SELECT {_COLS} FROM content WHERE draftset = 'ds-2'"))
def draft_view(spark, sf_dir):
    return views.draft_view(fx.snapshot(spark, sf_dir), fx.DS2)


@register("q6_draft_view_union_live", sql(f"SELECT {_COLS} FROM view_q"))
def draft_view_union_live(spark, sf_dir):
    return views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)


@register(
    "q7_effective_dataset",
    sql(
        """SELECT 'user' AS "case", count(*) AS n FROM (SELECT DISTINCT s, p, o FROM view_q WHERE g IN ('http://example.com/graph/2','http://example.com/graph/7'))
        UNION ALL SELECT 'query', count(*) FROM (SELECT DISTINCT s, p, o FROM view_q WHERE g = 'http://example.com/graph/0')
        UNION ALL SELECT 'invisible', 0
        UNION ALL SELECT 'unstated', count(*) FROM (SELECT DISTINCT s, p, o FROM view_q)"""
    ),
)
def effective_dataset(spark, sf_dir):
    """User dataset over query dataset; nothing visible means no rows, nothing stated means all."""
    snap = fx.snapshot(spark, sf_dir)
    view = views.draft_view(snap, fx.DS1, union_with_live=True)
    pairs = state.mapping(snap.draft_graphs, snap.managed_graphs, fx.DS1)
    visible = lookup.local(views.visible_graphs(pairs, snap.managed_graphs, True))
    in_query = views.Dataset(default=[fx.GRAPH + "0"])
    cases = {
        "user": (in_query, views.Dataset(default=[fx.GRAPH + "2", fx.GRAPH + "7"])),
        "query": (in_query, views.Dataset()),
        "invisible": (views.Dataset(default=[fx.GRAPH + "99"]), views.Dataset()),
        "unstated": (views.Dataset(), views.Dataset()),
    }
    parts = []
    for name, (query, user) in cases.items():
        default, _ = views.restrict(views.effective_dataset(query, user), visible)
        merged = views.default_graph(view, default)
        parts.append(merged.agg(F.count("*").alias("n")).select(F.lit(name).alias("case"), "n"))
    return pt.union(*parts)


@register(
    "q8_rewritten_constants",
    sql(
        """SELECT s, 'iri' AS kind FROM view_q WHERE p = 'http://example.com/p/seeAlso' AND o = 'http://example.com/graph/16' AND g = 'http://example.com/graph/2'
        UNION ALL SELECT s, 'literal' FROM view_q WHERE 1 = 0"""
    ),
)
def rewritten_constants(spark, sf_dir):
    """A pattern over stored quads: IRI constants map to draft names, a literal that looks like one does not."""
    raw, pairs, _ = _raw(spark, sf_dir)
    names = rewrite.names_of(pairs, [fx.GRAPH + "2", fx.GRAPH + "16"])
    graph = pt.iri(rewrite.rewrite_constant(names, fx.GRAPH + "2"))
    target = pt.iri(rewrite.rewrite_constant(names, fx.GRAPH + "16"))
    as_text = pt.text(rewrite.rewrite_constant(names, fx.GRAPH + "16", "literal"))
    rows = of(raw, "seeAlso", o=target, g=graph).withColumn("kind", F.lit("iri")).unionByName(
        of(raw, "seeAlso", o=as_text, g=graph).withColumn("kind", F.lit("literal"))
    )
    return rewrite.rewrite_bindings(rows, pairs).select(F.col("s.value").alias("s"), "kind")


@register("q9_rewritten_parameters", sql("SELECT s, o FROM view_q WHERE g = 'http://example.com/graph/3' AND p = 'http://example.com/p/partOf'"))
def rewritten_parameters(spark, sf_dir):
    """A pre-bound graph variable, set under its published name."""
    raw, pairs, _ = _raw(spark, sf_dir)
    names = rewrite.names_of(pairs, [fx.GRAPH + "3"])
    bound = rewrite.rewrite_parameters(names, {"g": (fx.GRAPH + "3", "iri")})
    back = rewrite.rewrite_parameters({v: k for k, v in names.items()}, bound)
    if back != {"g": (fx.GRAPH + "3", "iri")}:
        raise AssertionError(back)
    return plain(of(raw, "partOf", g=pt.iri(bound["g"][0])).select("s", "o"))


@register("q10_rewritten_results", sql("SELECT s, p, o, g FROM view_q"))
def rewritten_results(spark, sf_dir):
    """Every column of a result over stored quads shown under published names."""
    raw, pairs, _ = _raw(spark, sf_dir)
    rows = raw.select(T.subject_term().alias("s"), T.predicate_term().alias("p"), T.object_term().alias("o"), T.graph_term().alias("g"))
    return plain(rewrite.rewrite_bindings(rows, pairs))


@register(
    "changed_graphs_report",
    sql(
        """SELECT lg AS g, CAST(count(DISTINCT s||' '||p||' '||o) AS BIGINT) AS statements, count(DISTINCT s) AS subjects,
        CASE WHEN lg NOT IN (SELECT lg FROM dgs WHERE draftset = 'ds-1') THEN 'unchanged' WHEN lg = 'http://example.com/graph/4' THEN 'deleted'
          WHEN lg IN ('http://example.com/graph/16', 'http://example.com/graph/17') THEN 'created' ELSE 'updated' END AS status
        FROM managed LEFT JOIN view_q ON g = lg WHERE lg LIKE 'http://example.com/%' GROUP BY lg"""
    ),
)
def changed_graphs_report(spark, sf_dir):
    """The flagship: each visible graph of the draft over live, its size, and what happened to it."""
    return views.changed_graphs_report(fx.snapshot(spark, sf_dir), fx.DS1, fx.VOCAB)
