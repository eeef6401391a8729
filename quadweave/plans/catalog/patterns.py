"""Pattern scans, filters, joins, limits and set operations over live and draft views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import scalars as S
from quadweave.functions import terms as T
from quadweave.operators import compare, lookup, state, times
from quadweave.operators import patterns as pt
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import P, sql
from quadweave.schema import local_table, struct


def live(spark, sf_dir):
    return fx.order_quads(fx.read(spark, sf_dir, "orders"))


def view(spark, sf_dir):
    return views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)


def plain(rows):
    """Term variables as their values."""
    return rows.select(*[F.col(f"`{c}`.value").alias(c) for c in rows.columns])


def of(quads, predicate, s="?s", o="?o", g="?g"):
    return pt.pattern(quads, s, pt.iri(P + predicate), o, g)


@register("b1_quad_pattern", sql("SELECT s, g FROM live_q WHERE p = 'http://example.com/p/seeAlso' AND o = g"))
def quad_pattern(spark, sf_dir):
    """Orders that name the graph they are in: one variable in two positions."""
    return plain(of(live(spark, sf_dir), "seeAlso", o="?g"))


@register("b2_projection", sql("SELECT s, o FROM view_q WHERE p = 'http://example.com/p/status'"))
def projection(spark, sf_dir):
    return plain(pt.select(of(view(spark, sf_dir), "status"), "s", "o"))


@register("b3_select_distinct", sql("SELECT DISTINCT g, o FROM view_q WHERE p = 'http://example.com/p/priority'"))
def select_distinct(spark, sf_dir):
    return plain(pt.select_distinct(of(view(spark, sf_dir), "priority"), "g", "o"))


@register(
    "b4_filter_comparisons",
    sql(
        """SELECT a.s, a.o AS cents, b.o AS status FROM live_q a JOIN live_q b ON a.s = b.s AND a.g = b.g
        WHERE a.p = 'http://example.com/p/priceCents' AND b.p = 'http://example.com/p/status'
        AND TRY_CAST(a.o AS BIGINT) > 30000000 AND b.o <> 'F'"""
    ),
)
def filter_comparisons(spark, sf_dir):
    """Value comparison on a cast, term inequality on a constant."""
    quads = live(spark, sf_dir)
    rows = pt.bgp(of(quads, "priceCents", o="?cents"), of(quads, "status", o="?status"))
    rows = rows.filter((T.as_integer(F.col("cents")) > 30_000_000) & (F.col("status") != T.literal("F")))
    return plain(rows.select("s", "cents", "status"))


@register(
    "b5_inline_values",
    sql("SELECT s, g FROM live_q WHERE p = 'http://example.com/p/status' AND o = 'F' AND g IN ('http://example.com/graph/1','http://example.com/graph/9')"),
)
def inline_values(spark, sf_dir):
    wanted = pt.values(spark, "g", [pt.iri(fx.GRAPH + "1"), pt.iri(fx.GRAPH + "9")])
    return plain(pt.join(of(live(spark, sf_dir), "status", o=pt.text("F")), wanted))


@register("b5_inline_values_empty", sql("SELECT s, g FROM live_q WHERE 1 = 0"))
def inline_values_empty(spark, sf_dir):
    wanted = pt.values(spark, "g", [])
    return plain(pt.join(of(live(spark, sf_dir), "status", o=pt.text("F")), wanted))


@register(
    "b6_bind",
    sql(
        """SELECT s, o, CASE WHEN o_dt = 'http://www.w3.org/2001/XMLSchema#integer' THEN TRY_CAST(o AS BIGINT) // 100 END AS whole
        FROM live_q WHERE p IN ('http://example.com/p/priceCents', 'http://example.com/p/priority')"""
    ),
)
def bind(spark, sf_dir):
    """A computed variable stays unbound where the cast fails."""
    quads = live(spark, sf_dir)
    rows = pt.union(of(quads, "priceCents"), of(quads, "priority"))
    rows = pt.bind(rows, "whole", F.floor(T.as_integer(F.col("o")) / 100))
    return rows.select(F.col("s.value").alias("s"), F.col("o.value").alias("o"), "whole")


@register(
    "b7_protected_graphs",
    sql(
        """SELECT graph, starts_with(graph, 'http://example.org/quadweave/graphs/') AS protected FROM
        (SELECT lg AS graph FROM part_graphs UNION ALL SELECT dg FROM part_drafts)"""
    ),
)
def protected_graphs(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    names = reg.managed_graphs.select(F.col("lg").alias("graph")).union(reg.draft_graphs.select("dg"))
    return names.withColumn("protected", S.is_protected(F.col("graph"), fx.VOCAB))


@register(
    "b8_user_graphs",
    sql("SELECT g, count(*) AS n FROM (SELECT g FROM view_q UNION ALL SELECT g FROM draft_q) WHERE g NOT LIKE 'http://example.org/quadweave/graphs/%' GROUP BY g"),
)
def user_graphs(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    names = view(spark, sf_dir).select("g").unionByName(snap.draft.select("g"))
    return names.filter(S.is_user_graph(F.col("g"), fx.VOCAB)).groupBy("g").agg(F.count("*").alias("n"))


@register("b9_write_guard", sql("SELECT g, count(*) AS n FROM draft_q GROUP BY g"))
def write_guard(spark, sf_dir):
    """Graphs a write would be refused for: quads already naming draft graphs."""
    snap = fx.snapshot(spark, sf_dir)
    mixed = snap.live.select("g").unionByName(snap.draft.select("g"))
    return state.protected_rows(mixed, fx.VOCAB, "g").groupBy("g").agg(F.count("*").alias("n"))


@register(
    "b10_existence_checks",
    sql(
        """SELECT w.lg, m.lg IS NOT NULL AS managed, coalesce(m.is_public, false) AS live, d.lg IS NOT NULL AS non_empty
        FROM (SELECT DISTINCT 'http://example.com/graph/part/'||(l_partkey * 2) AS lg FROM lineitem) w
        LEFT JOIN part_graphs m ON m.lg = w.lg LEFT JOIN part_graphs d ON d.lg = w.lg"""
    ),
)
def existence_checks(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    wanted = fx.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(fx.PART_GRAPH), (F.col("l_partkey") * 2).cast("string")).alias("lg")
    )
    return state.existence(wanted.distinct(), reg.managed_graphs, reg.names("live"))


@register("b11_draft_lookup", sql("SELECT draftset, lg, dg FROM part_drafts WHERE lg IN (SELECT lg FROM part_graphs WHERE is_public)"))
def draft_lookup(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return state.live_graphs(reg.managed_graphs).join(reg.draft_graphs, "lg").select("draftset", "lg", "dg")


@register(
    "c1_pattern_join",
    sql(
        """, part_of AS MATERIALIZED (SELECT g, s, o FROM view_q WHERE p = 'http://example.com/p/partOf'),
        ship AS MATERIALIZED (SELECT g, s, o FROM view_q WHERE p = 'http://example.com/p/shipDate'),
        home AS MATERIALIZED (SELECT s, o FROM view_q WHERE p = 'http://example.com/p/customer'),
        both_of AS MATERIALIZED (SELECT a.s AS line, a.o AS ord, c.o AS shipped FROM part_of a JOIN ship c ON c.s = a.s AND c.g = a.g)
        SELECT line, ord AS "order", home.o AS customer, shipped FROM both_of JOIN home ON home.s = both_of.ord"""
    ),
)
def pattern_join(spark, sf_dir):
    quads = view(spark, sf_dir)
    line = of(quads, "partOf", s="?line", o="?order")
    shipped = of(quads, "shipDate", s="?line", o="?shipped")
    customer = of(quads, "customer", s="?order", o="?customer", g="?home")
    rows = pt.bgp(line, shipped, customer)
    return plain(pt.select(rows, "line", "order", "customer", "shipped"))


@register(
    "c2_optional",
    sql(
        """, stat AS MATERIALIZED (SELECT g, s, o FROM view_q WHERE p = 'http://example.com/p/status'),
        see AS MATERIALIZED (SELECT g, s, o FROM view_q WHERE p = 'http://example.com/p/seeAlso')
        SELECT stat.s, stat.o AS status, see.o AS see FROM stat LEFT JOIN see ON see.s = stat.s AND see.g = stat.g"""
    ),
)
def optional(spark, sf_dir):
    quads = view(spark, sf_dir)
    rows = pt.optional(of(quads, "status", o="?status"), of(quads, "seeAlso", o="?see"))
    return plain(pt.select(rows, "s", "status", "see"))


@register(
    "c2_optional_shared_variable",
    sql(
        """SELECT ds.draftset, ds.submission AS x, u.permission FROM
          (SELECT draftset, submission FROM part_sets) ds
          LEFT JOIN (SELECT draftset, 'sub-'||k AS x, 'p'||(k % 3) AS permission FROM part_sets WHERE k % 2 = 0) u
          ON u.draftset = ds.draftset AND (ds.submission = u.x) WHERE ds.submission IS NOT NULL
        UNION ALL
        SELECT ds.draftset, u.x, u.permission FROM (SELECT draftset, submission FROM part_sets) ds
          LEFT JOIN (SELECT draftset, 'sub-'||k AS x, 'p'||(k % 3) AS permission FROM part_sets WHERE k % 2 = 0) u
          ON u.draftset = ds.draftset WHERE ds.submission IS NULL"""
    ),
)
def optional_shared_variable(spark, sf_dir):
    """Two optional patterns binding the same variable: the second fills it where the first did not."""
    reg = fx.registry(spark, sf_dir)
    sets = reg.draftsets.select(T.iri(F.col("draftset")).alias("draftset"))
    offered = reg.submissions.select(T.iri(F.col("draftset")).alias("draftset"), T.iri(F.col("submission")).alias("x"))
    k = F.col("s_suppkey")
    permitted = fx.read(spark, sf_dir, "supplier").filter(k % 2 == 0).select(
        T.iri(F.concat(F.lit("ds-"), k.cast("string"))).alias("draftset"),
        T.iri(F.concat(F.lit("sub-"), k.cast("string"))).alias("x"),
        T.literal(F.concat(F.lit("p"), (k % 3).cast("string"))).alias("permission"),
    )
    return plain(pt.optional(pt.optional(sets, offered), permitted, maybe_unbound=["x"]))


@register(
    "c3_filter_exists",
    sql(
        """SELECT s, o FROM live_q a WHERE p = 'http://example.com/p/status'
        AND EXISTS (SELECT 1 FROM live_q b WHERE b.s = a.s AND b.g = a.g AND b.p = 'http://example.com/p/seeAlso')"""
    ),
)
def filter_exists(spark, sf_dir):
    quads = live(spark, sf_dir)
    return plain(pt.select(pt.exists(of(quads, "status"), of(quads, "seeAlso", o="?see")), "s", "o"))


@register(
    "c4_filter_not_exists",
    sql(
        """SELECT s, o FROM live_q a WHERE p = 'http://example.com/p/status'
        AND NOT EXISTS (SELECT 1 FROM live_q b WHERE b.s = a.s AND b.g = a.g AND b.p = 'http://example.com/p/seeAlso')"""
    ),
)
def filter_not_exists(spark, sf_dir):
    quads = live(spark, sf_dir)
    return plain(pt.select(pt.not_exists(of(quads, "status"), of(quads, "seeAlso", o="?see")), "s", "o"))


@register(
    "c5_minus",
    sql(
        """SELECT s, o FROM live_q WHERE p = 'http://example.com/p/customer' AND s NOT IN
        (SELECT s FROM live_q WHERE p = 'http://example.com/p/status' AND o = 'F')"""
    ),
)
def minus(spark, sf_dir):
    """Removes orders with a status F; a pattern sharing no variable removes nothing."""
    quads = live(spark, sf_dir)
    finished = of(quads, "status", o=pt.text("F")).select("s")
    unrelated = of(quads, "priority", s="?other", o="?priority", g="?elsewhere")
    return plain(pt.select(pt.minus(pt.minus(of(quads, "customer"), finished), unrelated), "s", "o"))


@register(
    "c6_subselect_join",
    sql(
        """SELECT a.s, a.o AS customer, n.orders FROM live_q a JOIN
        (SELECT o, count(*) AS orders FROM live_q WHERE p = 'http://example.com/p/customer' GROUP BY o) n ON n.o = a.o
        WHERE a.p = 'http://example.com/p/customer'"""
    ),
)
def subselect_join(spark, sf_dir):
    quads = live(spark, sf_dir)
    rows = of(quads, "customer", o="?customer")
    counts = rows.groupBy("customer").agg(F.count("*").alias("orders"))
    joined = pt.join(rows, counts)
    return joined.select(F.col("s.value").alias("s"), F.col("customer.value").alias("customer"), "orders")


@register(
    "c7_mapping_lookup",
    sql(
        """SELECT l.g, l.s, l.p, CASE WHEN l.o_kind = 'iri' THEN coalesce(d.dg, l.o) ELSE l.o END AS o FROM live_q l
        LEFT JOIN dgs d ON d.draftset = 'ds-1' AND d.lg = l.o"""
    ),
)
def mapping_lookup(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    pairs = snap.draft_graphs.filter(F.col("draftset") == fx.DS1)
    return lookup.translate(snap.live, pairs, "lg", "dg").select("g", "s", "p", "o")


@register(
    "c8_keyed_merge",
    sql(
        """SELECT coalesce(a.graph, b.graph) AS graph, epoch_us(CASE WHEN a.modified > b.modified THEN TIMESTAMP '2024-03-01 12:00:00'
          ELSE coalesce(b.modified, a.modified) END) AS modified
        FROM (SELECT 'u'||(user_id % 500) AS graph, max(ts) AS modified FROM events WHERE event_type <> 'click' GROUP BY ALL) a
        FULL JOIN (SELECT 'u'||(user_id % 300) AS graph, max(ts) AS modified FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.graph = b.graph"""
    ),
)
def keyed_merge(spark, sf_dir):
    """Union of keys; on conflict the draft time, or the time of the merge when the live one is later."""
    events = fx.read(spark, sf_dir, "events")

    def latest(rows, modulo):
        key = F.concat(F.lit("u"), (F.col("user_id") % modulo).cast("string")).alias("graph")
        return rows.groupBy(key).agg(F.max(F.col("ts").cast("timestamp")).alias("modified"))

    click = F.col("event_type") == "click"
    merged = times.merge_times(latest(events.filter(~click), 500), latest(events.filter(click), 300), fx.NOW)
    return merged.select("graph", F.unix_micros("modified").alias("modified"))


@register("c9_key_intersection", sql("SELECT d.draftset, d.lg, d.dg, m.is_public FROM part_drafts d JOIN part_graphs m USING (lg)"))
def key_intersection(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return reg.draft_graphs.join(reg.managed_graphs, "lg").select("draftset", "lg", "dg", "is_public")


@register(
    "c10_join_on_graph",
    sql(
        """SELECT a.s, a.o AS named, count(*) AS statements FROM view_q a JOIN view_q b ON b.g = a.o
        WHERE a.p = 'http://example.com/p/seeAlso' AND b.p = 'http://example.com/p/status' AND b.o = 'P' GROUP BY ALL"""
    ),
)
def join_on_graph(spark, sf_dir):
    """GRAPH ?named with ?named bound by another pattern. Counts per graph come first, so a graph of
    any size meets the join as one row."""
    quads = view(spark, sf_dir)
    named = of(quads, "seeAlso", o="?named")
    inside = of(quads, "status", s="?x", o=pt.text("P"), g="?named").groupBy("named").agg(F.count("*").alias("statements"))
    rows = pt.join(named.groupBy("s", "named").agg(F.count("*").alias("_n")), inside)
    return rows.select(
        F.col("s.value").alias("s"), F.col("named.value").alias("named"), (F.col("_n") * F.col("statements")).alias("statements")
    )


_CENTS = "SELECT s, g, CAST(o AS BIGINT) AS cents FROM view_q WHERE p = 'http://example.com/p/priceCents'"


def _cents_rows(spark, sf_dir):
    rows = of(view(spark, sf_dir), "priceCents")
    return rows.select(F.col("s.value").alias("s"), F.col("g.value").alias("g"), T.as_integer(F.col("o")).alias("cents"))


@register("f1_order_by", sql(f"SELECT g, cents, s FROM ({_CENTS}) ORDER BY cents DESC, s DESC"))
def order_by(spark, sf_dir):
    return _cents_rows(spark, sf_dir).orderBy(F.desc("cents"), F.desc("s")).select("g", "cents", "s")


@register("f2_limit_offset", sql(f"SELECT s, cents FROM ({_CENTS}) ORDER BY cents DESC, s LIMIT 20 OFFSET 10"))
def limit_offset(spark, sf_dir):
    return _cents_rows(spark, sf_dir).orderBy(F.desc("cents"), "s").offset(10).limit(20).select("s", "cents")


@register("f3_first_or_error", sql("SELECT s, o FROM live_q WHERE p = 'http://example.com/p/status' AND s = 'http://example.com/order/5'"))
def first_or_error(spark, sf_dir):
    found = plain(pt.select(of(live(spark, sf_dir), "status", s="?s").filter(F.col("s.value") == fx.ORDER + "5"), "s", "o"))
    row = pt.first_or_error(found)
    return local_table(spark, [row] if row else [], struct("s STRING, o STRING"))


@register("f4_top_one_by_time", sql("SELECT graph, epoch_us(modified) AS modified FROM times WHERE scope = 'live' ORDER BY times.modified DESC, graph LIMIT 1"))
def top_one_by_time(spark, sf_dir):
    snap = fx.derived_snapshot(spark, sf_dir)
    rows = times.modification_times(snap.graph_modified).orderBy(F.desc_nulls_last("modified"), "graph").limit(1)
    return rows.select("graph", F.unix_micros("modified").alias("modified"))


@register("f5_reduced", sql("SELECT g, o FROM live_q WHERE p = 'http://example.com/p/status'"))
def reduced(spark, sf_dir):
    return plain(pt.reduced(pt.select(of(live(spark, sf_dir), "status"), "g", "o")))


@register(
    "g1_union_of_patterns",
    sql(
        """SELECT s, o AS status, NULL AS see FROM live_q WHERE p = 'http://example.com/p/status'
        UNION ALL SELECT s, NULL, o FROM live_q WHERE p = 'http://example.com/p/seeAlso'"""
    ),
)
def union_of_patterns(spark, sf_dir):
    quads = live(spark, sf_dir)
    rows = pt.union(of(quads, "status", o="?status"), of(quads, "seeAlso", o="?see"))
    return plain(pt.select(rows, "s", "status", "see"))


@register(
    "g2_visible_graphs",
    sql("SELECT lg FROM part_drafts WHERE draftset = 'ds-1' UNION SELECT lg FROM part_graphs WHERE is_public"),
)
def visible_graphs(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return views.visible_graphs(state.mapping(reg.draft_graphs, reg.managed_graphs, "ds-1"), reg.managed_graphs, True)


@register(
    "g3_raw_graphs",
    sql(
        """SELECT lg AS graph FROM part_graphs WHERE is_public AND lg NOT IN (SELECT lg FROM part_drafts WHERE draftset = 'ds-1')
        UNION SELECT dg FROM part_drafts WHERE draftset = 'ds-1'"""
    ),
)
def raw_graphs(spark, sf_dir):
    reg = fx.derived_registry(spark, sf_dir)
    return views.raw_graphs(state.mapping(reg.draft_graphs, reg.managed_graphs, "ds-1"), reg.managed_graphs, True)


@register(
    "g4_restrict_dataset",
    sql(
        """SELECT 'named' AS part, g, count(*) AS n FROM view_q WHERE g IN ('http://example.com/graph/2','http://example.com/graph/16','http://example.com/graph/99') GROUP BY g
        UNION ALL SELECT 'default', g, count(*) FROM view_q WHERE g = 'http://example.com/graph/5' GROUP BY g"""
    ),
)
def restrict_dataset(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    quads = views.draft_view(snap, fx.DS1, union_with_live=True)
    pairs = state.mapping(snap.draft_graphs, snap.managed_graphs, fx.DS1)
    visible = views.visible_graphs(pairs, snap.managed_graphs, True)
    asked = views.Dataset(default=[fx.GRAPH + "5"], named=[fx.GRAPH + n for n in ("2", "16", "99")])
    default, named = views.restrict(asked, visible)
    parts = [("default", default), ("named", named)]
    counted = [
        views.named_graphs(quads, gs).groupBy("g").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "g", "n")
        for name, gs in parts
    ]
    return counted[0].unionByName(counted[1])


@register(
    "g5_rdf_merge",
    sql("SELECT DISTINCT s, p, o FROM (SELECT * EXCLUDE k FROM live_q UNION ALL SELECT * EXCLUDE draftset FROM content WHERE draftset = 'ds-2')"),
)
def rdf_merge(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    both = snap.live.unionByName(views.draft_view(snap, fx.DS2))
    return views.default_graph(both).select("s", "p", "o")


@register(
    "g6_key_diff",
    sql(
        """SELECT coalesce(a.graph, b.graph) AS graph, CASE WHEN a.graph IS NULL THEN 'new' WHEN b.graph IS NULL THEN 'unmodified' ELSE 'modified' END AS change
        FROM (SELECT DISTINCT 'u'||(user_id % 500) AS graph FROM events WHERE event_type <> 'click') a
        FULL JOIN (SELECT DISTINCT 'u'||(user_id % 700) AS graph FROM events WHERE event_type = 'click') b ON a.graph = b.graph"""
    ),
)
def key_diff(spark, sf_dir):
    events = fx.read(spark, sf_dir, "events")

    def latest(rows, modulo):
        key = F.concat(F.lit("u"), (F.col("user_id") % modulo).cast("string")).alias("graph")
        return rows.groupBy(key).agg(F.max(F.col("ts").cast("timestamp")).alias("modified"))

    click = F.col("event_type") == "click"
    merged = times.merge_times(latest(events.filter(~click), 500), latest(events.filter(click), 700), fx.NOW)
    return merged.select("graph", "change")


@register(
    "g7_quad_difference",
    sql("SELECT g, s, p, o FROM live_q EXCEPT SELECT g, s, p, o FROM content WHERE draftset = 'ds-2'"),
)
def quad_difference(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    return lookup.minus(snap.live, views.draft_view(snap, fx.DS2)).select("g", "s", "p", "o")


@register(
    "g7_difference_by_digests",
    sql(
        """, later AS (SELECT g, s, p, CASE WHEN g = 'http://example.com/graph/3' AND p = 'http://example.com/p/status' AND k % 97 = 0 THEN 'lost' ELSE o END AS o
          FROM live_q WHERE NOT (g = 'http://example.com/graph/7' AND k % 5 = 0) AND g <> 'http://example.com/graph/11')
        SELECT 1 AS side, * FROM (SELECT g, s, p, o FROM live_q EXCEPT SELECT * FROM later)
        UNION ALL SELECT -1, * FROM (SELECT * FROM later EXCEPT SELECT g, s, p, o FROM live_q)"""
    ),
)
def difference_by_digests(spark, sf_dir):
    """The published quads against a later state: some changed in one graph, some gone in another, one graph gone."""
    live = fx.snapshot(spark, sf_dir).live
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    of_graph = lambda n: F.col("g") == fx.GRAPH + str(n)
    changed = of_graph(3) & (F.col("p") == fx.P + "status") & (number % 97 == 0)
    later = live.filter(~(of_graph(7) & (number % 5 == 0)) & ~of_graph(11))
    return compare.gaps(live, later.withColumn("o", F.when(changed, "lost").otherwise(F.col("o")))).select("side", "g", "s", "p", "o")
