"""Counts, joined strings, versions, sizes and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import scalars as S
from quadweave.operators import patterns as pt
from quadweave.operators import slices, state, times, workflow
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import sql


@register("d1_bounded_counts", sql("SELECT g, least(count(*), 3001) AS size FROM view_q GROUP BY g"))
def bounded_counts(spark, sf_dir):
    """From the counts that every commit keeps: no quad is read."""
    return state.bounded(views.sizes(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True), 3000)


@register("d1_counted_sizes", sql("SELECT g, least(count(*), 3001) AS size FROM view_q GROUP BY g"))
def counted_sizes(spark, sf_dir):
    """The same for any quads, by counting them."""
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    return state.bounded_counts(view, 3000)


@register("d2_more_than_one_draft", sql("SELECT lg, count(*) AS drafts FROM part_drafts GROUP BY lg HAVING count(*) > 1"))
def more_than_one_draft(spark, sf_dir):
    return state.many_drafts(fx.registry(spark, sf_dir).draft_graphs)


@register(
    "d3_group_concat",
    sql(
        """SELECT draftset, coalesce(string_agg(DISTINCT view_user, ' ' ORDER BY view_user), '') AS users,
        coalesce(string_agg(DISTINCT view_permission, ' ' ORDER BY view_permission), '') AS permissions FROM part_shares GROUP BY draftset"""
    ),
)
def group_concat(spark, sf_dir):
    shares = fx.derived_registry(spark, sf_dir).shares
    users = pt.group_concat(shares, ["draftset"], F.col("view_user"), distinct=True, name="users")
    permissions = pt.group_concat(shares, ["draftset"], F.col("view_permission"), distinct=True, name="permissions")
    return users.join(permissions, "draftset")


@register(
    "d4_latest_modified",
    sql(
        """, w AS (SELECT lg AS graph FROM managed UNION SELECT dg FROM dgs WHERE draftset = 'ds-1'),
        l AS (SELECT max(modified) AS livemod FROM times WHERE scope = 'live' AND graph IN (SELECT graph FROM w) AND graph IN (SELECT lg FROM managed WHERE is_public)),
        d AS (SELECT max(modified) AS draftmod FROM times WHERE scope = 'ds-1' AND graph IN (SELECT graph FROM w))
        SELECT epoch_us(livemod) AS livemod, epoch_us(draftmod) AS draftmod, 'http://example.org/quadweave/version/'||
          CASE WHEN draftmod IS NULL THEN md5('public') ELSE md5(least(md5('ds-1'), md5('public'))||greatest(md5('ds-1'), md5('public'))) END AS version FROM l, d"""
    ),
)
def latest_modified(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    graphs = snap.managed_graphs.select(F.col("lg").alias("graph")).union(
        snap.draft_graphs.filter(F.col("draftset") == fx.DS1).select("dg")
    )
    row = times.latest_modified(snap, graphs, fx.VOCAB)
    return row.select(F.unix_micros("livemod").alias("livemod"), F.unix_micros("draftmod").alias("draftmod"), "version")


@register(
    "d5_merged_versions",
    """SELECT l_orderkey AS scope, 'http://example.org/quadweave/version/'||md5(string_agg(v, '' ORDER BY v)) AS version
    FROM (SELECT l_orderkey, md5(l_partkey||'-'||l_linenumber) AS v FROM lineitem) GROUP BY l_orderkey""",
)
def merged_versions(spark, sf_dir):
    """One version of a few endpoints each, a scope per order: the merge collects the versions of one scope."""
    line = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    versions = fx.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scope"), S.version_iri(F.md5(line), fx.VOCAB).alias("v")
    )
    return versions.groupBy("scope").agg(S.merged_version(F.collect_list("v"), fx.VOCAB).alias("version"))


@register(
    "d6_merged_endpoints",
    sql(
        """SELECT draftset, epoch_us(greatest(modified, TIMESTAMP '2020-01-02')) AS modified, 'http://example.org/quadweave/version/'||
          md5(least(md5(CAST(k AS VARCHAR)), md5('public'))||greatest(md5(CAST(k AS VARCHAR)), md5('public'))) AS version FROM part_sets"""
    ),
)
def merged_endpoints(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    merged = workflow.merge_public(reg.draftsets, reg.endpoints, fx.VOCAB)
    return merged.select("draftset", F.unix_micros("modified").alias("modified"), "version")


_STATUS = """CASE WHEN m.is_public AND d.filled THEN 'updated' WHEN NOT m.is_public AND d.filled THEN 'created' ELSE 'deleted' END"""


@register(
    "d7_changes_per_draftset",
    sql(
        f"""SELECT d.draftset, string_agg(d.lg||'='||{_STATUS}, ' ' ORDER BY d.lg) AS changes
        FROM part_drafts d JOIN part_graphs m USING (lg) GROUP BY d.draftset"""
    ),
)
def changes_per_draftset(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    maps = state.changes_map(state.change_rows(reg.draft_graphs, reg.managed_graphs, reg.names("draft")))
    shown = F.transform(F.map_entries("changes"), lambda e: F.concat_ws("=", e["key"], e["value"]["status"]))
    return maps.select("draftset", F.concat_ws(" ", shown).alias("changes"))


@register("d8_size_totals", "SELECT CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def size_totals(spark, sf_dir):
    files = fx.read(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_bytes"))
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"))


_SHORT = "['append','delete','publish'][l_suppkey % 3 + 1]"


@register(
    "d9_benchmark_slices",
    f"""
    WITH runs AS (SELECT DISTINCT {_SHORT} AS short_name, (l_partkey % 10 + 1) * 1000 AS statements, l_quantity::BIGINT AS graphs,
      (l_suppkey % 4) AS ref_statements, 'v'||(l_linenumber % 2) AS version FROM lineitem),
    scored AS (SELECT *, statements + graphs + ref_statements AS score FROM runs)
    SELECT version, 'statements' AS x_axis, short_name, NULL::BIGINT AS statements, graphs, ref_statements,
      string_agg(statements||':'||score, ' ' ORDER BY statements) AS points FROM scored GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT version, 'graphs', short_name, statements, NULL, ref_statements,
      string_agg(graphs||':'||score, ' ' ORDER BY graphs) FROM scored GROUP BY version, short_name, statements, ref_statements HAVING count(*) > 1
    UNION ALL SELECT version, 'ref_statements', short_name, statements, graphs, NULL,
      string_agg(ref_statements||':'||score, ' ' ORDER BY ref_statements) FROM scored GROUP BY version, short_name, statements, graphs HAVING count(*) > 1""",
)
def benchmark_slices(spark, sf_dir):
    """Benchmark names built from line items, parsed back and cut into chart series."""
    line = fx.read(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    short = F.element_at(F.array(*map(F.lit, ["append", "delete", "publish"])), (supp % 3 + 1).cast("int"))
    thousands, graphs, refs = part % 10 + 1, F.col("l_quantity").cast("bigint"), supp % 4
    name = F.concat(
        F.lit("org.bench."), short, F.lit("Test_"), thousands.cast("string"), F.lit("k_"), graphs.cast("string"), F.lit("g_"),
        refs.cast("string"), F.lit("p"),
    )
    results = line.select(
        name.alias("benchmark"),
        (thousands * 1000 + graphs + refs).alias("score"),
        F.lit("s").alias("unit"),
        F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string")).alias("version"),
    ).distinct()
    parsed, _ = slices.parse_benchmarks(results)
    found = slices.slices(parsed)
    points = F.concat_ws(" ", F.transform(F.arrays_zip("x", "y"), lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))))
    return found.select("version", "x_axis", "short_name", "statements", "graphs", "ref_statements", points.alias("points"))


@register("d10_distinct_count", sql("SELECT count(*) AS n FROM (SELECT DISTINCT s, p FROM view_q)"))
def distinct_count(spark, sf_dir):
    view = views.draft_view(fx.snapshot(spark, sf_dir), fx.DS1, union_with_live=True)
    return view.select("s", "p").distinct().agg(F.count("*").alias("n"))


