"""What storing quads and deriving them from tables costs: shuffles of numbers, not of quads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quadweave.functions import terms as T
from quadweave.operators import graphs, lookup, update, validate
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.workspace import Workspace
from quadweave.schema import QUAD_COLS, XSD, local_table, struct
from quadweave.sources import quads as source
from quadweave.sources.quads import from_table

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in x]


def test_every_task_writes_its_own_rows(spark, tmp_path):
    number = F.col("id").cast("string")
    quads = from_table(spark.range(0, 30, 1, 3), F.lit("g"), F.concat(F.lit("s"), number), {"p": T.iri(number)})
    space = Workspace(spark, str(tmp_path / "space"), buckets=4)
    written = space._write_quads(quads, str(tmp_path / "quads"), 4)
    (path,) = written.values()
    assert len(list((tmp_path / "quads").glob("bucket=*/*.parquet"))) == 3
    assert spark.read.parquet(path).select(*QUAD_COLS).exceptAll(quads).isEmpty()
    assert spark.read.parquet(path).count() == 30


def _lines(spark):
    day = [dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 9), dt.datetime(1960, 5, 6), None]
    rows = [
        (20, 4, 1, 1, 2.0, "F", day[0]),
        (20, 4, 1, 1, 2.0, "F", day[0]),
        (20, 4, 1, 1, 3.0, "F", day[1]),
        (20, 40, 1, 1, 2.0, "F", day[2]),
        (None, 4, 1, 1, 2.0, "F", day[0]),
        (None, 4, 1, 2, 2.0, "F", day[0]),
        (20, 4, 1, None, 2.0, "F", day[0]),
        (20, None, 1, 3, 2.0, "F", day[3]),
        (40, 4, None, 1, 2.0, "F", day[3]),
        (40, None, None, 1, 2.0, "F", day[3]),
        (40, 4, 1, 1, None, "F", day[3]),
    ]
    schema = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    return spark.createDataFrame(rows, schema)


def test_lines_are_a_set_made_from_numbers(spark, monkeypatch):
    monkeypatch.setattr(source, "DEALT_ROWS", 3)
    lines = _lines(spark)
    made = fx.line_quads(lines)
    before = exchanges(made)
    homes = F.array(*map(F.lit, fx.DS1_CHANGED + fx.DS1_NEW))
    see = F.when(F.col("l_orderkey") % 20 == 0, fx.graph_iri(F.expr("(l_partkey div 18) % 18")))
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    plain = from_table(
        lines,
        fx.graph_iri(F.element_at(homes, (F.col("l_partkey") % 6 + 1).cast("int"))),
        F.concat(F.lit(fx.LINE), order, F.lit("-"), line),
        {
            fx.P + "shipDate": T.literal(T.date_lexical(F.col("l_shipdate")), XSD + "date"),
            fx.P + "partOf": T.iri(F.concat(F.lit(fx.ORDER), order)),
            fx.P + "seeAlso": T.iri(see),
        },
    ).distinct()
    assert sorted(map(repr, made.select(*QUAD_COLS).collect())) == sorted(map(repr, plain.select(*QUAD_COLS).collect()))
    assert {(r.g, r.o) for r in made.collect() if r.s == fx.LINE + "20-3"} == {(None, fx.ORDER + "20")}
    assert len(before) == 1 and "hashpartitioning(order" in before[0]


def test_lines_are_dealt_as_flat_numbers_and_drafts_deal_the_orders_they_clone(spark, monkeypatch):
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"
    orders = spark.createDataFrame([(k, k if k else None, "O", "1", 2.0, None) for k in range(40)], schema)
    dealt, deal = [], fx.deal
    monkeypatch.setattr(fx, "deal", lambda df, *by: dealt.append(df) or deal(df, *by))
    contents = fx.draft_contents(orders, _lines(spark))
    of_orders, of_lines = sorted(dealt, key=lambda df: "line" in df.columns)
    assert {r.o_custkey % 16 for r in of_orders.collect()} == {0, 1, 2, 3, 5}
    assert {kind for _, kind in of_lines.dtypes} <= {"int", "bigint"}
    live = fx.order_quads(orders)
    for draftset, graphs, left in ((fx.DS1, fx.DS1_CHANGED, 7), (fx.DS2, fx.DS2_CHANGED, 11)):
        cloned = fx.in_graphs(live, graphs).filter(fx._order_number() % left != 0)
        whole = contents[draftset].filter(F.startswith("s", F.lit(fx.ORDER)))
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, cloned.collect())) != []


def test_quads_are_stored_by_what_differs_from_the_quad_before(spark, tmp_path):
    number = F.format_string("%07d", F.col("id"))
    quads = from_table(spark.range(0, 60_000, 1, 1), F.lit("g"), F.concat(F.lit("http://example.com/s/"), number), {"p": T.literal(F.lit("o"))})
    space = Workspace(spark, str(tmp_path / "space"), buckets=4)
    (path,) = space._write_quads(quads, str(tmp_path / "quads"), 4).values()
    (file,) = (tmp_path / "quads").glob("bucket=*/*.parquet")
    quads.sortWithinPartitions("s").write.parquet(str(tmp_path / "plain"))
    (plain,) = (tmp_path / "plain").glob("*.parquet")
    assert file.stat().st_size * 2 < plain.stat().st_size
    assert spark.read.parquet(path).select(*QUAD_COLS).exceptAll(quads).isEmpty()


def test_a_draft_of_the_registry_is_a_set_made_from_numbers(spark, monkeypatch):
    read = fx.read
    monkeypatch.setattr(source, "DEALT_ROWS", 3)
    monkeypatch.setattr(fx, "read", lambda s, d, name: _lines(s) if name == "lineitem" else read(s, d, name))
    draft = fx.derived_registry(spark, SF).draft
    assert len(exchanges(draft)) == 1 and "hashpartitioning(l_orderkey" in exchanges(draft)[0]
    rows = draft.collect()
    assert len(rows) == len(set(rows)) == 7


@pytest.mark.parametrize("name", ["f4_top_one_by_time", "g3_raw_graphs", "d3_group_concat", "h16_publish_state"])
def test_bookkeeping_alone_stores_no_quads(spark, monkeypatch, name):
    expected = entry.queries()[name](spark, SF).collect()

    def refuse(*args):
        raise AssertionError("the quads were stored")

    for stored in ("snapshot", "registry"):
        monkeypatch.setattr(fx, stored, refuse)
    assert sorted(map(repr, entry.queries()[name](spark, SF).collect())) == sorted(map(repr, expected))


def test_a_consistency_check_makes_what_is_expected_once(spark, quads, monkeypatch):
    staged, stage = [], validate.lookup.stage
    monkeypatch.setattr(validate.lookup, "stage", lambda df: staged.append(df.columns) or stage(df))
    inputs = quads(("s1", "p", "o", "g"), ("s2", "p", "o", "g"))
    pairs = local_table(spark, [("g", "d")], struct("lg STRING, dg STRING"))
    rows = validate.consistency_gaps(quads(("s1", "p", "o", "d")), inputs, quads(), pairs).collect()
    assert [(r.g, r.s, r.side) for r in rows] == [("d", "s2", "only expected")]
    assert QUAD_COLS in staged


def _numbered(spark, start, end, graph="g"):
    number = F.col("id").cast("string")
    return from_table(spark.range(start, end), F.lit(graph), F.concat(F.lit("s"), number), {"p": T.iri(number), "q": T.iri(number)})


def _told_apart_after_one_deal(df, parts):
    plan = df._jdf.queryExecution().executedPlan().toString()
    (dealt,) = exchanges(df)
    assert f", {parts}), REPARTITION_BY_NUM" in dealt
    return plan.rfind("Aggregate(") < plan.find("Exchange ")


@pytest.mark.parametrize("most, parts", [(200, 14), (3, 3)])
def test_a_large_batch_is_told_apart_after_its_deal(spark, monkeypatch, most, parts):
    monkeypatch.setattr(source, "DEALT_ROWS", 10)
    monkeypatch.setattr(lookup, "UNSORTED_PARTS", most)
    for bound in ("LOCAL_ROWS", "BROADCAST_ROWS"):
        monkeypatch.setattr(lookup, bound, 5)
    batch = _numbered(spark, 30, 50).unionByName(_numbered(spark, 45, 50))
    after = lookup.add_new(_numbered(spark, 0, 40), batch.unionByName(_numbered(spark, 0, 5)))
    assert _told_apart_after_one_deal(after, parts)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, _numbered(spark, 0, 50).collect()))


def test_merged_graphs_are_told_apart_after_their_deal(spark, monkeypatch):
    monkeypatch.setattr(source, "DEALT_ROWS", 10)
    both = _numbered(spark, 0, 20).unionByName(_numbered(spark, 10, 30, "h"))
    merged = views.default_graph(both)
    assert _told_apart_after_one_deal(merged, 8)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, _numbered(spark, 0, 30).drop("g").collect()))


def test_an_upsert_meets_only_its_predicates(spark, tmp_path, monkeypatch):
    nameless = _numbered(spark, 2, 4).withColumn("p", F.lit(None).cast("string"))
    _numbered(spark, 0, 6).unionByName(nameless).write.parquet(str(tmp_path / "quads"))
    held = spark.read.parquet(str(tmp_path / "quads"))
    values = _numbered(spark, 1, 8).filter("p = 'q' AND o != '5'").withColumn("o", F.lit("new"))
    values = values.unionByName(nameless.filter("s = 's2'").limit(1))
    after = graphs.upsert_single_value(held, values)
    assert "EqualTo(p,q)" in after._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.s, r.p or "", r.o) for r in after.collect())
    monkeypatch.setattr(lookup, "PUSHDOWN_KEYS", 0)
    assert rows == sorted((r.s, r.p or "", r.o) for r in graphs.upsert_single_value(held, values).collect())
    assert [r for r in rows if r[1] == "q"] == sorted([("s0", "q", "0"), ("s5", "q", "5"), *[(f"s{i}", "q", "new") for i in (1, 2, 3, 4, 6, 7)]])
    assert len(rows) == 6 + 8 + 4 + 1


def test_many_graphs_are_computed_once(spark, blank, monkeypatch):
    for bound in ("LOCAL_ROWS", "PUSHDOWN_KEYS"):
        monkeypatch.setattr(lookup, bound, 5)
    staged = []
    monkeypatch.setattr(lookup, "stage", lambda df, stage=lookup.stage: staged.append(stage(df)) or staged[-1])
    named = spark.range(20).select(F.concat(F.lit("g"), (F.col("id") % 10).cast("string")).alias("lg")).distinct()
    meta = update.graph_meta(named, "ds", blank, 2)
    assert {(r.lg, r.state, r.draft_size) for r in meta.collect()} == {(f"g{i}", "unmanaged", 0) for i in range(10)}
    assert len(staged) == 1 and set(staged[0].inputFiles()) <= set(meta.inputFiles())
