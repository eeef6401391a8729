from __future__ import annotations

import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from support import shown
from quadweave.schema import QUAD_COLS, RDF_LANG_STRING, XSD, struct
from quadweave.schema import local_table
from quadweave.sources import generator, quads as source, sinks

LINES = [
    '<http://s> <http://p> "plain" .',
    '<http://s> <http://p> "a \\"quote\\" and \\\\ and \\n" <http://g> .',
    '<http://s> <http://p> "caf\\u00E9 \\U0001F600"@EN-gb <http://g> . # note "x"',
    '<http://s> <http://p> "7"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> .',
    "_:a <http://p> _:b.c <http://g> .",
    '<http://s><http://p>""<http://g>.',
    "# comment",
    "   ",
    "<http://s> <http://p> .",
    '<http://s> <http://p> "bad \\q" .',
    '<http://s> "p" <http://o> .',
    '<http://s> <http://p> "open .',
]


def lines_of(spark, lines):
    return local_table(spark, [(x,) for x in lines], struct("value STRING"))


def test_parse_lines(spark):
    parsed = source.parse_lines(lines_of(spark, LINES))
    rows = [tuple(r) for r in parsed.quads.select(*QUAD_COLS).collect()]
    assert rows == [
        (None, "http://s", "iri", "http://p", "plain", "literal", XSD + "string", ""),
        ("http://g", "http://s", "iri", "http://p", 'a "quote" and \\ and \n', "literal", XSD + "string", ""),
        ("http://g", "http://s", "iri", "http://p", "café 😀", "literal", RDF_LANG_STRING, "en-gb"),
        ("http://g", "http://s", "iri", "http://p", "7", "literal", XSD + "integer", ""),
        ("http://g", "a", "bnode", "http://p", "b.c", "bnode", "", ""),
        ("http://g", "http://s", "iri", "http://p", "", "literal", XSD + "string", ""),
    ]
    assert [r.reason for r in parsed.rejects.collect()] == [
        "not a statement", "bad escape", "not a statement", "not a statement",
    ]


def test_files_keep_blank_nodes_apart(spark, tmp_path):
    (tmp_path / "a.nt").write_text("_:x <http://p> _:y .\n")
    with gzip.open(tmp_path / "b.nt.gz", "wt") as f:
        f.write("_:x <http://p> _:y .\n")
    rows = source.read_lines(spark, str(tmp_path)).quads.collect()
    assert len(rows) == 2 and len({r.s for r in rows}) == 2 and all(r.s.endswith("x") for r in rows)


def test_write_and_read_back(spark, quads, tmp_path):
    have = quads(("s", "p", "o", "g"), ("s", "p", "'line\nbreak \"\\ \t", "g"), ("s", "p", "'", "h"))
    sinks.write_quads(have, str(tmp_path / "out"))
    assert shown(source.read_lines(spark, str(tmp_path / "out")).quads) == shown(have)
    sinks.write_statements(have, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["s", "p", "o"] and back.count() == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=8))
def test_any_text_survives(spark, texts):
    have = source.from_rows(spark, [("g", f"s{i}", "iri", "p", t, "literal", XSD + "string", "") for i, t in enumerate(texts)])
    back = source.parse_lines(sinks.quad_lines(have)).quads
    assert {(r.s, r.o) for r in back.collect()} == {(f"s{i}", t) for i, t in enumerate(texts)}


def test_long_literal(spark):
    text = 'word "quoted" \\ \n' * 50_000
    have = source.from_rows(spark, [("g", "s", "iri", "p", text, "literal", XSD + "string", "")])
    assert source.parse_lines(sinks.quad_lines(have)).quads.first().o == text


def test_graph_checks(spark, quads):
    with pytest.raises(ValueError, match="blank node as graph"):
        source.check_graphs(quads(("s", "p", "o", "_:g")))
    with pytest.raises(ValueError, match="missing graph"):
        source.check_graphs(quads(("s", "p", "o", "g")).withColumn("g", F.lit(None).cast("string")))


@pytest.mark.parametrize("graphs, size, expected", [
    ("abab", 5, [("a", 2), ("b", 2)]),
    ("ababab", 1, [("a", 1), ("a", 1), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]),
])
def test_batches(spark, graphs, size, expected):
    rows = local_table(spark, [(i, g) for i, g in enumerate(graphs)], struct("i BIGINT, g STRING"))
    found = source.batch_by_graph(rows, "i", size).groupBy("chunk", "g", "batch").count().collect()
    assert sorted((r.g, r["count"]) for r in found) == expected


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(graphs=st.lists(st.sampled_from("abc"), max_size=40), size=st.integers(1, 6))
def test_batches_lose_nothing_and_keep_bounds(spark, graphs, size):
    rows = local_table(spark, [(i, g) for i, g in enumerate(graphs)], struct("i BIGINT, g STRING"))
    done = source.batch_by_graph(rows, "i", size).collect()
    assert sorted(r.i for r in done) == list(range(len(graphs)))
    sizes: dict = {}
    for r in done:
        sizes[(r.chunk, r.g, r.batch)] = sizes.get((r.chunk, r.g, r.batch), 0) + 1
    assert all(1 <= n <= size for n in sizes.values())


@pytest.mark.parametrize("spec, expected", [("0", 0), ("30", 30), ("500", 200), ("5%", 10), ("100%", 200)])
def test_reference_counts(spark, spec, expected):
    made = generator.generate(spark, 200, 7, spec, seed=1)
    graphs = made.select("g").distinct()
    named = made.filter("s like '%/graphs/%' or p like '%/graphs/%' or (o like '%/graphs/%' and o_kind = 'iri')")
    assert made.count() == 200 and named.count() == expected == made.filter("is_ref").count()
    assert graphs.count() <= 7 and made.select("row_id").distinct().count() == 200


def test_reference_spec_errors():
    for bad in ("x", "101%", "-1"):
        with pytest.raises(ValueError):
            generator.parse_references(bad, 10)


def test_more_graphs_than_statements(spark):
    assert generator.generate(spark, 3, 10, "1", seed=2).count() == 3


def test_results_formats(spark, quads):
    from quadweave.operators import patterns as pt

    rows = pt.pattern(quads(("s", "p", "'x", "g")), "?s", "?p", "?o", "?g").select("s", "o").withColumn(
        "z", F.lit(None).cast("struct<value:string,kind:string,dt:string,lang:string>")
    )
    assert sinks.csv_bindings(rows).first()[:] == ("s", "x", "")
    assert sinks.tsv_bindings(rows).first()[:] == ("<s>", '"x"', "")
    assert sinks.json_bindings(rows).first().value == '{"s":{"type":"uri","value":"s"},"o":{"type":"literal","value":"x"}}'
