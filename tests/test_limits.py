"""Values beyond every bound that once was fixed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quadweave.functions import scalars
from quadweave.operators import lookup, workflow
from quadweave.operators.inference import closure
from quadweave.schema import BNODE, IRI, LITERAL, XSD, Vocabulary, local_table, struct
from quadweave.sources import generator, quads, sinks


def test_long_names_stay_whole(spark):
    long = "x" * (1 << 20) + "end"
    row = spark.range(1).select(scalars.user_name(scalars.user_iri(F.lit(long))).alias("name"))
    assert row.first().name == long
    vocab = Vocabulary()
    held = F.array(F.lit(vocab.permission_prefix + long))
    row = spark.range(1).select(F.lit("ann").alias("owner"), *[F.lit(None).cast("string").alias(c) for c in ("submitted_by", "claim_user", "claim_permission")])
    assert row.select(workflow.permitted_operations(F.lit("ann"), held, vocab).alias("x")).first().x == [long]


@pytest.mark.parametrize("statements", [10, 10**9, 10**13])
def test_generated_sizes_add_up(spark, statements):
    plan = generator.graph_plan(spark, statements, 10, statements // 20).collect()
    assert sum(r["size"] for r in plan) == statements and sum(r.refs for r in plan) == statements // 20
    assert all(r["size"] >= 0 and r.refs <= r["size"] for r in plan)


def test_comments_may_hold_backslashes(spark):
    lines = [r'<s> <p> "a" . # c:\windows', r'<s> <p> "bad \q" .', r"# only \q", r'<s> <p> "tab\t" <g> .#\x']
    table = local_table(spark, [(x,) for x in lines], struct("value STRING"))
    parsed = quads.parse_lines(table)
    assert {(r.o, r.g) for r in parsed.quads.collect()} == {("a", None), ("tab\t", "g")}
    assert [(r.line, r.reason) for r in parsed.rejects.collect()] == [(lines[1], "bad escape")]


def test_batches_of_a_sparse_order(spark):
    rows = local_table(spark, [(10**9 * i - 5, "g" if i % 3 else "h") for i in range(50)], struct("i BIGINT, g STRING"))
    done = quads.batch_by_graph(rows, "i", 4).collect()
    chunks = {}
    for r in sorted(done, key=lambda r: r.i):
        chunks.setdefault(r.chunk, []).append(r)
    assert [len(c) for c in chunks.values()] == [16, 16, 16, 2]
    assert all(sum(x.g == g and x.batch == b for x in c) <= 4 for c in chunks.values() for g in "gh" for b in range(5))


@pytest.mark.parametrize("most", [100_000, 50])
def test_closure_of_a_deep_hierarchy(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)  # beyond it, rounds of joins
    edges = local_table(spark, [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c40", "c0")], struct("sub STRING, sup STRING"))
    assert closure(edges).count() == 41 * 41
    chain = local_table(spark, [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)], struct("sub STRING, sup STRING"))
    assert closure(chain).count() == 70 * 71 // 2 and closure(chain.limit(0)).count() == 0


def bindings(spark):
    terms = [
        {"value": 'a"b\tc', "kind": LITERAL, "dt": XSD + "string", "lang": ""},
        {"value": "n1", "kind": BNODE, "dt": "", "lang": ""},
        {"value": "http://x/i", "kind": IRI, "dt": "", "lang": ""},
        {"value": "5", "kind": LITERAL, "dt": "http://example.com/t#string", "lang": ""},
        None,
    ]
    from pyspark.sql import types as T

    from quadweave.functions.terms import TERM

    return local_table(spark, [(t, terms[2]) for t in terms], T.StructType([T.StructField("x", TERM), T.StructField("y", TERM)])).coalesce(1)


def test_result_files_keep_the_terms(spark, tmp_path):
    rows = bindings(spark)
    read = lambda fmt: sorted(spark.read.text(str(tmp_path / fmt)).collect())
    for fmt in ("csv", "tsv", "json"):
        sinks.write_bindings(rows, str(tmp_path / fmt), fmt)
    files = sorted(p for p in (tmp_path / "tsv").iterdir() if p.name.startswith("part"))
    lines = "".join(p.read_text() for p in files).splitlines()
    assert lines[0] == "?x\t?y"
    assert sorted(lines[1:]) == sorted(
        ['"a\\"b\\tc"\t<http://x/i>', "_:n1\t<http://x/i>", "<http://x/i>\t<http://x/i>", '"5"^^<http://example.com/t#string>\t<http://x/i>', "\t<http://x/i>"]
    )
    found = {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()}
    assert found == {('a"b\tc', "http://x/i"), ("_:n1", "http://x/i"), ("http://x/i", "http://x/i"), ("5", "http://x/i"), (None, "http://x/i")}
    text = "\n".join(r.value for r in read("json"))
    assert '"datatype":"http://example.com/t#string"' in text and "XMLSchema#string" not in text
    with pytest.raises(ValueError):
        sinks.write_bindings(rows, str(tmp_path / "x"), "xml")
