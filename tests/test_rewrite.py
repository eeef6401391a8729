from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from support import shown
from quadweave.functions import terms as T
from quadweave.operators import lookup, rewrite, validate
from quadweave.schema import TABLES, local_table

# Every combination of positions in which a graph may be named.
MATRIX = [
    ("G", "p", "o"), ("s", "G", "o"), ("s", "p", "G"), ("G", "G", "o"), ("G", "p", "G"), ("s", "G", "G"), ("G", "G", "G"),
]


def drafts(spark, *rows):
    return local_table(spark, [(dg, lg, "ds", None) for lg, dg in rows], TABLES["draft_graphs"])


@pytest.fixture(params=["broadcast", "salted"])
def path(request, monkeypatch):
    """Both ways of joining: a small dictionary, and one beyond every bound."""
    if request.param == "salted":
        monkeypatch.setattr(lookup, "LOCAL_ROWS", 0)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    return request.param


def test_matrix_both_ways(spark, quads, path):
    pairs = drafts(spark, ("G", "G'"), ("H", "H'"))
    stored = quads(*[(*t, "G'") for t in MATRIX], ("s", "p", "'G", "G'"), ("s", "p", "H", "G'"), ("s", "p", "G", "other"))
    swapped = {tuple(x.replace("G", "G'") if x == "G" else x for x in t) + ("G'",) for t in MATRIX}
    untouched = {("s", "p", "'G", "G'"), ("s", "p", "H", "G'"), ("s", "p", "G", "other")}  # literal, empty draft, elsewhere
    there = rewrite.rewrite_draftset(stored, pairs, "ds")
    assert shown(there) == swapped | untouched
    assert shown(rewrite.unrewrite_draftset(there, pairs, "ds")) == shown(stored)


def test_quads_that_become_equal_are_one(spark, quads):
    pairs = drafts(spark, ("G", "G'"))
    assert shown(rewrite.rewrite_draftset(quads(("s", "p", "G", "G'"), ("s", "p", "G'", "G'")), pairs, "ds")) == {
        ("s", "p", "G'", "G'")
    }


def test_unrewrite_only_references_to_emptied_drafts(spark, quads):
    pairs = drafts(spark, ("G", "G'"), ("H", "H'"))
    stored = quads(("s", "p", "G'", "G'"), ("s", "p", "H'", "G'"))
    assert shown(rewrite.unrewrite_draftset(stored, pairs, "ds", only_emptied=True)) == {
        ("s", "p", "G'", "G'"), ("s", "p", "H", "G'"),
    }
    assert shown(rewrite.unrewrite_draftset(stored, pairs, "ds", live_graphs=["G"])) == {
        ("s", "p", "G", "G'"), ("s", "p", "H'", "G'"),
    }


def test_result_columns_are_all_mapped(spark, quads, path):
    rows = quads(("G'", "p", "'G'", "g")).select(T.subject_term().alias("a"), T.object_term().alias("b"))
    rows = rows.withColumn("n", F.lit(1))
    found = rewrite.rewrite_bindings(rows, drafts(spark, ("G", "G'"))).first()
    assert (found.a.value, found.b.value, found.n) == ("G", "G'", 1)


def test_set_difference_and_new_rows(spark, quads, path):
    have = quads(("s", "p", "o", "g"), ("s", "p", "'o", "g"))
    more = quads(("s", "p", "o", "g"), ("t", "p", "o", "g"), ("t", "p", "o", "g"))
    assert shown(lookup.minus(have, more)) == {("s", "p", "'o", "g")}
    assert shown(lookup.add_new(have, more)) == {("s", "p", "o", "g"), ("s", "p", "'o", "g"), ("t", "p", "o", "g")}


def test_keep_and_drop_hot_graph(spark, quads, path):
    rows = quads(*[(f"s{i}", "p", "o", "hot" if i % 3 else f"g{i}") for i in range(60)])
    keys = local_table(spark, [("hot",), ("g0",)], TABLES["managed_graphs"].__class__([TABLES["managed_graphs"]["lg"]]))
    assert lookup.keep(rows, keys, key="lg").count() == 41
    assert lookup.drop(rows, keys, key="lg").count() == 19


def test_random_quads_stay_consistent(spark, quads):
    """Stored draft == mapping applied to (input - deletes), whatever the references."""
    rng = random.Random(3)
    graphs = ["g1", "g2", "g3"]

    def some():
        return (rng.choice(["s1", "s2", *graphs]), rng.choice(["p", "g1"]), rng.choice(["o", "'o", *graphs]), rng.choice(graphs))

    inputs = quads(*{some() for _ in range(60)})
    deletes = inputs.filter(F.hash("s", "o") % 4 == 0)
    pairs = drafts(spark, *[(g, g + "'") for g in graphs]).select("lg", "dg")
    stored = lookup.translate(lookup.minus(inputs, deletes), pairs, "lg", "dg", rewrite.ALL_POSITIONS)
    assert validate.consistency_gaps(stored, inputs, deletes, pairs).count() == 0
    lost = stored.limit(1)
    assert validate.consistency_gaps(lookup.minus(stored, lost), inputs, deletes, pairs).count() == 1
