"""Joins of solutions whose shared variables may be unbound, against the definition."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from quadweave.operators import patterns as pt
from quadweave.schema import IRI, local_table
from quadweave.functions.terms import TERM
from pyspark.sql import types as T


def table(spark, names, rows, firm="k"):
    schema = T.StructType([T.StructField(n, TERM, n != firm) for n in names])
    cell = lambda v: None if v is None else {"value": v, "kind": IRI, "dt": "", "lang": ""}
    return local_table(spark, [tuple(map(cell, r)) for r in rows], schema)


def shown(df, names):
    return sorted(tuple("-" if r[n] is None else r[n].value for n in names) for r in df.collect())


def compatible(a, b):
    return all(a[n] == b[n] for n in a.keys() & b.keys() if a[n] is not None and b[n] is not None)


def common(a, b):
    return any(a[n] is not None and b[n] is not None for n in a.keys() & b.keys())


def merged(a, b, names):
    return tuple(next((x[n] for x in (a, b) if x.get(n) is not None), "-") for n in names)


@pytest.mark.parametrize("loose,seed", list(itertools.product((1, 2), range(3))))
def test_against_definition(spark, loose, seed):
    rng = np.random.default_rng(seed)
    variables = ["u", "v"][:loose]
    pick = lambda n, some: [None if some and rng.random() < 0.4 else f"x{rng.integers(3)}" for _ in range(n)]
    rows = lambda n: list(zip(pick(n, False), *[pick(n, True) for _ in variables], [f"r{i}" for i in range(n)]))
    left, right = rows(12), rows(9)
    l_names, r_names = ["k", *variables, "a"], ["k", *variables, "b"]
    l_df, r_df = table(spark, l_names, left), table(spark, r_names, right)
    ls, rs = [dict(zip(l_names, r)) for r in left], [dict(zip(r_names, r)) for r in right]
    names = [*l_names, "b"]
    dash = lambda d: tuple("-" if d[n] is None else d[n] for n in l_names)
    pairs = sorted(merged(a, b, names) for a in ls for b in rs if compatible(a, b))
    alone = [a for a in ls if not any(compatible(a, b) for b in rs)]
    assert shown(pt.join(l_df, r_df), names) == pairs
    assert shown(pt.optional(l_df, r_df), names) == sorted(pairs + [(*dash(a), "-") for a in alone])
    assert shown(pt.exists(l_df, r_df), l_names) == sorted(dash(a) for a in ls if a not in alone)
    assert shown(pt.not_exists(l_df, r_df), l_names) == sorted(map(dash, alone))
    assert shown(pt.minus(l_df, r_df), l_names) == sorted(dash(a) for a in ls if not any(compatible(a, b) and common(a, b) for b in rs))


def test_minus_without_a_firm_variable(spark):
    names, rows = ["u", "v"], [("a", None), (None, "b"), (None, None), ("c", "b")]
    left, right = table(spark, names, rows, None), table(spark, names, [("a", None), (None, "d")], None)
    assert shown(pt.minus(left, right), names) == [("-", "-"), ("-", "b"), ("c", "b")]
    with pytest.raises(ValueError, match="share"):
        pt.join(left, right)


def test_constants_reach_the_stored_quads_of_a_draft(spark, tmp_path, quads):
    """A pattern over a draft view filters the stored names; results are those of the whole view."""
    from quadweave.plans.workspace import Workspace

    space = Workspace(spark, str(tmp_path / "space"), buckets=4)
    ds = space.create_draftset("ann")
    rows = [("s1", "p", "o", "g1"), ("g1", "p", "g2", "g2"), ("s2", "g1", "'g2", "g2"), ("s3", "q", "g3", "g1")]
    space.append(ds, quads(*rows))
    view = space.view(ds)
    plain = view.select("*")
    for given in (dict(s=pt.iri("g1")), dict(p=pt.iri("g1")), dict(o=pt.iri("g2")), dict(o=pt.text("g2")), dict(o=pt.iri("g3")), dict(p=pt.iri("nothing"))):
        asked = {"s": "?s", "p": "?p", "o": "?o", **given}
        narrow, wide = (pt.pattern(v, asked["s"], asked["p"], asked["o"], "?g") for v in (view, plain))
        assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
    plan = pt.pattern(view, "?s", pt.iri("q"), "?o", "?g")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("EqualTo(p,q)" in line or "In(p, [q])" in line for line in pushed), pushed
