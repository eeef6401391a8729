"""Draft lifecycle: mapping, copies, rewriting, append, delete, revert, publish, update batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.operators import graphs, publish, rewrite, state, update, writes
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.workspace import Workspace
from quadweave.plans.fixtures import DS1, EX, GRAPH, NOW, VOCAB, P, sql
from quadweave.schema import QUAD_COLS
from quadweave.sources.quads import from_table

_COLS = "g,s,s_kind,p,o,o_kind,o_dt,o_lang"
_STRING = "'http://www.w3.org/2001/XMLSchema#string'"


def _g(*numbers) -> str:
    return ", ".join(f"'{GRAPH}{n}'" for n in numbers)


def _dg(lg: str, draftset: str = "'ds-1'") -> str:
    return f"'{VOCAB.draft_graph_base}'||md5({draftset}||'|'||{lg})"


def _stored(content: str, filled: str = "SELECT DISTINCT g FROM c1") -> str:
    """SQL: the stored form of draftset ds-1 holding ``content`` (published names)."""
    return f"""
    , c1 AS (SELECT DISTINCT {_COLS} FROM ({content})), f1 AS ({filled})
    SELECT {_dg("g")} AS g, CASE WHEN s IN (SELECT g FROM f1) THEN {_dg("s")} ELSE s END AS s, s_kind, p,
      CASE WHEN o_kind = 'iri' AND o IN (SELECT g FROM f1) THEN {_dg("o")} ELSE o END AS o, o_kind, o_dt, o_lang FROM c1"""


_MINE = f"SELECT {_COLS} FROM content WHERE draftset = 'ds-1'"
_LIVE = f"SELECT {_COLS} FROM live_q"

# Quads of one customer attribute each, spread over drafted, emptied, live, new and unknown graphs.
_IN_SQL = f"""
  SELECT 'http://example.com/graph/'||([0,4,6,16,18])[c_custkey % 5 + 1] AS g, 'http://example.com/customer/'||c_custkey AS s, 'iri' AS s_kind, 'http://example.com/p/name' AS p,
    c_name AS o, 'literal' AS o_kind, {_STRING} AS o_dt, '' AS o_lang FROM customer
  UNION ALL SELECT 'http://example.com/graph/'||([0,4,6,16,18])[c_custkey % 5 + 1], 'http://example.com/customer/'||c_custkey, 'iri', 'http://example.com/p/seeAlso',
    'http://example.com/graph/'||((c_custkey * 7) % 20), 'iri', '', '' FROM customer"""
_IN_HOMES = [0, 4, 6, 16, 18]
_IN = f"SELECT {_COLS} FROM ({_IN_SQL})"


def customer_quads(spark, sf_dir):
    customer = fx.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return from_table(
        customer,
        fx.graph_iri(F.element_at(F.array(*map(F.lit, _IN_HOMES)), (k % len(_IN_HOMES) + 1).cast("int"))),
        F.concat(F.lit(fx.CUSTOMER), k.cast("string")),
        {P + "name": T.literal(F.col("c_name")), P + "seeAlso": T.iri(fx.graph_iri((k * 7) % 20))},
    )


def _mine(snap, draftset=DS1):
    return writes.split_draft(snap, draftset)[0].select(*QUAD_COLS)


@register("h1_graph_mapping", sql("SELECT d.lg, d.dg, m.is_public FROM part_drafts d JOIN part_graphs m USING (lg) WHERE draftset = 'ds-3'"))
def graph_mapping(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return state.mapping(reg.draft_graphs, reg.managed_graphs, "ds-3")


@register("h2_live_graphs", sql("SELECT lg FROM part_graphs WHERE is_public"))
def live_graphs(spark, sf_dir):
    return state.live_graphs(fx.registry(spark, sf_dir).managed_graphs)


@register(
    "h3_ensure_managed",
    sql(
        """SELECT lg, is_public, epoch_us(issued) AS issued FROM part_graphs UNION ALL
        SELECT DISTINCT 'http://example.com/graph/part/'||(l_partkey * 2), false, NULL::BIGINT FROM lineitem
        WHERE 'http://example.com/graph/part/'||(l_partkey * 2) NOT IN (SELECT lg FROM part_graphs)"""
    ),
)
def ensure_managed(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    named = fx.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(fx.PART_GRAPH), (F.col("l_partkey") * 2).cast("string")).alias("lg")
    )
    rows = state.ensure_managed(reg.managed_graphs, named)
    return rows.select("lg", "is_public", F.unix_micros("issued").alias("issued"))


@register(
    "h4_create_drafts",
    sql(
        f"""SELECT dg, lg, draftset FROM part_drafts UNION SELECT {_dg("lg", "'ds-3'")}, lg, 'ds-3' FROM part_graphs WHERE is_public"""
    ),
)
def create_drafts(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    rows = state.create_drafts(reg.draft_graphs, state.live_graphs(reg.managed_graphs), "ds-3", NOW, VOCAB)
    return rows.select("dg", "lg", "draftset")


@register(
    "h5_ensure_protected_draft",
    sql(f"SELECT dg, lg, draftset FROM part_drafts UNION ALL SELECT {_dg('lg', chr(39) + 'ds-3' + chr(39))}, lg, 'ds-3' FROM modg"),
)
def ensure_protected_draft(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    _, drafts = state.ensure_protected_draft(
        reg.managed_graphs, reg.draft_graphs, VOCAB.modified_graph, "ds-3", NOW, VOCAB
    )
    return drafts.select("dg", "lg", "draftset")


@register(
    "h6_copy_graph",
    sql(f"SELECT {_COLS} FROM live_q WHERE g <> '{GRAPH}2' UNION ALL SELECT '{GRAPH}2', * EXCLUDE (g, k) FROM live_q WHERE g = '{GRAPH}1'"),
)
def copy_graph(spark, sf_dir):
    return graphs.copy_graph(fx.snapshot(spark, sf_dir).live, GRAPH + "1", GRAPH + "2")


@register("h7_clone_graphs", sql(f"SELECT {_dg('g')} AS g, s, p, o FROM live_q WHERE g IN ({_g(7, 8, 9)})"))
def clone_graphs(spark, sf_dir):
    """Three live graphs cloned at once."""
    snap = fx.snapshot(spark, sf_dir)
    fresh = snap.managed_graphs.filter(F.col("lg").isin([GRAPH + n for n in "789"])).select("lg")
    return graphs.clone(snap.live, state.new_drafts(fresh, DS1, NOW, VOCAB)).select("g", "s", "p", "o")


def _mixed(spark, sf_dir):
    """Draft of ds-1 as if no reference had been rewritten, next to the stored draft of ds-2."""
    snap = fx.snapshot(spark, sf_dir)
    pairs = snap.draft_graphs.filter(F.col("draftset") == DS1)
    raw = views.draft_view(snap, DS1).join(F.broadcast(pairs.select(F.col("lg").alias("g"), "dg")), "g").withColumn("g", F.col("dg"))
    return snap, raw.select(*QUAD_COLS).unionByName(_mine(snap, fx.DS2))


@register("h8_rewrite_draftset", sql(_stored(_MINE) + f" UNION ALL SELECT {_COLS} FROM draft_q WHERE draftset = 'ds-2'"))
def rewrite_draftset(spark, sf_dir):
    snap, draft = _mixed(spark, sf_dir)
    return rewrite.rewrite_draftset(draft, snap.draft_graphs, DS1, snap.names("draft"))


@register(
    "h9_unrewrite_draftset",
    sql(f"SELECT {_dg('g')} AS g, s, p, o FROM content WHERE draftset = 'ds-1' UNION ALL SELECT g, s, p, o FROM draft_q WHERE draftset = 'ds-2'"),
)
def unrewrite_draftset(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    return rewrite.unrewrite_draftset(snap.draft, snap.draft_graphs, DS1).select("g", "s", "p", "o")


@register(
    "h9_unrewrite_emptied",
    sql(
        f"""SELECT g, s, p, CASE WHEN o_kind = 'iri' AND o = {_dg("'" + GRAPH + "1'")} THEN '{GRAPH}1' ELSE o END AS o
        FROM draft_q WHERE draftset = 'ds-1' AND g <> {_dg("'" + GRAPH + "1'")}
        UNION ALL SELECT g, s, p, o FROM draft_q WHERE draftset = 'ds-2'"""
    ),
)
def unrewrite_emptied(spark, sf_dir):
    """After one draft graph lost all its quads, only references to it change back."""
    snap = fx.snapshot(spark, sf_dir)
    dg = state.find_draft(snap.draft_graphs, DS1, GRAPH + "1")
    draft = graphs.drop_graph(snap.draft, dg)
    names = graphs.drop_graph(snap.names("draft"), dg)
    return rewrite.unrewrite_draftset(draft, snap.draft_graphs, DS1, only_emptied=True, names=names).select("g", "s", "p", "o")


@register("h10_append_quads", sql(_stored(f"{_MINE} UNION ALL {_LIVE} WHERE g = '{GRAPH}6' UNION ALL {_IN}")))
def append_quads(spark, sf_dir):
    """Into a drafted, an emptied, a live, a new and an unknown graph at once."""
    snap = fx.snapshot(spark, sf_dir)
    return _mine(writes.append(snap, DS1, customer_quads(spark, sf_dir), NOW, VOCAB))


@register(
    "h10_append_state",
    sql(
        f"""SELECT m.lg, m.is_public, d.dg FROM (SELECT lg, is_public FROM managed UNION ALL SELECT '{GRAPH}18', false) m
        LEFT JOIN (SELECT lg, dg FROM dgs WHERE draftset = 'ds-1' UNION ALL SELECT lg, {_dg("lg")} FROM (SELECT unnest([{_g(6, 18)}]) AS lg)) d ON d.lg = m.lg"""
    ),
)
def append_state(spark, sf_dir):
    after = writes.append(fx.snapshot(spark, sf_dir), DS1, customer_quads(spark, sf_dir), NOW, VOCAB)
    mine = writes.pairs_of(after, DS1)
    return after.managed_graphs.select("lg", "is_public").join(mine, "lg", "left")


_KEPT = _stored(f"{_MINE} AND g <> '{GRAPH}1' UNION ALL {_LIVE} WHERE g = '{GRAPH}6' UNION ALL {_IN}")


@register(
    "d1_kept_counts",
    sql(
        f"""{_KEPT.replace("SELECT " + _dg("g"), ", kept AS (SELECT " + _dg("g"), 1)})
        SELECT 'live' AS store, g, count(*) AS n FROM live_q GROUP BY g UNION ALL SELECT 'draft', g, count(*) FROM kept GROUP BY g
        UNION ALL SELECT 'draft', g, count(*) FROM draft_q WHERE draftset = 'ds-2' GROUP BY g"""
    ),
)
def kept_counts(spark, sf_dir):
    """Counts kept by commits: a graph of a draft deleted, then quads appended to five."""
    space = Workspace(spark, buckets=16, clock=lambda: NOW).load(fx.snapshot(spark, sf_dir))
    space.delete_graph(DS1, GRAPH + "1")
    space.append(DS1, customer_quads(spark, sf_dir))
    return space.snapshot().counts


_STATUS = f"SELECT {_COLS} FROM live_q WHERE p = 'http://example.com/p/status'"
_GONE = f"""{_STATUS} AND g IN ({_g(0, 7)})
  UNION ALL SELECT '{GRAPH}19', * EXCLUDE (g, k) FROM live_q WHERE p = 'http://example.com/p/status' AND g = '{GRAPH}2'
  UNION ALL SELECT {_COLS} FROM content WHERE draftset = 'ds-1' AND g = '{GRAPH}17'
  UNION ALL SELECT {_COLS} FROM content WHERE draftset = 'ds-1' AND g = '{GRAPH}1' AND p = 'http://example.com/p/seeAlso'"""


def quads_to_delete(spark, sf_dir):
    """Part of a draft, part of a live graph, quads of an unmanaged graph, a whole new draft, references."""
    snap = fx.snapshot(spark, sf_dir)
    content = views.draft_view(snap, DS1)
    status = snap.live.filter(F.col("p") == P + "status")
    return (
        fx.in_graphs(status, [0, 7])
        .unionByName(fx.in_graphs(status, [2]).withColumn("g", F.lit(GRAPH + "19")))
        .unionByName(fx.in_graphs(content, [17]))
        .unionByName(fx.in_graphs(content, [1]).filter(F.col("p") == P + "seeAlso"))
        .select(*QUAD_COLS)
    )


@register("h11_delete_quads", sql(_stored(f"({_MINE} UNION ALL {_LIVE} WHERE g = '{GRAPH}7') EXCEPT ({_GONE})")))
def delete_quads(spark, sf_dir):
    return _mine(writes.delete(fx.snapshot(spark, sf_dir), DS1, quads_to_delete(spark, sf_dir), NOW, VOCAB))


@register(
    "h11_delete_state",
    sql(
        f"""SELECT m.lg, m.is_public, d.dg FROM (SELECT lg, is_public FROM managed WHERE lg <> '{GRAPH}17') m
        LEFT JOIN (SELECT lg, dg FROM dgs WHERE draftset = 'ds-1' UNION ALL SELECT '{GRAPH}7', {_dg("'" + GRAPH + "7'")}) d ON d.lg = m.lg"""
    ),
)
def delete_state(spark, sf_dir):
    """The new draft that lost all quads is gone, with its private managed graph."""
    after = writes.delete(fx.snapshot(spark, sf_dir), DS1, quads_to_delete(spark, sf_dir), NOW, VOCAB)
    return after.managed_graphs.select("lg", "is_public").join(writes.pairs_of(after, DS1), "lg", "left")


@register("h12_delete_graph", sql(_stored(f"{_MINE} AND g <> '{GRAPH}1'")))
def delete_graph(spark, sf_dir):
    return _mine(writes.delete_graph(fx.snapshot(spark, sf_dir), DS1, GRAPH + "1", NOW, VOCAB))


@register("h13_revert_graph", sql(_stored(f"{_MINE} AND g <> '{GRAPH}16'")))
def revert_graph(spark, sf_dir):
    outcome, after = writes.revert_graph(fx.snapshot(spark, sf_dir), DS1, GRAPH + "16", NOW, VOCAB)
    if outcome != "reverted":
        raise AssertionError(outcome)
    return _mine(after)


@register("h14_copy_live_graph", sql(_stored(f"{_MINE} AND g <> '{GRAPH}3' UNION ALL {_LIVE} WHERE g IN ({_g(3, 4)})")))
def copy_live_graph(spark, sf_dir):
    """Over a changed draft and over an emptied one."""
    snap = fx.snapshot(spark, sf_dir)
    for n in "34":
        snap = writes.copy_live_graph(snap, DS1, GRAPH + n, NOW, VOCAB)
    return _mine(snap)


@register(
    "h15_delete_draftset",
    sql(
        """SELECT 'quads' AS part, count(*) AS n FROM draft_q WHERE draftset = 'ds-2'
        UNION ALL SELECT 'drafts', count(*) FROM dgs WHERE draftset = 'ds-2' UNION ALL SELECT 'sets', 1
        UNION ALL SELECT 'managed', count(*) FROM managed WHERE is_public
        UNION ALL SELECT 'times', count(*) FROM times WHERE scope <> 'ds-1'"""
    ),
)
def delete_draftset(spark, sf_dir):
    after = writes.delete_draftset(fx.snapshot(spark, sf_dir), DS1)
    tables = {
        "quads": after.draft,
        "drafts": after.draft_graphs,
        "sets": after.draftsets,
        "managed": after.managed_graphs,
        "times": after.graph_modified,
    }
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@register("h16_publish_quads", sql(f"SELECT {_COLS} FROM view_q"))
def publish_quads(spark, sf_dir):
    return publish.publish(fx.snapshot(spark, sf_dir), DS1, NOW, VOCAB).live


@register(
    "h16_publish_state",
    sql(
        f"""SELECT lg, true AS is_public, epoch_us(coalesce(issued, CASE WHEN lg LIKE 'http://example.com/%' THEN TIMESTAMP '{NOW}' END)) AS issued
        FROM managed WHERE lg <> '{GRAPH}4'"""
    ),
)
def publish_state(spark, sf_dir):
    """New graphs become public and issued, the deleted one is no longer managed."""
    rows = publish.publish(fx.derived_snapshot(spark, sf_dir), DS1, NOW, VOCAB).managed_graphs
    return rows.select("lg", "is_public", F.unix_micros("issued").alias("issued"))


@register("h17_move_graph", sql(f"SELECT CASE WHEN g = '{GRAPH}1' THEN '{GRAPH}2' ELSE g END AS g, s, p, o FROM live_q WHERE g <> '{GRAPH}2'"))
def move_graph(spark, sf_dir):
    return graphs.move_graph(fx.snapshot(spark, sf_dir).live, GRAPH + "1", GRAPH + "2").select("g", "s", "p", "o")


@register("h18_drop_graph", sql(f"SELECT g, s, p, o FROM live_q WHERE g <> '{GRAPH}5'"))
def drop_graph(spark, sf_dir):
    return graphs.drop_graph(fx.snapshot(spark, sf_dir).live, GRAPH + "5").select("g", "s", "p", "o")


@register(
    "h19_upsert_single_value",
    sql(
        f"""SELECT g, s, p, CASE WHEN p = 'http://example.com/p/status' AND k % 3 = 0 THEN 'checked' ELSE o END AS o FROM live_q
        UNION ALL SELECT '{GRAPH}0', 'http://example.com/customer/'||c_custkey, 'http://example.com/p/status', 'new' FROM customer"""
    ),
)
def upsert_single_value(spark, sf_dir):
    live = fx.snapshot(spark, sf_dir).live
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    changed = live.filter((F.col("p") == P + "status") & (number % 3 == 0)).withColumn("o", F.lit("checked"))
    fresh = from_table(
        fx.read(spark, sf_dir, "customer"),
        F.lit(GRAPH + "0"),
        F.concat(F.lit(fx.CUSTOMER), F.col("c_custkey").cast("string")),
        {P + "status": T.literal("new")},
    )
    return graphs.upsert_single_value(live, changed.unionByName(fresh)).select("g", "s", "p", "o")


@register("h20_append_triples", sql(f"SELECT g, s, p, o FROM live_q UNION SELECT '{GRAPH}1', s, p, o FROM live_q WHERE g IN ({_g(1, 2)})"))
def append_triples(spark, sf_dir):
    live = fx.snapshot(spark, sf_dir).live
    return graphs.append_triples(live, GRAPH + "1", fx.in_graphs(live, [1, 2])).select("g", "s", "p", "o")


@register(
    "h21_change_status",
    sql(
        """SELECT d.draftset, d.lg, d.dg, CASE WHEN m.is_public AND d.filled THEN 'updated' WHEN d.filled THEN 'created' ELSE 'deleted' END AS status
        FROM part_drafts d JOIN part_graphs m USING (lg)"""
    ),
)
def change_status(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    return state.change_rows(reg.draft_graphs, reg.managed_graphs, reg.names("draft"))


@register(
    "h22_graph_meta",
    sql(
        """SELECT w.lg, d.dg, CASE WHEN d.dg IS NOT NULL THEN 'draft' WHEN m.is_public THEN 'live' ELSE 'unmanaged' END AS state,
          least(coalesce(q.n, 0), 3) AS draft_size, CASE WHEN m.lg IS NULL THEN 0 ELSE 2 END AS live_size
        FROM (SELECT DISTINCT 'http://example.com/graph/part/'||(l_partkey * 2) AS lg FROM lineitem) w
        LEFT JOIN part_drafts d ON d.lg = w.lg AND d.draftset = 'ds-3' LEFT JOIN part_graphs m ON m.lg = w.lg
        LEFT JOIN (SELECT g, count(*) AS n FROM part_q GROUP BY g) q ON q.g = d.dg"""
    ),
)
def graph_meta(spark, sf_dir):
    reg = fx.registry(spark, sf_dir)
    named = fx.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(fx.PART_GRAPH), (F.col("l_partkey") * 2).cast("string")).alias("lg")
    )
    return update.graph_meta(named.distinct(), "ds-3", reg, 2)


_HOMES = [0, 8, 18, 9, 17]


def update_rows(spark, sf_dir):
    """Drop 9; add all suppliers; delete half of them again and the statuses of 8; drop 17; add a third, with references."""
    k = F.col("s_suppkey")
    supplier = fx.read(spark, sf_dir, "supplier")
    home = F.element_at(F.array(*[F.lit(n) for n in _HOMES]), (k % 5 + 1).cast("int"))

    def about(rows, attributes):
        return from_table(rows, fx.graph_iri(home), F.concat(F.lit(EX + "supplier/"), k.cast("string")), attributes)

    name = {P + "name": T.literal(F.col("s_name"))}
    see = {P + "seeAlso": T.iri(F.lit(GRAPH + "18"))}

    def step(seq, op, quads, silent=False):
        return quads.select(
            F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(silent).alias("silent"), *QUAD_COLS
        )

    def drop(seq, graph, silent):
        none = [F.lit(None).cast("string").alias(c) for c in QUAD_COLS[1:]]
        return step(seq, "drop", spark.range(1).select(F.lit(graph).alias("g"), *none), silent)

    status = of_graph_8(spark, sf_dir)
    steps = [
        drop(1, GRAPH + "9", False),
        step(2, "insert", about(supplier, name)),
        step(3, "delete", about(supplier.filter(k % 2 == 0), name).unionByName(status)),
        drop(4, GRAPH + "17", False),
        step(5, "insert", about(supplier.filter(k % 3 == 0), {**name, **see})),
        drop(6, GRAPH + "19", True),
    ]
    ops = steps[0]
    for more in steps[1:]:
        ops = ops.unionByName(more)
    return ops


def of_graph_8(spark, sf_dir):
    live = fx.snapshot(spark, sf_dir).live
    return live.filter((F.col("g") == GRAPH + "8") & (F.col("p") == P + "status")).select(*QUAD_COLS)


NO_LIMIT = 1 << 60
_SUPPLIERS = f"""SELECT 'http://example.com/graph/'||([0, 8, 18, 9, 17][s_suppkey % 5 + 1]) AS g, 'http://example.com/supplier/'||s_suppkey AS s, 'iri' AS s_kind,
  'http://example.com/p/name' AS p, s_name AS o, 'literal' AS o_kind, {_STRING} AS o_dt, '' AS o_lang, s_suppkey AS k FROM supplier"""
_UPDATED = f"""
  {_MINE} AND g <> '{GRAPH}17'
  UNION ALL {_LIVE} WHERE g = '{GRAPH}8' AND p <> 'http://example.com/p/status'
  UNION ALL SELECT {_COLS} FROM ({_SUPPLIERS}) WHERE g <> '{GRAPH}17' AND (k % 2 <> 0 OR k % 3 = 0)
  UNION ALL SELECT {_COLS} FROM ({_SUPPLIERS}) WHERE g = '{GRAPH}17' AND k % 3 = 0
  UNION ALL SELECT g, s, s_kind, 'http://example.com/p/seeAlso', '{GRAPH}18', 'iri', '', '' FROM ({_SUPPLIERS}) WHERE k % 3 = 0"""


@register("h23_update_batch", sql(_stored(_UPDATED)))
def update_batch(spark, sf_dir):
    """Ordered inserts, deletes and drops; the batch limit is lifted so that any scale runs."""
    snap = fx.snapshot(spark, sf_dir)
    return _mine(update.update(snap, DS1, update_rows(spark, sf_dir), NOW, VOCAB, NO_LIMIT))


@register(
    "h24_update_plan",
    sql(
        f"""SELECT * FROM (VALUES ('{GRAPH}0', 'draft', 'touch', NULL, NULL), ('{GRAPH}8', 'live', 'clone', NULL, CASE WHEN (SELECT count(*) FROM live_q WHERE g = '{GRAPH}8') > 500 THEN 'clone_too_large' END),
        ('{GRAPH}18', 'unmanaged', 'new_draft', NULL, NULL), ('{GRAPH}9', 'live', 'empty_draft', 1, NULL),
        ('{GRAPH}17', 'draft', 'touch', 4, CASE WHEN (SELECT count(*) FROM line_q WHERE g = '{GRAPH}17') > 500 THEN 'drop_too_large' END),
        ('{GRAPH}19', 'unmanaged', 'nothing', 6, NULL)) t(lg, state, setup, last_drop, error)"""
    ),
)
def update_plan(spark, sf_dir):
    """What each graph of the batch needs, and what stops it under a limit of 500."""
    rows = update.plan(fx.snapshot(spark, sf_dir), DS1, update_rows(spark, sf_dir), 500)
    return rows.select("lg", "state", "setup", "last_drop", "error")


@register(
    "h25_update_problems",
    sql(
        f"""SELECT CAST((SELECT count(*) FROM supplier) + (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) + 2 * (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0)
          + (SELECT count(*) FROM live_q WHERE g = '{GRAPH}8' AND p = 'http://example.com/p/status') + 3 + (SELECT count(*) FROM draft_q) + (SELECT count(*) FROM region) AS BIGINT) AS size,
          (SELECT count(*) FROM draft_q) AS protected, (SELECT count(*) FROM region) AS unprocessable, true AS too_large"""
    ),
)
def update_problems(spark, sf_dir):
    """A batch that also inserts into draft graphs and contains operations of other kinds."""
    ops = update_rows(spark, sf_dir)
    stored = fx.snapshot(spark, sf_dir).draft
    head = [F.lit(7).alias("seq"), F.lit("insert").alias("op"), F.lit(False).alias("silent")]
    bad = stored.select(*head, *QUAD_COLS)
    moved = fx.read(spark, sf_dir, "region").select(
        F.lit(8).alias("seq"),
        F.lit("move").alias("op"),
        F.lit(False).alias("silent"),
        F.lit(GRAPH + "0").alias("g"),
        *[F.lit(None).cast("string").alias(c) for c in QUAD_COLS[1:]],
    )
    return update.problems(ops.unionByName(bad).unionByName(moved), VOCAB, 50)


