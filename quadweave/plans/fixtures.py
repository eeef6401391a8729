"""Quads and bookkeeping tables derived from the order, line item, part and event tables.

Everything is a projection or an aggregate of the given tables, so the work of each query grows with
them. ``PRELUDE`` states the same tables once more as SQL, independently of the library.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.functions.scalars import draft_graph_iri, version_iri
from quadweave.operators import lookup, rewrite
from quadweave.plans.workspace import stored
from quadweave.schema import GRAPH_REF_POSITIONS, IRI, LITERAL, LIVE_SCOPE, QUAD_COLS, XSD, Snapshot, Vocabulary, empty_table, local_table, struct
from quadweave.sources.quads import deal, from_table

VOCAB = Vocabulary()
EX = "http://example.com/"
GRAPH, ORDER, LINE, CUSTOMER, P = EX + "graph/", EX + "order/", EX + "line/", EX + "customer/", EX + "p/"
NOW = "2024-03-01 12:00:00"
DS1, DS2 = "ds-1", "ds-2"
DS1_CHANGED, DS1_EMPTIED, DS1_NEW = [0, 1, 2, 3], [4], [16, 17]
DS2_CHANGED = [3, 5]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def graph_iri(number: Column) -> Column:
    return F.concat(F.lit(GRAPH), _text(number))


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def order_quads(orders: DataFrame) -> DataFrame:
    """Published quads: five or six per order, in sixteen graphs; one order in twenty names a graph."""
    see = F.when(F.col("o_orderkey") % 20 == 0, graph_iri(F.col("o_orderkey") % 16))
    return from_table(
        orders,
        graph_iri(F.col("o_custkey") % 16),
        F.concat(F.lit(ORDER), _text(F.col("o_orderkey"))),
        {
            P + "status": T.literal(F.col("o_orderstatus")),
            P + "priority": T.literal(F.col("o_orderpriority")),
            P + "customer": T.iri(F.concat(F.lit(CUSTOMER), _text(F.col("o_custkey")))),
            P + "priceCents": T.literal(_text(cents(F.col("o_totalprice"))), XSD + "integer"),
            P + "date": T.literal(T.date_lexical(F.col("o_orderdate")), XSD + "date"),
            P + "seeAlso": T.iri(see),
        },
    )


def line_quads(lineitem: DataFrame) -> DataFrame:
    """Additions of the first draftset: every line item, in four published and two new graphs, as a set.

    Quads are equal where their numbers are, so duplicates go while a quad is five numbers; a subject
    without one of its two numbers is NULL whatever the other. What is dealt are flat rows that hold
    every number once: an array of the values takes twice the bytes.
    """
    homes = DS1_CHANGED + DS1_NEW
    home = F.element_at(F.array(*map(F.lit, homes)), (F.col("l_partkey") % len(homes) + 1).cast("int"))
    see = F.when(F.col("l_orderkey") % 20 == 0, F.expr("(l_partkey div 18) % 18"))
    known = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    rows = lineitem.select(
        # Catalyst takes an element of an array without NULLs for never NULL, whatever the index is.
        F.when(F.col("l_partkey").isNotNull(), home).alias("home"),
        F.when(known, F.col("l_orderkey")).alias("order"),
        F.when(known, F.col("l_linenumber")).alias("line"),
        F.when(~known, F.col("l_orderkey")).alias("loose"),
        F.unix_date(F.col("l_shipdate").cast("date")).alias("day"),
        see.alias("see"),
    )
    values = F.array(F.col("day").cast("bigint"), F.coalesce("order", "loose"), F.col("see"))
    cells = deal(rows, "order", "line").select("home", "order", "line", F.posexplode(values).alias("at", "value"))
    cells = cells.filter(F.col("value").isNotNull()).dropDuplicates()
    at, value = F.col("at"), F.col("value")
    return cells.select(
        graph_iri(F.col("home")).alias("g"),
        F.concat(F.lit(LINE), _text(F.col("order")), F.lit("-"), _text(F.col("line"))).alias("s"),
        F.lit(IRI).alias("s_kind"),
        F.when(at == 0, P + "shipDate").when(at == 1, P + "partOf").otherwise(P + "seeAlso").alias("p"),
        F.when(at == 0, T.date_lexical(F.date_from_unix_date(value.cast("int"))))
        .when(at == 1, F.concat(F.lit(ORDER), _text(value)))
        .otherwise(graph_iri(value))
        .alias("o"),
        F.when(at == 0, LITERAL).otherwise(IRI).alias("o_kind"),
        F.when(at == 0, XSD + "date").otherwise("").alias("o_dt"),
        F.lit("").alias("o_lang"),
    )


def _order_number() -> Column:
    return F.substring(F.col("s"), len(ORDER) + 1, 20).try_cast("bigint")


def in_graphs(quads: DataFrame, numbers: list[int]) -> DataFrame:
    return quads.filter(F.col("g").isin([GRAPH + str(n) for n in numbers]))


def draft_contents(orders: DataFrame, lineitem: DataFrame) -> dict[str, DataFrame]:
    """Content of each draftset under published names. Only orders of the graphs that drafts clone are dealt."""
    cloned = orders.filter((F.col("o_custkey") % 16).isin(sorted({*DS1_CHANGED, *DS2_CHANGED})))
    live = order_quads(deal(cloned, "o_orderkey"))
    first = in_graphs(live, DS1_CHANGED).filter(_order_number() % 7 != 0)
    second = in_graphs(live, DS2_CHANGED).filter(_order_number() % 11 != 0)
    return {DS1: first.unionByName(line_quads(lineitem)), DS2: second}


def _graph_rows(spark: SparkSession, draftset: str, numbers: list[int]) -> DataFrame:
    lgs = [GRAPH + str(n) for n in numbers] + [VOCAB.modified_graph]
    rows = local_table(spark, [(lg,) for lg in lgs], struct("lg STRING"))
    return rows.select(
        draft_graph_iri(F.lit(draftset), F.col("lg"), VOCAB).alias("dg"),
        "lg",
        F.lit(draftset).alias("draftset"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("created"),
    )


@lru_cache(maxsize=8)
def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Sixteen public graphs, two draftsets over them, stored as Parquet."""
    return stored(derived_snapshot(spark, sf_dir))


def derived_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    orders = read(spark, sf_dir, "orders")
    live = order_quads(deal(orders, "o_orderkey"))
    contents = draft_contents(orders, read(spark, sf_dir, "lineitem"))
    numbers = {DS1: DS1_CHANGED + DS1_EMPTIED + DS1_NEW, DS2: DS2_CHANGED}
    rows = {ds: _graph_rows(spark, ds, ns) for ds, ns in numbers.items()}
    stored = []
    for ds, content in contents.items():
        pairs = rows[ds].select("lg", "dg")
        filled = pairs.filter(~F.col("lg").isin([GRAPH + str(n) for n in DS1_EMPTIED]))
        moved = lookup.translate(content, pairs, "lg", "dg", rewrite.GRAPH_POSITION)
        stored.append(lookup.translate(moved, filled, "lg", "dg", GRAPH_REF_POSITIONS))
    managed = spark.range(18).select(
        graph_iri(F.col("id")).alias("lg"),
        (F.col("id") < 16).alias("is_public"),
        F.when(F.col("id") < 16, F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("issued"),
    )
    managed = managed.unionByName(
        spark.range(1).select(
            F.lit(VOCAB.modified_graph).alias("lg"), F.lit(True).alias("is_public"), F.lit(None).cast("timestamp").alias("issued")
        )
    )
    sets = local_table(
        spark, [(DS1, "ann", "First"), (DS2, "bob", None)], struct("draftset STRING, owner STRING, title STRING")
    )
    made = F.lit("2024-02-01 00:00:00").cast("timestamp")
    draftsets = sets.select(
        "draftset",
        made.alias("created"),
        made.alias("modified"),
        version_iri(F.md5("draftset"), VOCAB).alias("version"),
        F.col("owner").alias("creator"),
        "owner",
        "title",
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("submitted_by"),
    )
    endpoints = spark.range(1).select(
        F.lit("public").alias("id"),
        F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created"),
        F.lit("2024-02-10 00:00:00").cast("timestamp").alias("modified"),
        version_iri(F.md5(F.lit("public")), VOCAB).alias("version"),
    )
    return Snapshot(
        live=live.select(*QUAD_COLS),
        draft=stored[0].unionByName(stored[1]).select(*QUAD_COLS),
        managed_graphs=managed,
        draft_graphs=rows[DS1].unionByName(rows[DS2]),
        draftsets=draftsets,
        submissions=empty_table(spark, "submissions"),
        shares=empty_table(spark, "shares"),
        graph_modified=event_times(read(spark, sf_dir, "events"), rows),
        endpoints=endpoints,
    )


def event_times(events: DataFrame, rows: dict[str, DataFrame]) -> DataFrame:
    """Published times per graph from all events; draft times from all, by other graphs, a day later."""
    ts = F.col("ts").cast("timestamp")
    live = events.groupBy(graph_iri(F.col("user_id") % 16).alias("graph")).agg(F.max(ts).alias("modified"))
    whole = events.agg(F.max(ts).alias("modified")).select(F.lit(VOCAB.modified_graph).alias("graph"), "modified")
    later = F.max(ts) + F.expr("INTERVAL 1 DAY")
    per_graph = events.groupBy(graph_iri(F.col("user_id") % 18).alias("lg")).agg(later.alias("modified"))
    own = events.agg(later.alias("modified")).select(F.lit(VOCAB.modified_graph).alias("lg"), "modified")
    parts = [live.unionByName(whole).select(F.lit(LIVE_SCOPE).alias("scope"), "graph", "modified")]
    for ds, pairs in rows.items():
        named = per_graph.unionByName(own).join(F.broadcast(pairs), "lg")
        parts.append(named.select(F.lit(ds).alias("scope"), F.col("dg").alias("graph"), "modified"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# A registry whose bookkeeping tables grow with the data: a managed graph per part, a draftset per
# supplier, a draft graph per (part, supplier) pair of line items (empty if none is finished), a user
# per customer.

PART_GRAPH = EX + "graph/part/"


@lru_cache(maxsize=8)
def registry(spark: SparkSession, sf_dir: str) -> Snapshot:
    return stored(derived_registry(spark, sf_dir))


def derived_registry(spark: SparkSession, sf_dir: str) -> Snapshot:
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    lineitem, events = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "events")
    key = F.col("p_partkey")
    origin = F.lit("2020-01-01 00:00:00").cast("timestamp")
    public = F.col("p_size") % 3 != 0
    managed = part.select(
        F.concat(F.lit(PART_GRAPH), _text(key)).alias("lg"),
        public.alias("is_public"),
        F.when(public, F.timestamp_add("MINUTE", (key % 100_000).cast("int"), origin)).alias("issued"),
    )
    drafts = (
        lineitem.select("l_partkey", "l_suppkey")
        .distinct()
        .select(
            F.concat(F.lit("ds-"), _text(F.col("l_suppkey"))).alias("draftset"),
            F.concat(F.lit(PART_GRAPH), _text(F.col("l_partkey"))).alias("lg"),
        )
    )
    drafts = drafts.select(draft_graph_iri(F.col("draftset"), F.col("lg"), VOCAB).alias("dg"), "lg", "draftset", origin.alias("created"))
    # Quads are equal where their numbers are: duplicates go before the names are made.
    known = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    filled = lineitem.filter(F.col("l_linestatus") == "F").select(
        "l_suppkey",
        "l_partkey",
        *[F.when(known, F.col(c)).alias(c) for c in ("l_orderkey", "l_linenumber")],
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    home = draft_graph_iri(
        F.concat(F.lit("ds-"), _text(F.col("l_suppkey"))), F.concat(F.lit(PART_GRAPH), _text(F.col("l_partkey"))), VOCAB
    )
    draft = from_table(
        deal(filled, "l_orderkey", "l_linenumber").dropDuplicates(),
        home,
        F.concat(F.lit(LINE), _text(F.col("l_orderkey")), F.lit("-"), _text(F.col("l_linenumber"))),
        {P + "quantity": T.literal(_text(F.col("quantity")), XSD + "integer")},
    )
    live = from_table(
        part,
        F.concat(F.lit(PART_GRAPH), _text(key)),
        F.concat(F.lit(EX + "part/"), _text(key)),
        {P + "brand": T.literal(F.col("p_brand")), P + "size": T.literal(_text(F.col("p_size")), XSD + "integer")},
    )
    sk = F.col("s_suppkey")
    submitted = sk % 4 == 0
    sets = supplier.select(
        F.concat(F.lit("ds-"), _text(sk)).alias("draftset"),
        origin.alias("created"),
        F.timestamp_add("HOUR", (sk % 10_000).cast("int"), origin).alias("modified"),
        version_iri(F.md5(_text(sk)), VOCAB).alias("version"),
        F.concat(F.lit("user-"), _text(sk % 50)).alias("creator"),
        F.when(~submitted, F.concat(F.lit("user-"), _text(sk % 50))).alias("owner"),
        F.when(sk % 5 != 0, F.col("s_name")).alias("title"),
        F.when(sk % 3 == 0, F.lit("checked")).alias("description"),
        F.when(submitted, F.concat(F.lit("user-"), _text(sk % 50))).alias("submitted_by"),
    )
    offered = supplier.filter(submitted).select(
        F.concat(F.lit("ds-"), _text(sk)).alias("draftset"),
        F.concat(F.lit("sub-"), _text(sk)).alias("submission"),
        F.when(sk % 8 == 0, F.concat(F.lit("user-"), _text(sk % 7))).alias("claim_user"),
        F.when(sk % 8 != 0, F.lit(VOCAB.permission_prefix + "claim")).alias("claim_permission"),
    )
    shared = supplier.filter(sk % 6 == 1)
    shares = shared.select(
        F.concat(F.lit("ds-"), _text(sk)).alias("draftset"),
        F.explode(F.array(F.lit("user-1"), F.concat(F.lit("user-"), _text(sk % 9)))).alias("view_user"),
        F.lit(None).cast("string").alias("view_permission"),
    ).unionByName(
        supplier.filter(sk % 6 == 2).select(
            F.concat(F.lit("ds-"), _text(sk)).alias("draftset"),
            F.lit(None).cast("string").alias("view_user"),
            F.lit(VOCAB.permission_prefix + "view").alias("view_permission"),
        )
    )
    times = events.groupBy((F.col("event_id") % 1000).alias("k")).agg(F.max(F.col("ts").cast("timestamp")).alias("modified"))
    times = times.select(F.lit(LIVE_SCOPE).alias("scope"), F.concat(F.lit(PART_GRAPH), _text(F.col("k"))).alias("graph"), "modified")
    endpoints = spark.range(1).select(
        F.lit("public").alias("id"),
        origin.alias("created"),
        F.lit("2020-01-02 00:00:00").cast("timestamp").alias("modified"),
        version_iri(F.md5(F.lit("public")), VOCAB).alias("version"),
    )
    return Snapshot(live, draft, managed, drafts, sets, offered, shares.distinct(), times, endpoints)


PRELUDE = f"""
WITH live_q AS (
  SELECT 'http://example.com/graph/'||(o_custkey % 16) AS g, 'http://example.com/order/'||o_orderkey AS s, 'iri' AS s_kind,
         'http://example.com/p/status' AS p, o_orderstatus AS o, 'literal' AS o_kind, '{XSD}string' AS o_dt, '' AS o_lang, o_orderkey AS k FROM orders
  UNION ALL SELECT 'http://example.com/graph/'||(o_custkey % 16), 'http://example.com/order/'||o_orderkey, 'iri',
         'http://example.com/p/priority', o_orderpriority, 'literal', '{XSD}string', '', o_orderkey FROM orders
  UNION ALL SELECT 'http://example.com/graph/'||(o_custkey % 16), 'http://example.com/order/'||o_orderkey, 'iri',
         'http://example.com/p/customer', 'http://example.com/customer/'||o_custkey, 'iri', '', '', o_orderkey FROM orders
  UNION ALL SELECT 'http://example.com/graph/'||(o_custkey % 16), 'http://example.com/order/'||o_orderkey, 'iri',
         'http://example.com/p/priceCents', CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR), 'literal', '{XSD}integer', '', o_orderkey FROM orders
  UNION ALL SELECT 'http://example.com/graph/'||(o_custkey % 16), 'http://example.com/order/'||o_orderkey, 'iri',
         'http://example.com/p/date', strftime(o_orderdate, '%Y-%m-%d'), 'literal', '{XSD}date', '', o_orderkey FROM orders
  UNION ALL SELECT 'http://example.com/graph/'||(o_custkey % 16), 'http://example.com/order/'||o_orderkey, 'iri',
         'http://example.com/p/seeAlso', 'http://example.com/graph/'||(o_orderkey % 16), 'iri', '', '', o_orderkey FROM orders WHERE o_orderkey % 20 = 0
),
line_q AS (
  SELECT DISTINCT * FROM (
  SELECT 'http://example.com/graph/'||(([0,1,2,3,16,17])[l_partkey % 6 + 1]) AS g, 'http://example.com/line/'||l_orderkey||'-'||l_linenumber AS s, 'iri' AS s_kind,
         'http://example.com/p/shipDate' AS p, strftime(l_shipdate, '%Y-%m-%d') AS o, 'literal' AS o_kind, '{XSD}date' AS o_dt, '' AS o_lang FROM lineitem
  UNION ALL SELECT 'http://example.com/graph/'||(([0,1,2,3,16,17])[l_partkey % 6 + 1]), 'http://example.com/line/'||l_orderkey||'-'||l_linenumber, 'iri',
         'http://example.com/p/partOf', 'http://example.com/order/'||l_orderkey, 'iri', '', '' FROM lineitem
  UNION ALL SELECT 'http://example.com/graph/'||(([0,1,2,3,16,17])[l_partkey % 6 + 1]), 'http://example.com/line/'||l_orderkey||'-'||l_linenumber, 'iri',
         'http://example.com/p/seeAlso', 'http://example.com/graph/'||((l_partkey // 18) % 18), 'iri', '', '' FROM lineitem WHERE l_orderkey % 20 = 0
  )
),
numbers AS (SELECT unnest(range(18)) AS n),
modg AS (SELECT 'http://example.org/quadweave/graphs/graph-modified-times' AS lg),
managed AS (
  SELECT 'http://example.com/graph/'||n AS lg, n < 16 AS is_public, CASE WHEN n < 16 THEN TIMESTAMP '2020-01-01' END AS issued FROM numbers
  UNION ALL SELECT lg, true, NULL FROM modg
),
dgs AS (
  SELECT 'http://example.org/quadweave/graphs/draft/'||md5(draftset||'|'||lg) AS dg, lg, draftset FROM (
    SELECT 'ds-1' AS draftset, 'http://example.com/graph/'||n AS lg FROM numbers WHERE n IN (0,1,2,3,4,16,17)
    UNION ALL SELECT 'ds-1', lg FROM modg
    UNION ALL SELECT 'ds-2', 'http://example.com/graph/'||n FROM numbers WHERE n IN (3,5)
    UNION ALL SELECT 'ds-2', lg FROM modg)
),
content AS (
  SELECT 'ds-1' AS draftset, g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM live_q
   WHERE g IN ('http://example.com/graph/0','http://example.com/graph/1','http://example.com/graph/2','http://example.com/graph/3') AND k % 7 <> 0
  UNION ALL SELECT 'ds-1', g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM line_q
  UNION ALL SELECT 'ds-2', g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM live_q
   WHERE g IN ('http://example.com/graph/3','http://example.com/graph/5') AND k % 11 <> 0
),
filled AS (SELECT d.* FROM dgs d WHERE EXISTS (SELECT 1 FROM content c WHERE c.draftset = d.draftset AND c.g = d.lg)),
draft_q AS (
  SELECT c.draftset, d.dg AS g, coalesce(ms.dg, c.s) AS s, c.s_kind, coalesce(mp.dg, c.p) AS p,
         CASE WHEN c.o_kind = 'iri' THEN coalesce(mo.dg, c.o) ELSE c.o END AS o, c.o_kind, c.o_dt, c.o_lang
  FROM content c JOIN dgs d ON d.draftset = c.draftset AND d.lg = c.g
  LEFT JOIN filled ms ON ms.draftset = c.draftset AND ms.lg = c.s
  LEFT JOIN filled mp ON mp.draftset = c.draftset AND mp.lg = c.p
  LEFT JOIN filled mo ON mo.draftset = c.draftset AND mo.lg = c.o
),
view_q AS (
  SELECT g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM content WHERE draftset = 'ds-1'
  UNION ALL SELECT g,s,s_kind,p,o,o_kind,o_dt,o_lang FROM live_q WHERE g NOT IN (SELECT lg FROM dgs WHERE draftset = 'ds-1')
),
times AS (
  SELECT 'live' AS scope, 'http://example.com/graph/'||(user_id % 16) AS graph, max(ts) AS modified FROM events GROUP BY ALL
  UNION ALL SELECT 'live', (SELECT lg FROM modg), max(ts) FROM events
  UNION ALL SELECT d.draftset, d.dg, t.modified FROM dgs d JOIN (
      SELECT 'http://example.com/graph/'||(user_id % 18) AS lg, max(ts) + INTERVAL 1 DAY AS modified FROM events GROUP BY ALL
      UNION ALL SELECT (SELECT lg FROM modg), max(ts) + INTERVAL 1 DAY FROM events) t ON t.lg = d.lg
),
draftsets AS (
  SELECT 'ds-1' AS draftset, 'http://example.org/quadweave/version/'||md5('ds-1') AS version, 'ann' AS owner
  UNION ALL SELECT 'ds-2', 'http://example.org/quadweave/version/'||md5('ds-2'), 'bob'
),
part_graphs AS (
  SELECT 'http://example.com/graph/part/'||p_partkey AS lg, p_size % 3 <> 0 AS is_public,
    CASE WHEN p_size % 3 <> 0 THEN TIMESTAMP '2020-01-01' + to_minutes(p_partkey % 100000) END AS issued, p_partkey AS k FROM part
),
part_drafts AS (
  SELECT 'http://example.org/quadweave/graphs/draft/'||md5(draftset||'|'||lg) AS dg, lg, draftset, filled FROM (
    SELECT 'ds-'||l_suppkey AS draftset, 'http://example.com/graph/part/'||l_partkey AS lg, bool_or(l_linestatus = 'F') AS filled
    FROM lineitem GROUP BY ALL)
),
part_q AS (
  SELECT DISTINCT 'http://example.org/quadweave/graphs/draft/'||md5('ds-'||l_suppkey||'|http://example.com/graph/part/'||l_partkey) AS g,
    'http://example.com/line/'||l_orderkey||'-'||l_linenumber AS s, 'http://example.com/p/quantity' AS p, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS o
  FROM lineitem WHERE l_linestatus = 'F'
),
part_sets AS (
  SELECT 'ds-'||s_suppkey AS draftset, s_suppkey AS k, TIMESTAMP '2020-01-01' + to_hours(s_suppkey % 10000) AS modified,
    'http://example.org/quadweave/version/'||md5(CAST(s_suppkey AS VARCHAR)) AS version,
    'user-'||(s_suppkey % 50) AS creator,
    CASE WHEN s_suppkey % 4 <> 0 THEN 'user-'||(s_suppkey % 50) END AS owner,
    CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS title,
    CASE WHEN s_suppkey % 3 = 0 THEN 'checked' END AS description,
    CASE WHEN s_suppkey % 4 = 0 THEN 'user-'||(s_suppkey % 50) END AS submitted_by,
    CASE WHEN s_suppkey % 4 = 0 THEN 'sub-'||s_suppkey END AS submission,
    CASE WHEN s_suppkey % 8 = 0 THEN 'user-'||(s_suppkey % 7) END AS claim_user,
    CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0 THEN 'quadweave:draft:claim' END AS claim_permission
  FROM supplier
),
part_shares AS (
  SELECT DISTINCT * FROM (
    SELECT 'ds-'||s_suppkey AS draftset, 'user-1' AS view_user, CAST(NULL AS VARCHAR) AS view_permission FROM supplier WHERE s_suppkey % 6 = 1
    UNION ALL SELECT 'ds-'||s_suppkey, 'user-'||(s_suppkey % 9), NULL FROM supplier WHERE s_suppkey % 6 = 1
    UNION ALL SELECT 'ds-'||s_suppkey, NULL, 'quadweave:draft:view' FROM supplier WHERE s_suppkey % 6 = 2)
)
"""


def sql(body: str) -> str:
    """A query over the tables of the prelude."""
    return PRELUDE + body
