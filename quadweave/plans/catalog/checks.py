"""Integrity checks, backfills, consistency, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms as T
from quadweave.operators import inference, times, validate, writes
from quadweave.plans import fixtures as fx
from quadweave.plans import views
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import DS1, EX, GRAPH, NOW, VOCAB, sql
from quadweave.schema import QUAD_COLS, RDF_TYPE, RDFS_SUBCLASS
from quadweave.sources.quads import from_table

_RULES = [
    ("inDraftSet range is a draftset", "SELECT dg FROM bad_drafts WHERE draftset NOT IN (SELECT draftset FROM bad_sets)"),
    ("hasDraft domain is a managed graph", "SELECT dg FROM bad_drafts WHERE lg NOT IN (SELECT lg FROM bad_managed)"),
    ("managed graph states isPublic", "SELECT lg FROM bad_managed WHERE is_public IS NULL"),
    ("isPublic is single-valued", "SELECT lg FROM bad_managed GROUP BY lg HAVING count(DISTINCT is_public) > 1"),
    ("draft graph is in one draftset", "SELECT dg FROM bad_drafts GROUP BY dg HAVING count(DISTINCT draftset) > 1"),
    ("draftset has a modified time", "SELECT draftset FROM bad_sets WHERE modified IS NULL"),
    ("owner is a user", "SELECT draftset FROM bad_sets WHERE owner LIKE 'http%'"),
    ("submission belongs to a draftset", "SELECT submission FROM part_sets WHERE submission IS NOT NULL AND draftset NOT IN (SELECT draftset FROM bad_sets)"),
]


@register(
    "v1_constraint_violations",
    sql(
        """, bad_sets AS (SELECT draftset, CASE WHEN k % 9 <> 0 THEN modified END AS modified, CASE WHEN k % 10 = 1 THEN 'http://x/'||k ELSE owner END AS owner
          FROM part_sets WHERE k % 12 <> 0),
        bad_managed AS (SELECT lg, CASE WHEN k % 50 <> 0 THEN is_public END AS is_public FROM part_graphs WHERE k % 70 <> 1
          UNION ALL SELECT lg, NOT is_public FROM part_graphs WHERE k % 90 = 3),
        bad_drafts AS (SELECT dg, lg, draftset FROM part_drafts UNION ALL SELECT dg, lg, 'ds-5' FROM part_drafts WHERE draftset = 'ds-6')
        """
        + " UNION ALL ".join(f"SELECT DISTINCT '{rule}' AS rule, * FROM ({body}) t(subject)" for rule, body in _RULES)
    ),
)
def constraint_violations(spark, sf_dir):
    """Bookkeeping tables damaged in eight ways."""
    reg = fx.registry(spark, sf_dir)
    k = F.regexp_extract("draftset", r"(\d+)$", 1).cast("bigint")
    sets = reg.draftsets.filter(k % 12 != 0).withColumns(
        {
            "modified": F.when(k % 9 != 0, F.col("modified")),
            "owner": F.when(k % 10 == 1, F.concat(F.lit("http://x/"), k.cast("string"))).otherwise(F.col("owner")),
        }
    )
    part = F.regexp_extract("lg", r"(\d+)$", 1).cast("bigint")
    twice = reg.managed_graphs.filter(part % 90 == 3).withColumn("is_public", ~F.col("is_public"))
    managed = reg.managed_graphs.filter(part % 70 != 1).withColumn("is_public", F.when(part % 50 != 0, F.col("is_public")))
    shared = reg.draft_graphs.filter(F.col("draftset") == "ds-6").withColumn("draftset", F.lit("ds-5"))
    return validate.violations(
        reg.but(draftsets=sets, managed_graphs=managed.unionByName(twice), draft_graphs=reg.draft_graphs.unionByName(shared))
    )


@register(
    "v2_backfill_versions",
    sql("SELECT draftset, CASE WHEN k % 2 = 0 THEN version END AS old, true AS versioned FROM part_sets"),
)
def backfill_versions(spark, sf_dir):
    k = F.regexp_extract("draftset", r"(\d+)$", 1).cast("bigint")
    older = fx.registry(spark, sf_dir).draftsets.withColumn("version", F.when(k % 2 == 0, F.col("version")))
    filled = times.backfill_versions(older, VOCAB)
    both = older.select("draftset", F.col("version").alias("old")).join(filled.select("draftset", "version"), "draftset")
    same = F.col("version").isNotNull() & (F.col("old").isNull() | (F.col("old") == F.col("version")))
    return both.select("draftset", "old", same.alias("versioned"))


@register(
    "v3_backfill_times",
    sql(
        f""", known AS (SELECT 'http://example.com/graph/part/'||(event_id % 1000) AS graph, max(ts) AS modified FROM events GROUP BY ALL),
        own AS (SELECT DISTINCT draftset, '{VOCAB.draft_graph_base}'||md5(draftset||'|{VOCAB.modified_graph}') AS dg FROM part_drafts)
        SELECT 'live' AS scope, graph, epoch_us(modified) AS modified FROM known
        UNION ALL SELECT 'live', lg, epoch_us(TIMESTAMP '{NOW}') FROM part_graphs WHERE is_public AND lg NOT IN (SELECT graph FROM known)
        UNION ALL SELECT draftset, dg, epoch_us(TIMESTAMP '{NOW}') FROM (SELECT draftset, dg FROM part_drafts UNION ALL SELECT draftset, dg FROM own)"""
    ),
)
def backfill_times(spark, sf_dir):
    after = validate.backfill_times(fx.registry(spark, sf_dir), NOW, VOCAB)
    return after.graph_modified.select("scope", "graph", F.unix_micros("modified").alias("modified"))


@register(
    "v4_backfill_claim_permissions",
    sql(
        """SELECT draftset, CASE WHEN k % 8 = 0 THEN 'quadweave:draft:edit' ELSE 'quadweave:draft:publish' END AS claim_permission,
        (SELECT count(DISTINCT CASE WHEN k % 8 = 0 THEN 'editor' ELSE 'publisher' END) FROM part_sets WHERE k % 4 = 0) AS roles
        FROM part_sets WHERE k % 4 = 0"""
    ),
)
def backfill_claim_permissions(spark, sf_dir):
    k = F.regexp_extract("draftset", r"(\d+)$", 1).cast("bigint")
    older = fx.registry(spark, sf_dir).submissions.withColumns(
        {"claim_role": F.when(k % 8 == 0, "editor").otherwise("publisher"), "claim_permission": F.lit(None).cast("string")}
    )
    roles = validate.claim_roles(older).agg(F.count("*").alias("roles")).withColumn("_k", F.lit(0))
    filled = validate.backfill_claim_permissions(older, VOCAB).withColumn("_k", F.lit(0))
    return filled.join(F.broadcast(roles), "_k").select("draftset", "claim_permission", "roles")



@register(
    "v5_consistency_gaps",
    sql(
        f"""SELECT side, count(*) AS n FROM (SELECT 'only expected' AS side FROM (SELECT DISTINCT g, s, p, o FROM content
          WHERE draftset = 'ds-1' AND p = 'http://example.com/p/status' AND NOT o = 'F' AND o_kind = 'literal' AND s LIKE '%/order/%' AND regexp_extract(s, '([0-9]+)$', 1)::BIGINT % 5 = 0)) GROUP BY side"""
    ),
)
def consistency_gaps(spark, sf_dir):
    """The stored draft against mapping(input - deletes), after some quads were lost from the store."""
    snap = fx.snapshot(spark, sf_dir)
    inputs = views.draft_view(snap, DS1)
    status = F.col("p") == fx.P + "status"
    deletes = inputs.filter(status & (F.col("o") == "F"))
    number = F.regexp_extract("s", r"(\d+)$", 1).try_cast("bigint")
    mine = writes.split_draft(snap, DS1)[0]
    gone_or_lost = status & ((F.col("o") == "F") | (F.contains("s", F.lit("/order/")) & (number % 5 == 0)))
    stored = mine.filter(~F.coalesce(gone_or_lost, F.lit(False)))
    filled = writes.pairs_of(snap, DS1).filter(~F.col("lg").isin([GRAPH + str(n) for n in fx.DS1_EMPTIED]))
    return validate.consistency_gaps(stored, inputs, deletes, filled).groupBy("side").agg(F.count("*").alias("n"))


# A class hierarchy: nations below regions below Place below Thing-like Entity, customers typed by nation,
# segments below each other in a cycle.


def typed_quads(spark, sf_dir):
    nation, region, customer = (fx.read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    g = F.lit(GRAPH + "types")

    def cls(kind, key):
        return F.concat(F.lit(f"{EX}class/{kind}/"), key.cast("string"))

    return (
        from_table(nation, g, cls("nation", F.col("n_nationkey")), {RDFS_SUBCLASS: T.iri(cls("region", F.col("n_regionkey")))})
        .unionByName(from_table(region, g, cls("region", F.col("r_regionkey")), {RDFS_SUBCLASS: T.iri(F.lit(EX + "class/Place"))}))
        .unionByName(
            from_table(region.select(F.lit(1).alias("x")).distinct(), g, F.lit(EX + "class/Place"), {RDFS_SUBCLASS: T.iri(F.lit(EX + "class/Entity"))})
        )
        .unionByName(
            from_table(
                customer.select("c_mktsegment").distinct(), g, cls("segment", F.col("c_mktsegment")),
                {RDFS_SUBCLASS: T.iri(F.lit(EX + "class/segment/all"))},
            )
        )
        .unionByName(
            from_table(
                customer.select("c_mktsegment").distinct(), g, F.lit(EX + "class/segment/all"),
                {RDFS_SUBCLASS: T.iri(cls("segment", F.col("c_mktsegment")))},
            )
        )
        .unionByName(
            from_table(
                customer, g, F.concat(F.lit(fx.CUSTOMER), F.col("c_custkey").cast("string")),
                {RDF_TYPE: T.iri(F.when(F.col("c_custkey") % 2 == 0, cls("nation", F.col("c_nationkey"))).otherwise(cls("segment", F.col("c_mktsegment"))))},
            )
        )
        .select(*QUAD_COLS)
    )


_EDGES = """
WITH RECURSIVE edges AS (
  SELECT 'http://example.com/class/nation/'||n_nationkey AS sub, 'http://example.com/class/region/'||n_regionkey AS sup FROM nation
  UNION SELECT 'http://example.com/class/region/'||r_regionkey, 'http://example.com/class/Place' FROM region
  UNION SELECT 'http://example.com/class/Place', 'http://example.com/class/Entity'
  UNION SELECT 'http://example.com/class/segment/'||c_mktsegment, 'http://example.com/class/segment/all' FROM customer
  UNION SELECT 'http://example.com/class/segment/all', 'http://example.com/class/segment/'||c_mktsegment FROM customer
),
closed AS (SELECT sub, sup FROM edges UNION SELECT c.sub, e.sup FROM closed c JOIN edges e ON c.sup = e.sub),
typed AS (SELECT 'http://example.com/customer/'||c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN 'http://example.com/class/nation/'||c_nationkey
  ELSE 'http://example.com/class/segment/'||c_mktsegment END AS o FROM customer)
"""


@register("v6_subclass_closure", _EDGES + "SELECT sub, sup FROM closed")
def subclass_closure(spark, sf_dir):
    return inference.closure(inference.subclass_edges(typed_quads(spark, sf_dir)))


@register(
    "v6_inferred_types",
    _EDGES
    + """SELECT s, sup AS o FROM typed JOIN closed ON o = sub EXCEPT SELECT s, o FROM typed
    UNION ALL SELECT s, 'http://www.w3.org/2002/07/owl#Thing' FROM typed""",
)
def inferred_types(spark, sf_dir):
    return inference.inferred_types(typed_quads(spark, sf_dir), with_thing=True).select("s", "o")


@register("v6_query_with_inference", _EDGES + "SELECT DISTINCT s FROM typed JOIN closed ON o = sub WHERE sup = 'http://example.com/class/region/2'")
def query_with_inference(spark, sf_dir):
    """Members of a class through its subclasses."""
    view = inference.with_inference(typed_quads(spark, sf_dir))
    return view.filter((F.col("p") == RDF_TYPE) & (F.col("o") == EX + "class/region/2")).select("s").distinct()
