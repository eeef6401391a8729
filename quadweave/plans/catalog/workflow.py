"""Draftset listings, permissions, and replay of an action log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.operators import workflow
from quadweave.plans import fixtures as fx
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import NOW, VOCAB, sql

USER = "user-1"
HELD = [VOCAB.permission_prefix + p for p in ("claim", "edit", "view")] + [VOCAB.permission_namespace + "public:view"]

_SUMMARY = """SELECT p.*, coalesce((SELECT string_agg(DISTINCT view_user, ' ' ORDER BY view_user) FROM part_shares s WHERE s.draftset = p.draftset), '') AS view_users,
  coalesce((SELECT string_agg(DISTINCT view_permission, ' ' ORDER BY view_permission) FROM part_shares s WHERE s.draftset = p.draftset), '') AS view_permissions,
  coalesce((SELECT count(*) FROM part_drafts d WHERE d.draftset = p.draftset), 0) AS changes FROM part_sets p"""
_CLAIM = "(coalesce(owner = 'user-1', false) OR (owner IS NULL AND submitted_by = 'user-1') OR coalesce(claim_permission = 'quadweave:draft:claim', false) OR coalesce(claim_user = 'user-1', false))"
_VIEW = f"({_CLAIM} OR list_contains(string_split(view_users, ' '), 'user-1') OR view_permissions = 'quadweave:draft:view')"


@register(
    "w1_draftset_summaries",
    sql(
        f"""SELECT draftset, creator, owner, title, description, submitted_by, submission, claim_user, claim_permission, view_users, view_permissions,
        changes, epoch_us(modified) AS modified, version FROM ({_SUMMARY})"""
    ),
)
def draftset_summaries(spark, sf_dir):
    rows = workflow.summary(fx.registry(spark, sf_dir))
    return rows.select(
        "draftset", "creator", "owner", "title", "description", "submitted_by", "submission", "claim_user", "claim_permission",
        F.concat_ws(" ", "view_users").alias("view_users"),
        F.concat_ws(" ", "view_permissions").alias("view_permissions"),
        F.coalesce(F.size("changes"), F.lit(0)).cast("bigint").alias("changes"),
        F.unix_micros("modified").alias("modified"),
        "version",
    )


@register("w2_owned_draftsets", sql("SELECT draftset, title FROM part_sets WHERE owner = 'user-1'"))
def owned_draftsets(spark, sf_dir):
    return workflow.listing(fx.registry(spark, sf_dir), USER, HELD, "owned").select("draftset", "title")


@register(
    "w2_claimable_draftsets",
    sql(f"SELECT draftset, claim_user, claim_permission FROM ({_SUMMARY}) WHERE submission IS NOT NULL AND {_CLAIM}"),
)
def claimable_draftsets(spark, sf_dir):
    rows = workflow.listing(fx.registry(spark, sf_dir), USER, HELD, "claimable")
    return rows.select("draftset", "claim_user", "claim_permission")


@register(
    "w2_all_draftsets_union_live",
    sql(
        f"""SELECT draftset, epoch_us(greatest(modified, TIMESTAMP '2020-01-02')) AS modified, 'http://example.org/quadweave/version/'||
        md5(least(md5(CAST(k AS VARCHAR)), md5('public'))||greatest(md5(CAST(k AS VARCHAR)), md5('public'))) AS version FROM ({_SUMMARY}) WHERE {_VIEW}"""
    ),
)
def all_draftsets_union_live(spark, sf_dir):
    rows = workflow.listing(fx.registry(spark, sf_dir), USER, HELD, "all", union_with_live=True, vocab=VOCAB)
    return rows.select("draftset", F.unix_micros("modified").alias("modified"), "version")


@register(
    "w3_permission_predicates",
    sql(f"SELECT draftset, {_CLAIM} AS can_claim, {_VIEW} AS can_view FROM ({_SUMMARY})"),
)
def permission_predicates(spark, sf_dir):
    who, held = F.lit(USER), F.array(*map(F.lit, HELD))
    rows = workflow.summary(fx.registry(spark, sf_dir))
    return rows.select(
        "draftset", workflow.can_claim(who, held).alias("can_claim"), workflow.can_view(who, held).alias("can_view")
    )


@register(
    "w4_permitted_operations",
    sql(
        f"""SELECT draftset, CASE WHEN owner = 'user-1' THEN 'claim edit view' WHEN {_CLAIM} THEN 'claim' ELSE '' END AS operations FROM ({_SUMMARY})"""
    ),
)
def permitted_operations(spark, sf_dir):
    held = F.array(*map(F.lit, HELD))
    rows = workflow.summary(fx.registry(spark, sf_dir))
    return rows.select(
        "draftset", F.concat_ws(" ", workflow.permitted_operations(F.lit(USER), held, VOCAB)).alias("operations")
    )


_ROLE = "['norole','access','editor','publisher','manager','system','guest']"


@register(
    "w5_role_permissions",
    f"""SELECT c_custkey, {_ROLE}[c_custkey % 7 + 1] AS role, [0, 1, 10, 11, 12, 12, NULL][c_custkey % 7 + 1]::BIGINT AS permissions,
      ['norole','access','editor','publisher','manager','manager',NULL][c_custkey % 7 + 1] AS best FROM customer""",
)
def role_permissions(spark, sf_dir):
    roles = ["norole", "access", "editor", "publisher", "manager", "system", "guest"]
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("c_custkey") % 7 + 1).cast("int"))
    users = fx.read(spark, sf_dir, "customer").select("c_custkey", role.alias("role"))
    held = workflow.with_role_permissions(users, VOCAB)
    best = F.when(F.col("permissions").isNotNull(), workflow.best_role(F.col("permissions"), spark, VOCAB))
    return held.select(
        "c_custkey", "role", F.when(F.col("permissions").isNotNull(), F.size("permissions")).cast("bigint").alias("permissions"), best.alias("best")
    )


@register(
    "w6_create_draftset",
    sql(
        f"""SELECT draftset, creator, owner, title, epoch_us(modified) AS modified FROM part_sets
        UNION ALL SELECT 'ds-new', 'ann', 'ann', 'New one', epoch_us(TIMESTAMP '{NOW}')"""
    ),
)
def create_draftset(spark, sf_dir):
    sets = fx.registry(spark, sf_dir).draftsets
    made = workflow.create_draftset(sets, "ds-new", "ann", NOW, VOCAB, title="New one")
    return made.select("draftset", "creator", "owner", "title", F.unix_micros("modified").alias("modified"))


# An action log per order: customers are users, orders are draftsets, line items are actions.
# Outcomes and states are stated as a recursion over each log, one action after the other.

_ACTIONS = ["submit_to_user", "claim", "share_with_user", "claim", "submit_to_permission", "set_metadata", "claim", "share_with_permission", "unshare"]


def action_log(spark, sf_dir):
    """Draftset per supplier; each line item is one action on it, by one of five users."""
    line, supplier = fx.read(spark, sf_dir, "lineitem"), fx.read(spark, sf_dir, "supplier")
    key, part, number = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    step = (key * 7 + number).cast("bigint")
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (part % len(_ACTIONS) + 1).cast("int"))
    actions = line.groupBy(F.col("l_suppkey").alias("k"), step.alias("seq")).agg(
        F.min(F.struct(part.alias("part"), action.alias("action"))).alias("a")
    )
    part = F.col("a.part")
    log = actions.select(
        F.concat(F.lit("ds-"), F.col("k").cast("string")).alias("draftset"),
        F.col("seq"),
        F.concat(F.lit("u"), (part % 5).cast("string")).alias("actor"),
        F.col("a.action").alias("action"),
        F.concat(F.lit("u"), (part % 3).cast("string")).alias("target"),
        F.concat(F.lit(VOCAB.permission_prefix + "p"), (part % 2).cast("string")).alias("permission"),
        F.when(part % 2 == 0, F.concat(F.lit("t"), part.cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("description"),
    )
    create = supplier.select(
        F.concat(F.lit("ds-"), F.col("s_suppkey").cast("string")).alias("draftset"),
        F.lit(20).cast("bigint").alias("seq"),
        F.concat(F.lit("u"), (F.col("s_suppkey") % 5).cast("string")).alias("actor"),
        F.lit("create").alias("action"),
        *[F.lit(None).cast("string").alias(c) for c in ("target", "permission", "title", "description")],
    )
    return log.join(create.select("draftset", "seq"), ["draftset", "seq"], "left_anti").unionByName(create).select(*workflow.LOG.fieldNames())


def log_users(spark):
    return workflow.role_permissions(spark, VOCAB).limit(0).select(
        F.col("role").alias("user"), "permissions"
    ).unionByName(
        spark.range(5).select(
            F.concat(F.lit("u"), F.col("id").cast("string")).alias("user"),
            F.when(F.col("id") >= 3, F.array(F.concat(F.lit(VOCAB.permission_prefix + "p"), (F.col("id") % 2).cast("string"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("permissions"),
        )
    )


_LOG = """
WITH RECURSIVE acts AS (
  SELECT l_suppkey AS k, (l_orderkey * 7 + l_linenumber)::BIGINT AS seq, min(l_partkey) AS part FROM lineitem GROUP BY ALL
),
log AS (
  SELECT 'ds-'||k AS draftset, seq, 'u'||(part % 5) AS actor,
    ['submit_to_user','claim','share_with_user','claim','submit_to_permission','set_metadata','claim','share_with_permission','unshare'][part % 9 + 1] AS action,
    'u'||(part % 3) AS target, 'quadweave:draft:p'||(part % 2) AS permission, CASE WHEN part % 2 = 0 THEN 't'||part END AS title FROM acts WHERE seq <> 20
  UNION ALL SELECT 'ds-'||s_suppkey, 20, 'u'||(s_suppkey % 5), 'create', NULL, NULL, NULL FROM supplier
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY draftset ORDER BY seq) AS rn FROM log),
walk AS (
  SELECT draftset, 0::BIGINT AS rn, NULL::BIGINT AS seq, false AS made, NULL::VARCHAR AS owner, NULL::VARCHAR AS sub, NULL::VARCHAR AS cu, NULL::VARCHAR AS cp,
    NULL::VARCHAR AS title, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT draftset FROM log)
  UNION ALL
  SELECT w.draftset, n.rn, n.seq, w.made OR n.action = 'create',
    CASE WHEN o = 'ok' AND n.action IN ('create', 'claim') THEN n.actor WHEN o = 'ok' AND n.action LIKE 'submit%' THEN NULL ELSE w.owner END,
    CASE WHEN o = 'ok' AND n.action LIKE 'submit%' THEN n.actor ELSE w.sub END,
    CASE WHEN o = 'ok' AND n.action = 'submit_to_user' THEN n.target WHEN o = 'ok' AND n.action IN ('submit_to_permission', 'claim') THEN NULL ELSE w.cu END,
    CASE WHEN o = 'ok' AND n.action = 'submit_to_permission' THEN n.permission WHEN o = 'ok' AND n.action IN ('submit_to_user', 'claim') THEN NULL ELSE w.cp END,
    CASE WHEN o = 'ok' AND n.action = 'set_metadata' THEN coalesce(n.title, w.title) ELSE w.title END, o
  FROM walk w JOIN numbered n ON n.draftset = w.draftset AND n.rn = w.rn + 1,
  LATERAL (SELECT CASE WHEN n.action = 'create' THEN CASE WHEN w.made THEN 'exists' ELSE 'ok' END WHEN NOT w.made THEN 'not-found'
    WHEN n.action = 'claim' THEN CASE WHEN coalesce(w.owner = n.actor, false) OR (w.owner IS NULL AND w.sub = n.actor) OR coalesce(w.cu = n.actor, false)
      OR coalesce((n.actor = 'u3' AND w.cp = 'quadweave:draft:p1') OR (n.actor = 'u4' AND w.cp = 'quadweave:draft:p0'), false) THEN 'ok' ELSE 'forbidden' END
    WHEN coalesce(w.owner = n.actor, false) THEN 'ok' ELSE 'ignored' END AS o) x
)
"""


@register("w7_replay_outcomes", _LOG + "SELECT w.draftset, w.seq, n.actor, n.action, w.outcome FROM walk w JOIN numbered n ON n.draftset = w.draftset AND n.rn = w.rn")
def replay_outcomes(spark, sf_dir):
    """Outcome of every action: submit, claim, share and metadata guards in order of the log."""
    done = workflow.replay(action_log(spark, sf_dir), log_users(spark))
    return done.select("draftset", "seq", "actor", "action", "outcome")


@register(
    "w8_claim_outcomes",
    _LOG + "SELECT n.actor, w.outcome, count(*) AS n FROM walk w JOIN numbered n ON n.draftset = w.draftset AND n.rn = w.rn WHERE n.action = 'claim' GROUP BY ALL",
)
def claim_outcomes(spark, sf_dir):
    done = workflow.replay(action_log(spark, sf_dir), log_users(spark))
    return done.filter(F.col("action") == workflow.CLAIM).groupBy("actor", "outcome").agg(F.count("*").alias("n"))


@register(
    "w9_current_shares",
    _LOG
    + """SELECT DISTINCT s.draftset, CASE WHEN s.action = 'share_with_user' THEN s.target END AS view_user, CASE WHEN s.action = 'share_with_permission' THEN s.permission END AS view_permission
    FROM (SELECT n.*, w.outcome FROM walk w JOIN numbered n ON n.draftset = w.draftset AND n.rn = w.rn WHERE n.action LIKE 'share%' AND w.outcome = 'ok') s
    WHERE NOT EXISTS (SELECT 1 FROM walk w JOIN numbered n ON n.draftset = w.draftset AND n.rn = w.rn
      WHERE n.action = 'unshare' AND w.outcome = 'ok' AND n.draftset = s.draftset AND n.seq > s.seq)""",
)
def current_shares(spark, sf_dir):
    return workflow.current_shares(workflow.replay(action_log(spark, sf_dir), log_users(spark)))


@register(
    "w10_set_metadata",
    sql(
        """SELECT draftset, CASE WHEN k % 2 = 0 THEN 'title '||k ELSE title END AS title, CASE WHEN k % 10 = 0 THEN 'text '||k ELSE description END AS description FROM part_sets"""
    ),
)
def set_metadata(spark, sf_dir):
    k = F.col("s_suppkey")
    text = k.cast("string")
    changes = fx.read(spark, sf_dir, "supplier").filter(k % 2 == 0).select(
        F.concat(F.lit("ds-"), text).alias("draftset"),
        F.concat(F.lit("title "), text).alias("title"),
        F.when(k % 10 == 0, F.concat(F.lit("text "), text)).alias("description"),
    )
    sets = workflow.set_metadata(fx.registry(spark, sf_dir).draftsets, changes)
    return sets.select("draftset", "title", "description")


@register(
    "w11_replayed_state",
    _LOG
    + """SELECT draftset, owner, sub AS submitted_by, cu AS claim_user, cp AS claim_permission, title FROM walk
    QUALIFY row_number() OVER (PARTITION BY draftset ORDER BY rn DESC) = 1""",
)
def replayed_state(spark, sf_dir):
    rows = workflow.current_state(workflow.replay(action_log(spark, sf_dir), log_users(spark)))
    return rows.select("draftset", "owner", "submitted_by", "claim_user", "claim_permission", "title")


