"""Ownership, submission, sharing: summaries, listings, permissions, and replay of an action log.

Replaying a log is a prefix scan over composed transitions, in :mod:`quadweave.operators.replay`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.functions import scalars as S
from quadweave.operators import state
from quadweave.operators.replay import CLAIM, CREATE, SUBMIT_PERMISSION, SUBMIT_USER, SUBMITS, outcomes
from quadweave.operators.state import instant
from quadweave.schema import TABLES, Snapshot, Vocabulary, local_table, struct

# What each role adds to the one before it.
ROLE_STEPS = [
    ("norole", []),
    ("access", ["public:view"]),
    (
        "editor",
        [
            "draft:claim",
            "draft:create",
            "draft:delete",
            "draft:edit",
            "draft:submit",
            "draft:share",
            "draft:view",
            "job:view",
            "user:view",
        ],
    ),
    ("publisher", ["draft:publish"]),
    ("manager", ["draft:claim:manager"]),
]
SYSTEM_ROLE = "system"  # the same permissions as the last role


def role_permissions(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """``(role, permissions, rank)``; a higher rank includes all lower ones."""
    rows, have = [], []
    for rank, (role, more) in enumerate(ROLE_STEPS):
        have = [*have, *[vocab.permission_namespace + m for m in more]]
        rows.append((role, sorted(have), rank))
    rows.append((SYSTEM_ROLE, rows[-1][1], None))
    schema = T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("permissions", T.ArrayType(T.StringType())),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    return local_table(spark, rows, schema)


def with_role_permissions(users: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Users ``(user, role)`` with the permissions of their role; unknown roles have NULL."""
    roles = role_permissions(users.sparkSession, vocab).select("role", "permissions")
    return users.join(F.broadcast(roles), "role", "left")


def best_role(permissions: Column, spark: SparkSession, vocab: Vocabulary) -> Column:
    """Highest role whose permissions are all held."""
    choice = F.lit(ROLE_STEPS[0][0])
    have: list[str] = []
    for role, more in ROLE_STEPS[1:]:
        have = [*have, *[vocab.permission_namespace + m for m in more]]
        wanted = F.array(*map(F.lit, have))
        choice = F.when(F.size(F.array_except(wanted, permissions)) == 0, F.lit(role)).otherwise(choice)
    return choice


# Predicates over the columns of a summary. ``user`` and ``permissions`` may be columns or literals.


def is_owner(user: Column) -> Column:
    return F.coalesce(F.col("owner") == user, F.lit(False))


def can_claim(user: Column, permissions: Column) -> Column:
    submitter = F.col("owner").isNull() & (F.col("submitted_by") == user)
    permitted = F.array_contains(permissions, F.col("claim_permission"))
    named = F.col("claim_user") == user
    no = F.lit(False)
    return is_owner(user) | F.coalesce(submitter, no) | F.coalesce(permitted, no) | F.coalesce(named, no)


def can_view(user: Column, permissions: Column) -> Column:
    shared = F.array_contains("view_users", user) | F.arrays_overlap("view_permissions", permissions)
    return can_claim(user, permissions) | F.coalesce(shared, F.lit(False))


def permitted_operations(user: Column, permissions: Column, vocab: Vocabulary) -> Column:
    """Draft operations open to the user: all held ones for the owner, claim for claimants."""
    prefix = vocab.permission_prefix
    held = F.transform(
        F.filter(permissions, lambda p: p.startswith(prefix)),
        lambda p: F.substr(p, F.lit(len(prefix) + 1)),
    )
    nothing = F.array().cast("array<string>")
    return (
        F.when(is_owner(user), F.array_sort(F.array_distinct(held)))
        .when(can_claim(user, permissions), F.array(F.lit("claim")))
        .otherwise(nothing)
    )


def summary(snap: Snapshot) -> DataFrame:
    """One row per draftset: properties, submission, shares and the map of changed graphs."""
    shares = snap.shares.groupBy("draftset").agg(
        F.array_sort(F.collect_set("view_user")).alias("view_users"),
        F.array_sort(F.collect_set("view_permission")).alias("view_permissions"),
    )
    changes = state.changes_map(state.change_rows(snap.draft_graphs, snap.managed_graphs, snap.names("draft")))
    return (
        snap.draftsets.join(snap.submissions, "draftset", "left")
        .join(shares, "draftset", "left")
        .join(changes, "draftset", "left")
        .withColumns(
            {
                "view_users": F.coalesce("view_users", F.array().cast("array<string>")),
                "view_permissions": F.coalesce("view_permissions", F.array().cast("array<string>")),
            }
        )
    )


def listing(
    snap: Snapshot,
    user: str,
    permissions: Sequence[str],
    include: str = "all",
    union_with_live: bool = False,
    vocab: Vocabulary | None = None,
) -> DataFrame:
    """Summaries of the draftsets a user owns, may claim, or may see."""
    rows = summary(snap)
    who, held = F.lit(user), F.array(*map(F.lit, permissions)).cast("array<string>")
    if include == "owned":
        rows = rows.filter(F.col("owner") == who)
    elif include == "claimable":
        offered = F.col("submission").isNotNull() | (F.col("submitted_by") == who) & F.col("owner").isNull()
        rows = rows.filter(offered & can_claim(who, held))
    elif include == "all":
        rows = rows.filter(can_view(who, held))
    else:
        raise ValueError(f"include must be all, claimable or owned: {include}")
    return merge_public(rows, snap.endpoints, vocab or Vocabulary()) if union_with_live else rows


def merge_public(rows: DataFrame, endpoints: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Times and versions of draft endpoints seen together with the public one."""
    public = endpoints.filter(F.col("id") == "public").select(
        F.col("modified").alias("_pm"), F.col("version").alias("_pv"), F.lit("public").alias("_id")
    )
    joined = rows.withColumn("_id", F.lit("public")).join(F.broadcast(public), "_id", "left")
    return joined.withColumns(
        {
            "modified": F.when(F.col("_pm").isNotNull(), S.later(F.col("_pm"), F.col("modified"))).otherwise(
                F.col("modified")
            ),
            "version": S.merge_versions(F.col("_pv"), F.col("version"), vocab),
        }
    ).select(*rows.columns)


def create_draftset(
    draftsets: DataFrame, draftset: str, creator: str, now, vocab: Vocabulary, title=None, description=None
) -> DataFrame:
    t = instant(now)
    row = draftsets.sparkSession.range(1).select(
        F.lit(draftset).alias("draftset"),
        t.alias("created"),
        t.alias("modified"),
        S.version_iri(S.keyed_uuid(F.lit(draftset), t.cast("string")), vocab).alias("version"),
        F.lit(creator).alias("creator"),
        F.lit(creator).alias("owner"),
        F.lit(title).cast("string").alias("title"),
        F.lit(description).cast("string").alias("description"),
        F.lit(None).cast("string").alias("submitted_by"),
    )
    return draftsets.unionByName(row)


def set_metadata(draftsets: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the titles and descriptions given in ``changes(draftset, title, description)``."""
    new = changes.select("draftset", F.col("title").alias("_t"), F.col("description").alias("_d"))
    return draftsets.join(new, "draftset", "left").select(
        *[
            F.coalesce("_t", "title").alias("title")
            if c == "title"
            else F.coalesce("_d", "description").alias("description")
            if c == "description"
            else F.col(c)
            for c in draftsets.columns
        ]
    )


def act(
    snap: Snapshot,
    draftset: str,
    actor: str,
    action: str,
    permissions: Sequence[str] = (),
    target: str | None = None,
    permission: str | None = None,
) -> tuple[str, Snapshot]:
    """One action on one draftset: its outcome and the tables after it."""
    mine = F.col("draftset") == draftset
    row = snap.draftsets.filter(mine).join(snap.submissions, "draftset", "left").first()
    if row is None:
        return "not-found", snap
    owns = row.owner == actor
    if action == CLAIM:
        if row.owner is None:
            named = actor in (row.submitted_by, row.claim_user) or row.claim_permission in permissions
            if not named:
                return "forbidden", snap
        elif not owns:
            return "forbidden", snap
        owner = F.when(mine, F.lit(actor)).otherwise(F.col("owner"))
        return "ok", snap.but(
            draftsets=snap.draftsets.withColumn("owner", owner), submissions=snap.submissions.filter(~mine)
        )
    if not owns:
        return "ignored", snap
    if action in SUBMITS:
        sets = snap.draftsets.withColumns(
            {
                "owner": F.when(~mine, F.col("owner")),
                "submitted_by": F.when(mine, F.lit(actor)).otherwise(F.col("submitted_by")),
            }
        )
        offer = (draftset, str(uuid.uuid4()), target, permission)
        submissions = local_table(snap.spark, [offer], TABLES["submissions"])
        return "ok", snap.but(draftsets=sets, submissions=snap.submissions.filter(~mine).unionByName(submissions))
    if action in (SHARE_USER, SHARE_PERMISSION):
        share = local_table(snap.spark, [(draftset, target, permission)], TABLES["shares"])
        return "ok", snap.but(shares=snap.shares.unionByName(share).distinct())
    if action == UNSHARE:
        return "ok", snap.but(shares=snap.shares.filter(~mine))
    raise ValueError(f"unknown action: {action}")


# Replay of an action log.

LOG = struct(
    "draftset STRING, seq BIGINT, actor STRING, action STRING, target STRING, permission STRING, "
    "title STRING, description STRING"
)
SHARE_USER, SHARE_PERMISSION, UNSHARE = "share_with_user", "share_with_permission", "unshare"
METADATA = "set_metadata"


def replay(log: DataFrame, users: DataFrame) -> DataFrame:
    """The log with the ``outcome`` of each action: see :mod:`quadweave.operators.replay`.

    ok, forbidden (no right to claim), not-found (no such draftset yet), ignored (not the owner,
    nothing changes), exists (created before).
    """
    return outcomes(log, users)


def current_state(replayed: DataFrame) -> DataFrame:
    """Draftsets after the replay: owner, submission, submitter, texts and shares."""
    done = replayed.filter(F.col("outcome") == "ok")
    action = F.col("action")
    owning = action.isin(CREATE, CLAIM, *SUBMITS)
    seq = F.col("seq")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when, seq))

    changed = F.struct("action", "actor", "target", "permission")
    base = done.groupBy("draftset").agg(
        F.min_by("actor", F.when(action == CREATE, seq)).alias("creator"),
        last(changed, owning).alias("_last"),
        last(F.col("actor"), action.isin(*SUBMITS)).alias("submitted_by"),
        last(F.col("title"), F.col("title").isNotNull() & action.isin(METADATA, CREATE)).alias("title"),
        last(F.col("description"), F.col("description").isNotNull() & action.isin(METADATA, CREATE)).alias("description"),
    )
    submitted = F.col("_last.action").isin(*SUBMITS)
    shares = current_shares(replayed).groupBy("draftset").agg(
        F.array_sort(F.collect_set("view_user")).alias("view_users"),
        F.array_sort(F.collect_set("view_permission")).alias("view_permissions"),
    )
    return base.join(shares, "draftset", "left").select(
        "draftset",
        "creator",
        F.when(~submitted, F.col("_last.actor")).alias("owner"),
        "submitted_by",
        F.when(F.col("_last.action") == SUBMIT_USER, F.col("_last.target")).alias("claim_user"),
        F.when(F.col("_last.action") == SUBMIT_PERMISSION, F.col("_last.permission")).alias("claim_permission"),
        "title",
        "description",
        F.coalesce("view_users", F.array().cast("array<string>")).alias("view_users"),
        F.coalesce("view_permissions", F.array().cast("array<string>")).alias("view_permissions"),
    )


def current_shares(replayed: DataFrame) -> DataFrame:
    """Shares made after the last effective unshare of their draftset."""
    done = replayed.filter(F.col("outcome") == "ok")
    cleared = done.filter(F.col("action") == UNSHARE).groupBy("draftset").agg(F.max("seq").alias("_cleared"))
    shared = done.filter(F.col("action").isin(SHARE_USER, SHARE_PERMISSION)).join(cleared, "draftset", "left")
    return (
        shared.filter(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
        .select(
            "draftset",
            F.when(F.col("action") == SHARE_USER, F.col("target")).alias("view_user"),
            F.when(F.col("action") == SHARE_PERMISSION, F.col("permission")).alias("view_permission"),
        )
        .distinct()
    )
