"""Integrity of the bookkeeping tables, backfills of older data, consistency of drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.scalars import draft_graph_iri, is_user_graph
from quadweave.operators import compare, lookup
from quadweave.operators.rewrite import ALL_POSITIONS
from quadweave.operators.state import instant
from quadweave.schema import LIVE_SCOPE, QUAD_COLS, Snapshot, Vocabulary


def violations(snap: Snapshot) -> DataFrame:
    """``(rule, subject)`` for every broken integrity rule of the bookkeeping tables."""
    drafts, managed, sets = snap.draft_graphs, snap.managed_graphs, snap.draftsets
    found = {
        "inDraftSet range is a draftset": drafts.join(sets, "draftset", "left_anti").select("dg"),
        "hasDraft domain is a managed graph": drafts.join(managed, "lg", "left_anti").select("dg"),
        "managed graph states isPublic": managed.filter(F.col("is_public").isNull()).select("lg"),
        "isPublic is single-valued": managed.groupBy("lg")
        .agg(F.count_distinct("is_public").alias("n"))
        .filter("n > 1")
        .select("lg"),
        "draft graph is in one draftset": drafts.groupBy("dg")
        .agg(F.count_distinct("draftset").alias("n"))
        .filter("n > 1")
        .select("dg"),
        "draftset has a creation time": sets.filter(F.col("created").isNull()).select("draftset"),
        "draftset has a modified time": sets.filter(F.col("modified").isNull()).select("draftset"),
        "owner is a user": sets.filter(
            F.col("owner").isNotNull() & ~F.col("owner").rlike("^(mailto:)?[^:/ ]+$")
        ).select("draftset"),
        "submission belongs to a draftset": snap.submissions.join(sets, "draftset", "left_anti").select("submission"),
    }
    parts = [
        rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).alias("subject")).distinct()
        for rule, rows in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def backfill_times(snap: Snapshot, now, vocab: Vocabulary) -> Snapshot:
    """Give every public graph and every draft graph a modified time, keeping the ones there are.

    Every draftset with changes gets a times graph.
    """
    times = snap.graph_modified
    public = snap.managed_graphs.filter("is_public").select(F.lit(LIVE_SCOPE).alias("scope"), F.col("lg").alias("graph"))
    changed = snap.draft_graphs.filter(is_user_graph(F.col("lg"), vocab)).select("draftset").distinct()
    lacking = changed.join(snap.draft_graphs.filter(F.col("lg") == vocab.modified_graph), "draftset", "left_anti")
    rows = lacking.select("draftset", F.lit(vocab.modified_graph).alias("lg"))
    made = rows.select(
        draft_graph_iri(F.col("draftset"), F.col("lg"), vocab).alias("dg"), "lg", "draftset", instant(now).alias("created")
    )
    draft_graphs = snap.draft_graphs.unionByName(made)
    wanted = public.unionByName(draft_graphs.select(F.col("draftset").alias("scope"), F.col("dg").alias("graph")))
    fresh = wanted.distinct().join(times, ["scope", "graph"], "left_anti").withColumn("modified", instant(now))
    return snap.but(draft_graphs=draft_graphs, graph_modified=times.unionByName(fresh))


# The permission that stands for a role in older submissions.
ROLE_PERMISSIONS = {"editor": "edit"}
OTHER_ROLE = "publish"


def claim_roles(submissions: DataFrame, role: str = "claim_role") -> DataFrame:
    """Distinct roles in use, to check before the backfill."""
    return submissions.filter(F.col(role).isNotNull()).select(role).distinct()


def backfill_claim_permissions(submissions: DataFrame, vocab: Vocabulary, role: str = "claim_role") -> DataFrame:
    """Replace the old role column by the permission it stands for."""
    name = F.lit(OTHER_ROLE)
    for known, permission in ROLE_PERMISSIONS.items():
        name = F.when(F.col(role) == known, F.lit(permission)).otherwise(name)
    permission = F.when(F.col(role).isNotNull(), F.concat(F.lit(vocab.permission_prefix), name))
    return submissions.withColumn("claim_permission", F.coalesce("claim_permission", permission)).drop(role)


def consistency_gaps(stored: DataFrame, inputs: DataFrame, deletes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Quads by which a stored draft differs from mapping(inputs - deletes); empty when consistent.

    Digests tell which parts of graphs differ; a consistent draft costs one aggregate of each side. What is
    expected is made once and staged, as both the digests and the parts that differ read it.
    """
    left = lookup.minus(inputs.select(*QUAD_COLS).dropDuplicates(), deletes)
    expected = lookup.once(lookup.translate(left, pairs, "lg", "dg", ALL_POSITIONS))
    found = compare.gaps(stored, expected)
    return found.withColumn("side", F.when(F.col("side") > 0, "only stored").otherwise("only expected"))

