"""Modified times per graph, version stamps of draftsets and of the public endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions import scalars as S
from quadweave.functions.terms import datetime_lexical
from quadweave.operators import state
from quadweave.operators.state import instant
from quadweave.schema import DCT_MODIFIED, IRI, LITERAL, LIVE_SCOPE, XSD, Snapshot, Vocabulary

PUBLIC = "public"


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed replace: rows of ``table`` with a key in ``rows`` give way to the new ones."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def stamp_draftset(draftsets: DataFrame, draftset: str, now, vocab: Vocabulary) -> DataFrame:
    hit = F.col("draftset") == draftset
    version = S.version_iri(S.keyed_uuid(F.col("draftset"), F.col("version"), instant(now).cast("string")), vocab)
    return draftsets.withColumns(
        {
            "version": F.when(hit, version).otherwise(F.col("version")),
            "modified": F.when(hit, instant(now)).otherwise(F.col("modified")),
        }
    )


def touch(snap: Snapshot, draftset: str, drafts: DataFrame, now, vocab: Vocabulary) -> Snapshot:
    """Set the time of ``drafts(dg)`` and of the draftset's times graph; stamp the draftset."""
    managed, draft_graphs = state.ensure_protected_draft(
        snap.managed_graphs, snap.draft_graphs, vocab.modified_graph, draftset, now, vocab
    )
    own = snap.spark.range(1).select(
        S.draft_graph_iri(F.lit(draftset), F.lit(vocab.modified_graph), vocab).alias("dg")
    )
    rows = (
        drafts.select("dg")
        .unionByName(own)
        .distinct()
        .select(F.lit(draftset).alias("scope"), F.col("dg").alias("graph"), instant(now).alias("modified"))
    )
    return snap.but(
        managed_graphs=managed,
        draft_graphs=draft_graphs,
        graph_modified=upsert(snap.graph_modified, rows, ["scope", "graph"]),
        draftsets=stamp_draftset(snap.draftsets, draftset, now, vocab),
    )


def forget(snap: Snapshot, draftset: str, drafts: DataFrame, now, vocab: Vocabulary) -> Snapshot:
    """Drop the times of ``drafts(dg)``, already gone from the draftset.

    When no user graph is left in the draftset, its times graph goes too. The draftset is stamped.
    """
    mine = snap.draft_graphs.filter(F.col("draftset") == draftset)
    users_left = mine.filter(S.is_user_graph(F.col("lg"), vocab)).select("draftset").distinct()
    own = (F.col("draftset") == draftset) & (F.col("lg") == vocab.modified_graph)
    draft_graphs = snap.draft_graphs.filter(~own).unionByName(
        snap.draft_graphs.filter(own).join(users_left, "draftset", "left_semi").select(*mine.columns)
    )
    in_scope = F.col("scope") == draftset
    times = snap.graph_modified
    kept = (
        times.filter(in_scope)
        .join(drafts.select(F.col("dg").alias("graph")), "graph", "left_anti")
        .join(users_left.withColumnRenamed("draftset", "scope"), "scope", "left_semi")
    )
    return snap.but(
        draft_graphs=draft_graphs,
        managed_graphs=drop_orphans(snap.managed_graphs, draft_graphs, [vocab.modified_graph]),
        graph_modified=times.filter(~in_scope).unionByName(kept.select(*times.columns)),
        draftsets=stamp_draftset(snap.draftsets, draftset, now, vocab),
    )


def drop_orphans(managed_graphs: DataFrame, draft_graphs: DataFrame, candidates) -> DataFrame:
    """Remove private managed graphs among ``candidates`` that no draft refers to any more."""
    if isinstance(candidates, DataFrame):
        named = managed_graphs.join(candidates.select("lg").distinct(), "lg", "left_semi")
    else:
        named = managed_graphs.filter(F.col("lg").isin(list(candidates)))
    gone = named.filter(~F.col("is_public")).join(draft_graphs, "lg", "left_anti").select("lg")
    return managed_graphs.join(gone, "lg", "left_anti").select(*managed_graphs.columns)


def touch_updated(
    snap: Snapshot, draftset: str, drafts: DataFrame, filled: DataFrame, now, vocab: Vocabulary
) -> Snapshot:
    """Times after an update batch: touched drafts are stamped, emptied private ones lose their time.

    ``filled(dg)`` are the draft graphs of the draftset that hold quads. If only the entry of the times graph itself would remain, the times graph goes too.
    """
    snap = touch(snap, draftset, drafts, now, vocab)
    private = snap.managed_graphs.filter(~F.col("is_public")).select("lg")
    emptied = (
        snap.draft_graphs.filter((F.col("draftset") == draftset) & (F.col("lg") != vocab.modified_graph))
        .join(filled.select("dg"), "dg", "left_anti")
        .join(private, "lg", "left_semi")
        .select(F.lit(draftset).alias("scope"), F.col("dg").alias("graph"))
    )
    times = snap.graph_modified.join(emptied, ["scope", "graph"], "left_anti").select(*snap.graph_modified.columns)
    own = S.draft_graph_iri(F.lit(draftset), F.lit(vocab.modified_graph), vocab)
    mine = F.col("scope") == draftset
    others_left = times.filter(mine & (F.col("graph") != own)).select("scope").distinct()
    times = times.filter(~mine).unionByName(
        times.filter(mine).join(others_left, "scope", "left_semi").select(*times.columns)
    )
    own_row = (F.col("draftset") == draftset) & (F.col("lg") == vocab.modified_graph)
    draft_graphs = snap.draft_graphs.filter(~own_row).unionByName(
        snap.draft_graphs.filter(own_row)
        .join(others_left.withColumnRenamed("scope", "draftset"), "draftset", "left_semi")
        .select(*snap.draft_graphs.columns)
    )
    return snap.but(graph_modified=times, draft_graphs=draft_graphs)


def modification_times(
    graph_modified: DataFrame, scope: str = LIVE_SCOPE, pairs: DataFrame | None = None
) -> DataFrame:
    """``(graph, modified)`` of a scope, graphs under published names when ``pairs(lg, dg)`` is given."""
    times = graph_modified.filter(F.col("scope") == scope).select("graph", "modified")
    if pairs is None:
        return times
    shown = times.join(pairs.select(F.col("dg").alias("graph"), "lg"), "graph", "left")
    return shown.select(F.coalesce("lg", "graph").alias("graph"), "modified")


def times_as_quads(times: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The times as quads of the times graph, to query next to the data."""
    return times.select(
        F.lit(vocab.modified_graph).alias("g"),
        F.col("graph").alias("s"),
        F.lit(IRI).alias("s_kind"),
        F.lit(DCT_MODIFIED).alias("p"),
        datetime_lexical(F.col("modified")).alias("o"),
        F.lit(LITERAL).alias("o_kind"),
        F.lit(XSD + "dateTime").alias("o_dt"),
        F.lit("").alias("o_lang"),
    )


def merge_times(live: DataFrame, draft: DataFrame, now) -> DataFrame:
    """Published times after a publish: ``(graph, modified, change)``.

    A draft time replaces an older published one; where the published time is already later, the
    time of this publish is used, so times never run backwards.
    """
    both = live.withColumnRenamed("modified", "_l").join(
        draft.withColumnRenamed("modified", "_d"), "graph", "full_outer"
    )
    return both.select(
        "graph",
        F.when(F.col("_l") > F.col("_d"), instant(now)).otherwise(F.coalesce("_d", "_l")).alias("modified"),
        F.when(F.col("_l").isNull(), "new").when(F.col("_d").isNull(), "unmodified").otherwise("modified").alias(
            "change"
        ),
    )


def publish_times(snap: Snapshot, draftset: str, now, vocab: Vocabulary) -> DataFrame:
    """The whole ``graph_modified`` table after publishing a draftset."""
    pairs = snap.draft_graphs.filter(F.col("draftset") == draftset).select("lg", "dg")
    times = snap.graph_modified
    merged = merge_times(
        modification_times(times, LIVE_SCOPE), modification_times(times, draftset, pairs), now
    ).select(F.lit(LIVE_SCOPE).alias("scope"), "graph", "modified")
    return times.filter(~F.col("scope").isin(LIVE_SCOPE, draftset)).unionByName(merged)


def ensure_endpoint(endpoints: DataFrame, now, vocab: Vocabulary) -> DataFrame:
    """The public endpoint row: created keeps its value, else takes modified, else now."""
    seed = endpoints.sparkSession.range(1).select(F.lit(PUBLIC).alias("id"))
    full = seed.join(endpoints.filter(F.col("id") == PUBLIC), "id", "left")
    created = F.coalesce("created", "modified", instant(now))
    fresh = S.version_iri(S.keyed_uuid(F.lit(PUBLIC), instant(now).cast("string")), vocab)
    row = full.select(
        "id",
        created.alias("created"),
        F.coalesce("modified", created).alias("modified"),
        F.coalesce("version", fresh).alias("version"),
    )
    return endpoints.filter(F.col("id") != PUBLIC).unionByName(row)


def stamp_endpoint(endpoints: DataFrame, now, vocab: Vocabulary) -> DataFrame:
    """After a publish: a new version always, a new modified time only where one was recorded."""
    hit = F.col("id") == PUBLIC
    version = S.version_iri(S.keyed_uuid(F.lit(PUBLIC), F.col("version"), instant(now).cast("string")), vocab)
    return endpoints.withColumns(
        {
            "modified": F.when(hit & F.col("modified").isNotNull(), instant(now)).otherwise(F.col("modified")),
            "version": F.when(hit, version).otherwise(F.col("version")),
        }
    )


def backfill_versions(draftsets: DataFrame, vocab: Vocabulary) -> DataFrame:
    fresh = S.version_iri(S.keyed_uuid(F.col("draftset")), vocab)
    return draftsets.withColumn("version", F.coalesce("version", fresh))


def latest_modified(snap: Snapshot, graphs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row for ``graphs(graph)``: latest published and draft times with the version they imply.

    ``graphs`` holds stored names, live or draft. A draft time counts only while its draftset has a
    times graph. Absent parts are NULL.
    """
    wanted = graphs.select("graph").distinct()
    times = snap.graph_modified
    public = snap.managed_graphs.filter("is_public").select(F.col("lg").alias("graph"))
    endpoint = snap.endpoints.filter((F.col("id") == PUBLIC) & F.col("version").isNotNull()).select("version")
    live = (
        times.filter(F.col("scope") == LIVE_SCOPE)
        .join(wanted, "graph", "left_semi")
        .join(public, "graph", "left_semi")
        .agg(F.max("modified").alias("livemod"))
        .select(F.lit(1).alias("k"), "livemod")
        .join(endpoint.select(F.lit(1).alias("k"), F.col("version").alias("livever")), "k", "left")
        .select(
            "k",
            F.when(F.col("livever").isNotNull(), F.col("livemod")).alias("livemod"),
            F.when(F.col("livemod").isNotNull(), F.col("livever")).alias("livever"),
        )
    )
    with_times = snap.draft_graphs.filter(F.col("lg") == vocab.modified_graph).select("draftset")
    drafted = (
        snap.draft_graphs.select(F.col("dg").alias("graph"), "draftset")
        .join(wanted, "graph", "left_semi")
        .join(with_times, "draftset", "left_semi")
        .join(snap.draftsets.select("draftset", "version"), "draftset")
    )
    draft = (
        times.join(drafted, (times["graph"] == drafted["graph"]) & (F.col("scope") == F.col("draftset")))
        .agg(F.max("modified").alias("draftmod"), F.max_by("version", F.struct("modified", "version")).alias("draftver"))
        .withColumn("k", F.lit(1))
    )
    return (
        live.join(draft, "k")
        .select(
            "livemod",
            "draftmod",
            S.merge_versions(F.col("draftver"), F.col("livever"), vocab).alias("version"),
        )
    )
