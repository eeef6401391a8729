"""Modified times, versions and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import scalars as S
from quadweave.functions.scalars import version_iri
from quadweave.operators import fingerprint, state, times, update, writes
from quadweave.plans import fixtures as fx
from quadweave.plans.catalog import register
from quadweave.plans.catalog.lifecycle import update_rows
from quadweave.plans.fixtures import DS1, GRAPH, NOW, VOCAB, sql

_NOW_US = f"epoch_us(TIMESTAMP '{NOW}')"
_VERSION = "http://example.org/quadweave/version/"


def _times(snap):
    return snap.graph_modified.select("scope", "graph", F.unix_micros("modified").alias("modified"))


def _dg(n) -> str:
    return f"'{VOCAB.draft_graph_base}'||md5('ds-1|{GRAPH}{n}')"


_DMG = f"'{VOCAB.draft_graph_base}'||md5('ds-1|{VOCAB.modified_graph}')"


@register(
    "m1_touch_graph",
    sql(
        f"""SELECT scope, graph, epoch_us(modified) AS modified FROM times WHERE NOT (scope = 'ds-1' AND graph IN ({_dg(2)}, {_DMG}))
        UNION ALL SELECT 'ds-1', g, {_NOW_US} FROM (SELECT unnest([{_dg(2)}, {_DMG}]) AS g)"""
    ),
)
def touch_graph(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    one = writes.pairs_of(snap, DS1).filter(F.col("lg") == GRAPH + "2")
    return _times(times.touch(snap, DS1, one, NOW, VOCAB))


@register(
    "m2_forget_graph",
    sql(f"SELECT scope, graph, epoch_us(modified) AS modified FROM times WHERE NOT (scope = 'ds-1' AND graph = {_dg(16)})"),
)
def forget_graph(spark, sf_dir):
    """Times after a revert: user graphs are left, so the times graph stays."""
    _, after = writes.revert_graph(fx.snapshot(spark, sf_dir), DS1, GRAPH + "16", NOW, VOCAB)
    return _times(after)


@register(
    "m2_forget_last_graph",
    sql("SELECT scope, graph, epoch_us(modified) AS modified FROM times WHERE scope <> 'ds-2'"),
)
def forget_last_graph(spark, sf_dir):
    """With no user graph left, the draftset's times graph goes as well."""
    snap = fx.snapshot(spark, sf_dir)
    for n in fx.DS2_CHANGED:
        _, snap = writes.revert_graph(snap, fx.DS2, GRAPH + str(n), NOW, VOCAB)
    return _times(snap)


@register(
    "m3_touch_updated",
    sql(
        f"""SELECT scope, graph, epoch_us(modified) AS modified FROM times WHERE NOT (scope = 'ds-1' AND graph IN ({_dg(0)}, {_dg(17)}, {_DMG}))
        UNION ALL SELECT 'ds-1', g, {_NOW_US} FROM (SELECT unnest([{_dg(0)}, {_dg(8)}, {_dg(18)}, {_dg(9)}, {_dg(17)}, {_DMG}]) AS g)"""
    ),
)
def touch_updated(spark, sf_dir):
    """Times after a batch that changed drafted, live and new graphs."""


    snap = fx.snapshot(spark, sf_dir)
    return _times(update.update(snap, DS1, update_rows(spark, sf_dir), NOW, VOCAB, 1 << 60))


@register(
    "m4_modification_times",
    sql(
        """SELECT coalesce(d.lg, t.graph) AS graph, epoch_us(t.modified) AS modified FROM times t
        LEFT JOIN dgs d ON d.dg = t.graph WHERE t.scope = 'ds-1'"""
    ),
)
def modification_times(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    shown = times.modification_times(snap.graph_modified, DS1, writes.pairs_of(snap, DS1))
    return shown.select("graph", F.unix_micros("modified").alias("modified"))


@register(
    "m4_times_as_quads",
    sql("SELECT graph AS s, strftime(modified, '%Y-%m-%dT%H:%M:%S.')||lpad(CAST((epoch_us(modified) // 1000) % 1000 AS VARCHAR), 3, '0')||'Z' AS o FROM times WHERE scope = 'live'"),
)
def times_as_quads(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    return times.times_as_quads(times.modification_times(snap.graph_modified), VOCAB).select("s", "o")


@register(
    "m5_publish_times",
    sql(
        f"""SELECT 'live' AS scope, coalesce(l.graph, d.lg) AS graph,
          CASE WHEN l.modified > d.modified THEN {_NOW_US} ELSE epoch_us(coalesce(d.modified, l.modified)) END AS modified
        FROM (SELECT * FROM times WHERE scope = 'live') l
        FULL JOIN (SELECT x.lg, t.modified FROM times t JOIN dgs x ON x.dg = t.graph WHERE t.scope = 'ds-1') d ON d.lg = l.graph
        UNION ALL SELECT scope, graph, epoch_us(modified) FROM times WHERE scope = 'ds-2'"""
    ),
)
def publish_times(spark, sf_dir):
    merged = times.publish_times(fx.snapshot(spark, sf_dir), DS1, NOW, VOCAB)
    return merged.select("scope", "graph", F.unix_micros("modified").alias("modified"))


@register(
    "m6_stamp_endpoint",
    f"""SELECT id, CASE WHEN id = 'public' AND modified IS NOT NULL THEN {_NOW_US} ELSE epoch_us(modified) END AS modified, id = 'public' AS new_version
    FROM (SELECT user_id AS u, CASE WHEN user_id = (SELECT min(user_id) FROM events) THEN 'public' ELSE 'user-'||user_id END AS id,
      CASE WHEN user_id % 7 <> 6 OR user_id = (SELECT min(user_id) FROM events) THEN max(ts) END AS modified FROM events GROUP BY user_id)""",
)
def stamp_endpoint(spark, sf_dir):
    """An endpoint per user of the events, the first of them public; some have no recorded time."""
    events = fx.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first = events.agg(F.min("user_id")).first()[0]
    user = F.col("user_id")
    recorded = (user % 7 != 6) | (user == first)
    endpoints = events.groupBy("user_id").agg(F.max("ts").alias("last")).select(
        F.when(user == first, "public").otherwise(F.concat(F.lit("user-"), user.cast("string"))).alias("id"),
        F.col("last").alias("created"),
        F.when(recorded, F.col("last")).alias("modified"),
        version_iri(F.md5(user.cast("string")), VOCAB).alias("version"),
    )
    stamped = times.stamp_endpoint(endpoints, NOW, VOCAB)
    before = endpoints.select("id", F.col("version").alias("_old"))
    return stamped.join(before, "id").select(
        "id", F.unix_micros("modified").alias("modified"), (F.col("version") != F.col("_old")).alias("new_version")
    )


@register(
    "m7_ensure_endpoint",
    f"""SELECT 'public' AS id, (SELECT max(epoch_us(ts)) FROM events) AS created, (SELECT max(epoch_us(ts)) FROM events) AS modified, true AS versioned""",
)
def ensure_endpoint(spark, sf_dir):
    """An older endpoint with a modified time only, here the time of the newest event."""
    old = fx.read(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("modified")).select(
        F.lit("public").alias("id"), F.lit(None).cast("timestamp").alias("created"), "modified", F.lit(None).cast("string").alias("version")
    )
    rows = times.ensure_endpoint(old, NOW, VOCAB)
    return rows.select(
        "id",
        F.unix_micros("created").alias("created"),
        F.unix_micros("modified").alias("modified"),
        S.version_id(F.col("version"), VOCAB).isNotNull().alias("versioned"),
    )


@register(
    "m8_view_fingerprint",
    sql(
        f""", l AS (SELECT max(modified) AS t FROM times WHERE scope = 'live' AND graph IN ('{GRAPH}5', '{GRAPH}6')),
        d AS (SELECT max(modified) AS t FROM times WHERE scope = 'ds-1' AND graph IN ({_dg(1)}, {_dg(2)}))
        SELECT md5('{{"default_graphs":["{GRAPH}5"],"named_graphs":["{GRAPH}5","{GRAPH}6"],"query":"all","query_type":"tuple"}}') AS hash,
          coalesce(CAST(epoch_us(l.t) // 1000 AS VARCHAR), 'empty')||coalesce('-'||(epoch_us(d.t) // 1000), '')||'_'||
          CASE WHEN d.t IS NOT NULL THEN md5(least(md5('ds-1'), md5('public'))||greatest(md5('ds-1'), md5('public'))) ELSE md5('public') END AS times FROM l, d"""
    ),
)
def view_fingerprint(spark, sf_dir):
    snap = fx.snapshot(spark, sf_dir)
    drafts = writes.pairs_of(snap, DS1).filter(F.col("lg").isin(GRAPH + "1", GRAPH + "2")).select(F.col("dg").alias("graph"))
    public = state.live_graphs(snap.managed_graphs).filter(F.col("lg").isin(GRAPH + "5", GRAPH + "6"))
    latest = times.latest_modified(snap, drafts.union(public), VOCAB)
    named = [GRAPH + "6", GRAPH + "5", GRAPH + "6"]
    return fingerprint.view_fingerprint(latest, "all", "tuple", [GRAPH + "5"], named, VOCAB)
