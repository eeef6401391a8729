"""A folder of Parquet tables with one façade for reading, changing and publishing drafts.

Quads lie in buckets of their graph name. A write reads and replaces only the buckets of the graphs
it changes; all other files stay where they are. Each change is one new commit: a small table that
names the folder of every bucket and table. Readers of an earlier commit keep reading it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.scalars import draft_graph_iri
from quadweave.operators import lookup, publish, state, times, update, workflow, writes
from quadweave.plans import views
from quadweave.schema import (
    COUNTS,
    QUAD_COLS,
    QUADS,
    TABLES,
    TRIPLE_COLS,
    Snapshot,
    Vocabulary,
    empty_snapshot,
    local_table,
    struct,
)
from quadweave.session import hadoop_path, shared_folder
from quadweave.sources.quads import assign_graph

QUAD_TABLES = ("live", "draft")
MANIFEST = struct("table STRING, bucket INT, path STRING")
NO_BUCKET = -1
COUNTED = "counts"
FIRST_BUCKETS, FEWEST_BUCKETS = 256, 16
LIVE = "live"


def utc_now() -> str:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(sep=" ")


#: Quads in a bucket that a table written whole aims at.
BUCKET_ROWS = 4_000_000
#: Quads lie sorted: version 2 pages keep of a text what differs from the one before.
QUAD_FILES = {"compression": "zstd", "parquet.writer.version": "v2"}


class StaleCommit(RuntimeError):
    """Another commit has changed what this one was made from; read again and repeat."""


class DraftsetNotFound(LookupError):
    pass


class DraftsetExists(ValueError):
    pass


class NotOwner(PermissionError):
    pass


class Workspace:
    """Drafts over published quads in one folder.

    A commit is one file, created only if it is not there, that names the manifest of all tables; so
    of two writers that aim at one number exactly one gets it. The other joins its change to the new
    commit if that left its tables and buckets alone, and fails otherwise: no write is lost.

    ``buckets`` is the number of buckets of a quads table that starts empty; a table that is written
    whole, as by :meth:`load` and :meth:`rebucket`, gets as many as its rows ask for.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        vocab: Vocabulary | None = None,
        clock=utc_now,
        buckets: int | None = None,
    ):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/workspace-{uuid.uuid4()}"
        self.vocab = vocab or Vocabulary()
        self.clock = clock
        self.buckets = buckets

    # Storage

    def _bucket_of(self, graph, buckets: int):
        return F.pmod(F.xxhash64(graph), F.lit(buckets)).cast("int")

    def commits(self) -> list[int]:
        """Numbers of the commits kept, from the names of their files."""
        folder, files = hadoop_path(self.spark, f"{self.root}/log")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit())

    def latest(self) -> int:
        """Number of the newest commit, 0 without one."""
        return max(self.commits(), default=0)

    def _manifest(self, commit: int | None = None) -> dict[str, dict[int, str]]:
        """Folder of each bucket of each table: at most two entries per bucket and one per small table.

        A quads table's entry at ``NO_BUCKET`` is its number of buckets.
        """
        commit = self.latest() if commit is None else commit
        if not commit:
            return {}
        folder = self.spark.read.text(f"{self.root}/log/{commit}").first().value
        found: dict[str, dict[int, str]] = {}
        for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{folder}").collect():
            found.setdefault(r.table, {})[r.bucket] = r.path
        return found

    def _bucket_count(self, manifest, table: str) -> int:
        return int(manifest.get(table, {}).get(NO_BUCKET) or self.buckets or FIRST_BUCKETS)

    def _buckets_for(self, graphs: DataFrame | None, buckets: int) -> set[int] | None:
        if graphs is None:
            return None
        rows = graphs.select(self._bucket_of(F.col(graphs.columns[0]), buckets).alias("b")).distinct()
        return {r.b for r in rows.collect()}  # at most ``buckets`` values

    def _read_quads(self, manifest, table: str, graphs: DataFrame | None) -> DataFrame:
        found = {b: p for b, p in manifest.get(table, {}).items() if b != NO_BUCKET}
        wanted = self._buckets_for(graphs, self._bucket_count(manifest, table))
        paths = [p for b, p in found.items() if wanted is None or b in wanted]
        if not paths:
            return local_table(self.spark, [], QUADS)
        return self.spark.read.schema(QUADS).parquet(*paths)

    def snapshot(self, live: DataFrame | None = None, draft: DataFrame | None = None, at: int | None = None) -> Snapshot:
        """Tables of a commit (the latest), the quads limited to the buckets of the given graphs."""
        commit = self.latest() if at is None else at
        manifest = self._manifest(commit)
        if not manifest:
            return empty_snapshot(self.spark).at(commit)
        tables = {}
        for name, schema in TABLES.items():
            if name not in QUAD_TABLES:
                tables[name] = self.spark.read.schema(schema).parquet(manifest[name][NO_BUCKET])
        counted = manifest.get(COUNTED, {}).get(NO_BUCKET)
        return Snapshot(
            live=self._read_quads(manifest, "live", live),
            draft=self._read_quads(manifest, "draft", draft),
            **tables,
            commit=commit,
            counts=self.spark.read.schema(COUNTS).parquet(counted) if counted else None,
        )

    def commit(
        self,
        before: Snapshot | None,
        after: Snapshot,
        live: DataFrame | None = None,
        draft: DataFrame | None = None,
    ) -> int:
        """Write what changed since ``before`` was read. ``live`` and ``draft`` name the graphs whose buckets were read.

        Raises :class:`StaleCommit` if a later commit changed one of the tables or buckets written here.
        """
        number = self.latest() if before is None or before.commit is None else before.commit
        manifest = self._manifest(number)
        base = f"{self.root}/data/{number + 1}-{uuid.uuid4()}"
        changed = [n for n in TABLES if before is None or not manifest or getattr(after, n) is not getattr(before, n)]

        def write(name: str) -> tuple[set[int] | None, dict[int, str]]:
            table, path = getattr(after, name), f"{base}/{name}"
            if name not in QUAD_TABLES:
                table.select(*TABLES[name].fieldNames()).write.parquet(path)
                return None, {NO_BUCKET: path}
            graphs = live if name == "live" else draft
            buckets = self._bucket_count(manifest, name) if graphs is not None or self.buckets else self._fitting(table)
            return self._buckets_for(graphs, buckets), self._write_quads(table, path, buckets) | {NO_BUCKET: str(buckets)}

        # The tables are independent jobs; the small ones fill the cores the large ones leave idle.
        with ThreadPoolExecutor(max_workers=4) as pool:
            written = dict(zip(changed, pool.map(write, changed)))
        while True:
            entries = {n: dict(b) for n, b in manifest.items()}
            for name, (touched, paths) in written.items():
                kept = {b: p for b, p in entries.get(name, {}).items() if touched is not None and b not in touched}
                entries[name] = {**kept, **paths}
            counted = self._count(entries, written, f"{base}/{COUNTED}-{uuid.uuid4()}")
            entries.update({COUNTED: {NO_BUCKET: counted}} if counted else {})
            rows = [(t, b, p) for t, buckets in entries.items() for b, p in buckets.items()]
            folder = f"{number + 1}-{uuid.uuid4()}"
            local_table(self.spark, rows, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/{folder}")
            if self._claim(number + 1, folder):
                return number + 1
            newest = self.latest()
            theirs = self._manifest(newest)
            for name, (touched, _) in written.items():
                was, now = manifest.get(name, {}), theirs.get(name, {})
                differ = {b for b in was.keys() | now.keys() if was.get(b) != now.get(b)}
                if differ and (touched is None or NO_BUCKET in differ or differ & touched):
                    raise StaleCommit(f"commit {newest} changed {name}, which was read at commit {number}")
            number, manifest = newest, theirs

    def _count(self, entries, written, path: str) -> str | None:
        """Statements per graph after a commit: those of the buckets it replaced are counted in the new files alone."""
        stores = [n for n in QUAD_TABLES if n in written]
        held = entries.get(COUNTED, {}).get(NO_BUCKET)
        if not stores or not held and any(written[n][0] is not None for n in stores):
            return held
        parts = [self.spark.read.schema(COUNTS).parquet(held)] if held else []
        for name in stores:
            touched, paths = written[name]
            again = F.col("store") == name
            if touched is not None:
                again = again & self._bucket_of(F.col("g"), int(paths[NO_BUCKET])).isin(list(touched))
            parts = [p.filter(~again) for p in parts]
            files = [p for b, p in paths.items() if b != NO_BUCKET]
            if files:
                sizes = self.spark.read.schema(QUADS).parquet(*files).groupBy("g").agg(F.count("*").alias("n"))
                parts.append(sizes.select(F.lit(name).alias("store"), "g", "n"))
        rows = parts[0] if parts else local_table(self.spark, [], COUNTS)
        for more in parts[1:]:
            rows = rows.unionByName(more)
        rows.select(*COUNTS.fieldNames()).write.parquet(path)
        return path

    def _claim(self, number: int, folder: str) -> bool:
        """Make the file of a commit if there is none: the one step that decides between writers."""
        path, files = hadoop_path(self.spark, f"{self.root}/log/{number}")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/.{folder}")
        out = files.create(draft, False)
        out.write(bytearray(folder.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        only_new = self.spark.sparkContext._gateway.new_array(options, 1)
        only_new[0] = options.NONE
        try:
            context.rename(draft, path, only_new)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error) or files.exists(path):
                return False
            raise
        return True

    def _fitting(self, quads: DataFrame) -> int:
        """Buckets, a power of two, for the rows of a table that is written whole."""
        rows = quads.count()
        return max(FEWEST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())

    def _write_quads(self, quads: DataFrame, path: str, buckets: int) -> dict[int, str]:
        """Bucket folders, sorted inside for row-group pruning.

        No quad is shuffled: every task sorts its own rows and writes one file for each bucket they fall in.
        """
        placed = quads.select(*QUAD_COLS, self._bucket_of(F.col("g"), buckets).alias("bucket"))
        placed.sortWithinPartitions("bucket", "g", "p", "s").write.partitionBy("bucket").options(**QUAD_FILES).parquet(path)
        folder, files = hadoop_path(self.spark, path)
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return {int(n.removeprefix("bucket=")): f"{path}/{n}" for n in names if n.startswith("bucket=")}

    def rebucket(self) -> None:
        """Write the quads anew in as many buckets as their rows ask for."""
        before = self.snapshot()
        same = before.but(**{n: getattr(before, n).select(*QUAD_COLS) for n in QUAD_TABLES})
        held, self.buckets = self.buckets, None
        try:
            self.commit(before, same)
        finally:
            self.buckets = held

    def expire(self, keep: int = 1) -> int:
        """Remove commits before the ``keep`` newest with all files that only they name.

        Readers of a removed commit fail. Data of commits in the making is newer than the newest
        commit, by its number, and is left alone. Returns the number of commits removed.
        """
        numbers = self.commits()
        old, kept = numbers[:-keep], numbers[-keep:]
        if not old:
            return 0
        named = {p for n in kept for b in self._manifest(n).values() for p in b.values()}
        manifests = {n: self.spark.read.text(f"{self.root}/log/{n}").first().value for n in old}
        dropped = {p for n in old for t in self._manifest(n).values() for b, p in t.items() if "/" in p} - named
        for n in old:  # the log first: what is no longer named by a commit is no longer read
            path, files = hadoop_path(self.spark, f"{self.root}/log/{n}")
            files.delete(path, False)
        for p in [*dropped, *[f"{self.root}/manifest/{m}" for m in manifests.values()]]:
            path, files = hadoop_path(self.spark, p)
            files.delete(path, True)
        return len(old)

    def load(self, snapshot: Snapshot) -> Workspace:
        """Replace everything by a snapshot."""
        self.commit(None, snapshot)
        return self

    # Draftsets

    def create_draftset(self, user: str, title: str | None = None, description: str | None = None, id: str | None = None):
        """Make a draftset owned by its creator; returns its id."""
        draftset = id or str(uuid.uuid4())
        before = self.snapshot(live=self._none(), draft=self._none())
        if state.draftset_exists(before.draftsets, draftset):
            raise DraftsetExists(draftset)
        sets = workflow.create_draftset(before.draftsets, draftset, user, self.clock(), self.vocab, title, description)
        self.commit(before, before.but(draftsets=sets))
        return draftset

    def draftsets(
        self, user: str, permissions: Sequence[str] = (), include: str = "all", union_with_live: bool = False
    ) -> DataFrame:
        return workflow.listing(self.snapshot(), user, permissions, include, union_with_live, self.vocab)

    def check(self, snap: Snapshot, draftset: str, user: str | None = None) -> None:
        """Refuse a draftset that is not there, or of which ``user``, if given, is not the owner."""
        found = snap.draftsets.filter(F.col("draftset") == draftset).select("owner").first()
        if found is None:
            raise DraftsetNotFound(draftset)
        if user is not None and found.owner != user:
            raise NotOwner(f"{user} does not own {draftset}")

    def set_metadata(self, draftset: str, title: str | None = None, description: str | None = None, user: str | None = None) -> None:
        before = self.snapshot()
        self.check(before, draftset, user)
        row = local_table(
            self.spark, [(draftset, title, description)], struct("draftset STRING, title STRING, description STRING")
        )
        self.commit(before, before.but(draftsets=workflow.set_metadata(before.draftsets, row)))

    def submit_to_user(self, draftset: str, owner: str, user: str) -> str:
        return self._act(draftset, owner, workflow.SUBMIT_USER, target=user)

    def submit_to_permission(self, draftset: str, owner: str, permission: str) -> str:
        return self._act(draftset, owner, workflow.SUBMIT_PERMISSION, permission=permission)

    def claim(self, draftset: str, user: str, permissions: Sequence[str] = ()) -> str:
        return self._act(draftset, user, workflow.CLAIM, permissions)

    def share_with_user(self, draftset: str, owner: str, user: str) -> str:
        return self._act(draftset, owner, workflow.SHARE_USER, target=user)

    def share_with_permission(self, draftset: str, owner: str, permission: str) -> str:
        return self._act(draftset, owner, workflow.SHARE_PERMISSION, permission=permission)

    def unshare(self, draftset: str, owner: str) -> str:
        return self._act(draftset, owner, workflow.UNSHARE)

    def _act(self, draftset: str, actor: str, action: str, permissions: Sequence[str] = (), target=None, permission=None):
        before = self.snapshot()
        outcome, after = workflow.act(before, draftset, actor, action, permissions, target, permission)
        if outcome == "ok":
            self.commit(before, after)
        return outcome

    # Data. Each write reads only the buckets of the graphs it may change, all of them at one commit. It
    # refuses an unknown draftset and, where a user is given, one that the user does not own.

    def _drafts_of(self, draftset: str, more: DataFrame | None = None, at: int | None = None) -> DataFrame:
        """Draft graph names a write to the draftset may change, ``more(lg)`` included."""
        names = self.snapshot(live=self._none(), draft=self._none(), at=at).draft_graphs
        names = names.filter(F.col("draftset") == draftset).select("lg")
        if more is not None:
            names = names.unionByName(more.select("lg"))
        dg = draft_graph_iri(F.lit(draftset), F.col("lg"), self.vocab)
        return lookup.local(names.distinct().select(dg.alias("dg")))

    def _none(self) -> DataFrame:
        return local_table(self.spark, [], struct("lg STRING"))

    def _one(self, graph: str) -> DataFrame:
        return local_table(self.spark, [(graph,)], struct("lg STRING"))

    def _write(self, draftset: str, graphs: DataFrame, change, user: str | None) -> None:
        at = self.latest()
        self.check(self.snapshot(live=self._none(), draft=self._none(), at=at), draftset, user)
        graphs = lookup.local(graphs)
        drafts = self._drafts_of(draftset, graphs, at)
        before = self.snapshot(live=graphs, draft=drafts, at=at)
        after = change(before)
        if after is not before:
            self.commit(before, after, live=graphs, draft=drafts)

    def append(self, draftset: str, quads: DataFrame, graph: str | None = None, user: str | None = None) -> None:
        quads = lookup.once(_quads_of(quads, graph))
        named = quads.select(F.col("g").alias("lg")).distinct()
        self._write(draftset, named, lambda s: writes.append(s, draftset, quads, self.clock(), self.vocab), user)

    def delete(self, draftset: str, quads: DataFrame, graph: str | None = None, user: str | None = None) -> None:
        quads = lookup.once(_quads_of(quads, graph))
        named = quads.select(F.col("g").alias("lg")).distinct()
        self._write(draftset, named, lambda s: writes.delete(s, draftset, quads, self.clock(), self.vocab), user)

    def delete_graph(self, draftset: str, graph: str, silent: bool = False, user: str | None = None) -> None:
        def change(s):
            return writes.delete_graph(s, draftset, graph, self.clock(), self.vocab, silent)

        self._write(draftset, self._one(graph), change, user)

    def copy_live_graph(self, draftset: str, graph: str, user: str | None = None) -> None:
        def change(s):
            return writes.copy_live_graph(s, draftset, graph, self.clock(), self.vocab)

        self._write(draftset, self._one(graph), change, user)

    def revert_graph(self, draftset: str, graph: str, user: str | None = None) -> str:
        outcome = []

        def change(s):
            word, after = writes.revert_graph(s, draftset, graph, self.clock(), self.vocab)
            outcome.append(word)
            return after

        self._write(draftset, self._one(graph), change, user)
        return outcome[0]

    def update(self, draftset: str, ops: DataFrame, max_size: int | None = None, user: str | None = None) -> None:
        ops = lookup.once(ops.select(*update.UPDATE_OPS.fieldNames()))
        named = ops.select(F.col("g").alias("lg")).distinct()

        def change(s):
            return update.update(s, draftset, ops, self.clock(), self.vocab, max_size)

        self._write(draftset, named, change, user)

    def delete_draftset(self, draftset: str, user: str | None = None) -> None:
        at = self.latest()
        drafts = self._drafts_of(draftset, at=at)
        before = self.snapshot(live=self._none(), draft=drafts, at=at)
        self.check(before, draftset, user)
        self.commit(before, writes.delete_draftset(before, draftset), draft=drafts)

    def publish(self, draftset: str, now: str | None = None, user: str | None = None) -> None:
        """Make the draftset live; visible to readers all at once with the new commit."""
        at = self.latest()
        tables = self.snapshot(live=self._none(), draft=self._none(), at=at)
        self.check(tables, draftset, user)
        graphs = lookup.local(writes.user_pairs(tables, draftset, self.vocab).select("lg"))
        drafts = self._drafts_of(draftset, at=at)
        before = self.snapshot(live=graphs, draft=drafts, at=at)
        endpoints = times.ensure_endpoint(before.endpoints, now or self.clock(), self.vocab)
        after = publish.publish(before.but(endpoints=endpoints), draftset, now or self.clock(), self.vocab)
        self.commit(before, after, live=graphs, draft=drafts)

    # Reading

    def view(self, context: str = LIVE, union_with_live: bool = False, name: str | None = None) -> DataFrame:
        """Quads of the live view or of a draftset; registered as a temporary view under ``name``."""
        if context == LIVE:
            snap = self.snapshot(draft=self._none())
            quads = views.live_view(snap.live, snap.managed_graphs)
        else:
            snap = self.snapshot(live=None if union_with_live else self._none(), draft=self._drafts_of(context))
            quads = views.draft_view(snap, context, union_with_live)
        if name:
            quads.createOrReplaceTempView(name)
        return quads

    def quads(self, context: str = LIVE, graph: str | None = None, union_with_live: bool = False) -> DataFrame:
        """All quads of a context, or the triples of one graph."""
        quads = self.view(context, union_with_live)
        return quads if graph is None else quads.filter(F.col("g") == graph).select(*TRIPLE_COLS).distinct()

    def endpoints(self) -> DataFrame:
        """The public endpoint and every draftset as endpoints."""
        snap = self.snapshot(live=self._none(), draft=self._none())
        columns = ["id", "created", "modified", "version"]
        return snap.endpoints.select(*columns).unionByName(
            snap.draftsets.withColumnRenamed("draftset", "id").select(*columns)
        )

    def modification_times(self, scope: str = LIVE) -> DataFrame:
        snap = self.snapshot(live=self._none(), draft=self._none())
        pairs = None if scope == LIVE else writes.pairs_of(snap, scope)
        return times.modification_times(snap.graph_modified, scope, pairs)


def _quads_of(quads: DataFrame, graph: str | None) -> DataFrame:
    if graph:
        return assign_graph(quads, graph)
    return quads if quads.columns == QUAD_COLS else quads.select(*QUAD_COLS)


def stored(snapshot: Snapshot, root: str | None = None) -> Snapshot:
    """The snapshot written to Parquet and read back."""
    return Workspace(snapshot.spark, root, buckets=16).load(snapshot).snapshot()
