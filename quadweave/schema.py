"""Fixed schemas, the vocabulary of IRIs, and the bundle of tables every write works on."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import col, count
from pyspark.sql.pandas.types import to_arrow_schema

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
OWL_THING = "http://www.w3.org/2002/07/owl#Thing"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
DCT_MODIFIED = "http://purl.org/dc/terms/modified"

IRI, BNODE, LITERAL = "iri", "bnode", "literal"

# Absent datatype and language are '' and never NULL, so plain equality, distinct and
# anti-joins compare whole terms without null-safe operators.
SUBJECT_COLS = ["s", "s_kind"]
OBJECT_COLS = ["o", "o_kind", "o_dt", "o_lang"]
TRIPLE_COLS = [*SUBJECT_COLS, "p", *OBJECT_COLS]
QUAD_COLS = ["g", *TRIPLE_COLS]

# Positions whose IRIs may name a graph: (value column, kind column or None when always an IRI).
GRAPH_REF_POSITIONS = [("s", "s_kind"), ("p", None), ("o", "o_kind")]


_TYPES = {"STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "INT": T.IntegerType(), "BIGINT": T.LongType()}


def struct(columns: str) -> T.StructType:
    """A schema from ``"name TYPE, ..."``, usable before a session exists."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


QUADS = struct(", ".join(f"{c} STRING" for c in QUAD_COLS))
TABLES: dict[str, T.StructType] = {
    "live": QUADS,
    "draft": QUADS,
    "managed_graphs": struct("lg STRING, is_public BOOLEAN, issued TIMESTAMP"),
    "draft_graphs": struct("dg STRING, lg STRING, draftset STRING, created TIMESTAMP"),
    "draftsets": struct(
        "draftset STRING, created TIMESTAMP, modified TIMESTAMP, version STRING, creator STRING, "
        "owner STRING, title STRING, description STRING, submitted_by STRING"
    ),
    "submissions": struct(
        "draftset STRING, submission STRING, claim_user STRING, claim_permission STRING"
    ),
    "shares": struct("draftset STRING, view_user STRING, view_permission STRING"),
    "graph_modified": struct("scope STRING, graph STRING, modified TIMESTAMP"),
    "endpoints": struct("id STRING, created TIMESTAMP, modified TIMESTAMP, version STRING"),
}
LIVE_SCOPE = "live"
#: Statements per graph of the quads tables ``live`` and ``draft``.
COUNTS = struct("store STRING, g STRING, n BIGINT")


@dataclass(frozen=True)
class Vocabulary:
    """IRIs the bookkeeping hangs on. Give ``base`` the namespace your stored data already uses."""

    base: str = "http://example.org/quadweave/"
    permission_namespace: str = "quadweave:"
    extra_protected: tuple[str, ...] = ()
    protected_patterns: tuple[str, ...] = ()

    @property
    def permission_prefix(self) -> str:
        return self.permission_namespace + "draft:"

    @property
    def graphs_base(self) -> str:
        return self.base + "graphs/"

    @property
    def draft_graph_base(self) -> str:
        return self.graphs_base + "draft/"

    @property
    def modified_graph(self) -> str:
        return self.graphs_base + "graph-modified-times"

    @property
    def version_base(self) -> str:
        return self.base + "version/"

    @property
    def draftset_base(self) -> str:
        return self.base + "draftset/"

    @property
    def submission_base(self) -> str:
        return self.base + "submission/"

    @property
    def protected_regex(self) -> str:
        """One anchored pattern: everything under the bookkeeping graphs plus configured extras."""
        patterns = [re.escape(self.graphs_base) + ".*", *self.protected_patterns]
        patterns += [re.escape(exact) for exact in self.extra_protected]
        return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


@dataclass(frozen=True)
class Snapshot:
    """One immutable version of all tables. Operators return a new snapshot; nothing mutates."""

    live: DataFrame
    draft: DataFrame
    managed_graphs: DataFrame
    draft_graphs: DataFrame
    draftsets: DataFrame
    submissions: DataFrame
    shares: DataFrame
    graph_modified: DataFrame
    endpoints: DataFrame
    #: Number of the commit that the tables were read from, if they were read from a workspace.
    commit: int | None = None
    #: Kept counts of statements; None once quads have changed and until they are committed.
    counts: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Snapshot:
        if "live" in tables or "draft" in tables:
            tables = {"counts": None, **tables}
        return replace(self, **tables)

    def sizes(self, store: str) -> DataFrame:
        """``(g, n)``: statements of each graph of ``live`` or ``draft`` that has any, from the kept counts if there are any."""
        if self.counts is None:
            return getattr(self, store).groupBy("g").agg(count("*").alias("n"))
        return self.counts.filter((col("store") == store) & (col("n") > 0)).select("g", "n")

    def names(self, store: str) -> DataFrame:
        """``(g)`` of the graphs that hold quads; without kept counts, the column itself."""
        return getattr(self, store).select("g") if self.counts is None else self.sizes(store).select("g")

    def at(self, commit: int) -> Snapshot:
        return replace(self, commit=commit)

    @property
    def spark(self) -> SparkSession:
        return self.live.sparkSession


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """Rows held by the driver as a local relation: its size is known to Catalyst, unlike an RDD's."""
    rows = list(rows)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return local_table(spark, [], TABLES[name])


def empty_snapshot(spark: SparkSession) -> Snapshot:
    return Snapshot(**{name: empty_table(spark, name) for name in TABLES})
