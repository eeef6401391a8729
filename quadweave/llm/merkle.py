"""A Merkle manifest: every document a leaf, a tree per group, and over the groups' roots one more tree.

At each level a node looks for the other nodes of its run by their computed numbers: with a fan-out
of two its sibling's number is its own XOR one, otherwise a row for each slot offset asks for the
node whose slot is that much further round the run. One equi-join answers all of them, a node's
siblings are put in order left and right of it, and the rows of slot zero emit the parents. Numbers
are unique, so no key is hot however large a group is. A level is written with its siblings; on the way
down a node's path is its own siblings before its parent's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import fill_rank, lower_ascii
from quadweave.session import stage

#: Leaves that one task numbers, about.
RANK_ROWS = 250_000
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 in lower-case hex of strings end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with their number ``idx`` in the tree, from 0 in the ``order`` given, and its leaves ``n``.

    Rows are dealt by ranges of (tree, order) and of a row number, so that not even equal rows must meet in a task.
    """
    keyed = stage(leaves.withColumn("_row", F.monotonically_increasing_id()))
    by = ["tree", *order, "_row"]
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // RANK_ROWS))
    ranged = stage(keyed.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    ranked = fill_rank(ranged, "tree", F.col("_range"), [F.col(c) for c in by[1:]], "idx")
    sizes = ranged.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("n"))
    return ranked.join(sizes, F.col("tree") == F.col("_tree")).drop("_tree", "_range", "_row")


def _siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: the digests of the run's other nodes before and after each."""
    slot = F.col("idx") % fan_out
    if fan_out == 2:
        asked = nodes.select("tree", "idx", F.col("idx").bitwiseXOR(F.lit(1).cast("long")).alias("_wanted"), "n")
    else:
        offset = F.explode(F.sequence(F.lit(1), F.lit(fan_out - 1)))
        turned = nodes.select("tree", "idx", "n", offset.alias("_offset"))
        asked = turned.withColumn("_wanted", F.col("idx") - slot + (slot + F.col("_offset")) % fan_out)
    asked = asked.filter(F.col("_wanted") < F.col("n")).select("tree", "idx", "_wanted")
    others = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.unhex("digest").alias("_digest"))
    met = asked.join(others, (F.col("tree") == F.col("_tree")) & (F.col("_wanted") == F.col("_idx")))
    found = met.groupBy(F.col("tree").alias("_tree"), F.col("idx").alias("_idx")).agg(F.array_sort(F.collect_list(F.struct("_wanted", "_digest"))).alias("_others"))
    joined = nodes.join(found, (F.col("tree") == F.col("_tree")) & (F.col("idx") == F.col("_idx")), "left")
    text = lambda x: F.lower(F.hex(x["_digest"]))
    side = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("_others", keep), text), ""), F.lit(""))
    before, after = side(lambda x: x["_wanted"] < F.col("idx")), side(lambda x: x["_wanted"] > F.col("idx"))
    return joined.select(*nodes.columns, before.alias("left"), after.alias("right"))


class Forest:
    """The trees over ``leaves``, written rows with tree, idx, n and digest, level by level; a tree ends at its only node.

    All columns of the leaves stay with them in their level.
    """

    def __init__(self, leaves: DataFrame, fan_out: int) -> None:
        self.fan_out, self.levels = fan_out, []
        self.more = [c for c in leaves.columns if c not in ("tree", "idx", "n")]
        nodes = leaves
        longest = nodes.agg(F.max("n")).first()[0] or 0
        while longest > 1:
            level = stage(_siblings(nodes.filter("n > 1"), fan_out))
            self.levels.append((level, nodes.filter("n = 1")))
            parents = level.filter(F.col("idx") % fan_out == 0).select(
                "tree", self._above("idx").alias("idx"), F.ceil(F.col("n") / fan_out).alias("n"), digest("left", "digest", "right").alias("digest")
            )
            nodes, longest = stage(parents), -(-longest // fan_out)
        self.levels.append((None, nodes))

    def _above(self, idx: str) -> Column:
        return F.floor(F.col(idx) / self.fan_out)

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        alone = [single.select("tree", "digest") for _, single in self.levels]
        out = alone[0]
        for one in alone[1:]:
            out = out.unionByName(one)
        return out

    def paths(self, tops: DataFrame | None = None) -> DataFrame:
        """Every leaf with path, root and subroot: the siblings (left, right) of each level up to the root.

        ``subroot`` is the root of the leaf's own tree; ``tops`` (tree, path, root) go on from there.
        Only parents' paths are shuffled, one for ``fan_out`` nodes.
        """
        if tops is None:
            tops = self.roots().select("tree", F.array().cast(_STEP).alias("path"), F.col("digest").alias("root"))
        tops = tops.select(F.col("tree").alias("_tree"), "path", "root")
        below = None
        for depth, (level, single) in reversed(list(enumerate(self.levels))):
            names = ["tree", "idx", *(self.more if depth == 0 else []), "path", "root", "subroot"]
            found = single.join(tops, F.col("tree") == F.col("_tree")).withColumn("subroot", F.col("digest")).select(*names)
            if level is not None:
                parents = below.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), "root", "subroot")
                met = level.join(parents, (F.col("tree") == F.col("_tree")) & (self._above("idx") == F.col("_idx")))
                own = F.array(F.struct("left", "right")).cast(_STEP)
                found = found.unionByName(met.withColumn("path", F.concat(own, F.col("_path"))).select(*names))
            below = found
        return below


def proof(path: Column) -> Column:
    """SHA-256 of all digests of a path end to end."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(
    docs: DataFrame,
    touched: Column | None = None,
    group: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    fan_out: int = 8,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, group, leaf, subroot, root, path, folded_root and verified for every row of ``docs``.

    A leaf is the digest of the ``fields`` of a row, each ``-`` if null, else its byte count, a colon and
    its value. In each group leaves stand by identifier, a null one first, equal identifiers by
    digest; while there are several nodes every ``fan_out`` consecutive ones become the digest of
    theirs, the last run also if it is one node. The groups' roots in the order of the group's bytes,
    null first, are the leaves of one more tree, whose root is that of the manifest. ``path`` has the
    siblings (left, right) of every level, and ``folded_root`` is what the leaf gives with them; where
    ``touched`` holds (not for null) it is the leaf of the row with A-Z of its text lower-cased, as if
    someone had changed it. ``verified`` says whether that is the root. Repeated rows have leaves of
    their own, an empty table gives no rows, other columns are not read.
    """
    changed = [field(lower_ascii(F.col(c))) if c == text else field(F.col(c)) for c in fields]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(group).alias("group"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        digest(*[field(F.col(c)) for c in fields]).alias("digest"),
        F.when(F.lit(False) if touched is None else touched, digest(*changed)).alias("changed"),
    )
    leaves = stage(_numbered(rows, ["doc_id", "digest"]))
    trees = Forest(leaves, fan_out)
    named = leaves.filter("idx = 0").select(F.col("tree").alias("_tree"), "group")
    roots = trees.roots().join(named, F.col("tree") == F.col("_tree"))
    tops = stage(_numbered(roots.select(F.lit("").alias("tree"), "group", "digest", F.col("tree").alias("member")), ["group"]))
    tops = stage(Forest(tops, fan_out).paths().select(F.col("member").alias("tree"), "path", "root"))
    folded = trees.paths(tops).withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return folded.select("doc_id", "group", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root", verified)
