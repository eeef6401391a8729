"""Connected components of a table of links: joined within tasks, merged by node, contracted round by round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.arrow import Batches, mapped
from quadweave.session import stage

#: Links that a task joins at once.
HELD = 1 << 21


def drawn(nodes: np.ndarray, turn: int) -> np.ndarray:
    """Each node's place in the draw of a round: the node itself, mixed."""
    x = nodes.astype(np.int64).view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels): for every node of these links the node of its component that is drawn first."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(drawn(nodes, turn), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    x, y = place[code[: len(a)]], place[code[len(a) :]]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return nodes, nodes[order[label[place]]]
        x, y, low = x[apart], y[apart], np.minimum(u, v)[apart]
        np.minimum.at(label, u[apart], low)
        np.minimum.at(label, v[apart], low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def _columns(batches: Batches, names: list[str], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of about ``most`` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        rows += batch.num_rows
        if rows >= most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _within(turn: int) -> Callable[[Batches], Batches]:
    """(node, label) rows of what the links of a task join."""

    def run(batches: Batches) -> Batches:
        for a, b in _columns(batches, ["a", "b"], HELD):
            nodes, labels = joined(a, b, turn)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])

    return run


def _merged(turn: int) -> Callable[[Batches], Batches]:
    """Of (node, label) rows sorted by node: each node with its first label, and that label with the others (``more``)."""

    def answer(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((drawn(label, turn), node))
        node, label = node[order], label[order]
        fresh = np.append(True, node[1:] != node[:-1])
        first = label[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        other = ~fresh & (label != first)
        pairs = np.unique(np.stack([first[other], label[other]], axis=1), axis=0)
        columns = [np.append(node[fresh], pairs[:, 0]), np.append(label[fresh], pairs[:, 1])]
        more = np.arange(len(columns[0])) >= int(fresh.sum())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more)], ["a", "b", "more"])

    def run(batches: Batches) -> Batches:
        rest = [np.empty(0, np.int64)] * 2
        for node, label in _columns(batches, ["node", "label"], HELD):
            node, label = np.append(rest[0], node), np.append(rest[1], label)
            cut = int(np.searchsorted(node, node[-1]))
            if cut:
                yield answer(node[:cut], label[:cut])
            rest = [node[cut:], label[cut:]]
        if len(rest[0]):
            yield answer(*rest)

    return run


def groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is one node of its component.

    Links are long integers; self-links, repeated links and both directions are fine, null ends are
    left out. In a round every task joins its own links, at most ``HELD`` at once, and sends each of its
    nodes with the label it got there. A node meets its labels, one per such lot and so never many
    however many links it has: its first label becomes its own, and links of that label to the others
    are the next round's. Labels are the nodes drawn first, by a draw of each round, so that chains of
    any order shrink by a part each round; rounds end when no link is left. A round is one shuffle and
    one table in the shared folder, and the rounds' labels are composed by plain joins.
    """
    left, maps = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b"), []
    while True:
        near = mapped(left, _within(len(maps)), "node long, label long").repartition("node").sortWithinPartitions("node")
        made = stage(mapped(near, _merged(len(maps)), "a long, b long, more boolean"))
        maps.append(made.filter("not more").select(F.col("a").alias("node"), F.col("b").alias("root")))
        left = made.filter("more").select("a", "b")
        if left.isEmpty():
            break
    found = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        found = found.join(later, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    return found


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link: ``root`` is the least node of its component."""
    found = stage(groups(links, a, b))
    least = stage(found.groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("_least")))
    return found.join(least, F.col("root") == F.col("_root")).select("node", F.col("_least").alias("root"))
