"""Near-duplicates: SimHash fingerprints, links by pigeonhole blocks or minima, and classes of linked texts.

A fingerprint of 64 bits is cut into blocks. Two fingerprints that differ in at most d bits agree in all
but d blocks, so with b blocks they share one of the C(b, b - d) choices of b - d whole blocks: each
choice is one key to join on, and fingerprints that share a key are compared. Distinct fingerprints
alone are joined, however many rows have them. Within a key only the links of a spanning forest are
kept, never all pairs, and a key with many fingerprints is cut into chunks whose pairs are tasks of
their own, so that every two of its fingerprints are still compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.arrow import mapped, send_package, sliced
from quadweave.llm.common import pick_rows, whole
from quadweave.llm.graph import groups
from quadweave.session import stage

#: Fingerprints in a chunk of a key with many; a task compares two chunks.
CHUNK = 2048
#: Texts and shingles in a chunk of a group of candidates too large for one task, and texts of a group that go to all its chunks.
SHARE, SHINGLES, HUBS = 512, 1 << 22, 8
#: Shingles hashed at once.
STEP = 1 << 16


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by one space; of all words if there are fewer."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    count = max(1, len(words) - width + 1)
    starts, stops = (ends - lengths)[:count].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((digest(text[i:j], seed) for i, j in zip(starts, stops)), np.uint64, count)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = np.ascontiguousarray(hashes[at : at + STEP])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The hashes as if of another seed; turn 0 leaves them."""
    if not turn:
        return hashes
    x = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, kinds: Sequence[tuple[int, int, bool, int]], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with fingerprints (long) f0, f1, ... of each kind in turn.

    A kind is (words in a shingle, seed, distinct shingles only?, number of fingerprints). A-Z are
    lower-cased, words are what stands between spaces and the control characters from tab to carriage
    return. A text without words, null included, has fingerprint 0.
    """
    total = sum(k[3] for k in kinds)
    slim = docs.select(*[F.col(c) for c in keep], whole(text).cast("binary").alias("_text"))
    fields = ", ".join([f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep] + [f"f{i} long" for i in range(total)])
    names = [*keep, *[f"f{i}" for i in range(total)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            found = np.zeros((total, batch.num_rows), np.uint64)
            for row, text in enumerate(batch["_text"].to_pylist()):
                words, at = text.lower().split(), 0
                for width, seed, distinct, count in kinds:
                    hashes = shingle_hashes(words, width, seed)
                    hashes = np.unique(hashes) if distinct else hashes
                    for turn in range(count):
                        found[at, row] = majority(remixed(hashes, turn))
                        at += 1
            columns = [batch[c] for c in keep] + [pa.array(x.view(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(slim, run, fields)


def block_keys(column: str, blocks: int, distance: int, table: int = 0) -> list[Column]:
    """One key per choice of blocks; the number of the choice, from ``table`` on, is in the upper bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance), start=table):
        key, width = F.lit(0).cast("long"), 0
        for block in chosen:
            bits = edges[block + 1] - edges[block]
            part = F.shiftrightunsigned(column, edges[block]).bitwiseAND(F.lit((1 << bits) - 1))
            key, width = F.shiftleft(key, bits).bitwiseOR(part), width + bits
        if width > 48:
            raise ValueError("so few blocks may differ that a key is too long")
        keys.append(key.bitwiseOR(F.lit(number << 48)))
    return keys


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a spanning forest of the rows of ``values`` that differ in at most ``distance`` bits."""
    left = np.ones(len(values), bool)
    a, b = [], []
    for root in range(len(values)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(values[rest] ^ values[at]).sum(axis=1) <= distance]
            left[near] = False
            a += [at] * len(near)
            b += near.tolist()
            queue += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def links(nodes: DataFrame, keys: list[Column], node: str, check: Sequence[str], distance: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): nodes that share a key and differ in at most ``distance`` bits of the ``check`` columns.

    Of the links within a key, a spanning forest of each chunk pair. ``nodes`` must be distinct.
    """
    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), F.col(node).alias("node"), *check)
    counts = keyed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * chunk)
    parts = F.ceil(F.col("_n") / chunk).cast("int")
    cut = keyed.join(counts, F.col("key") == F.col("_k"), "left").withColumn("_parts", F.coalesce(parts, F.lit(1)))
    cut = cut.withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cut = cut.withColumns({"low": F.least("_mine", "_other"), "high": F.greatest("_mine", "_other")})
    ordered = cut.select("key", "low", "high", "node", *check).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(found: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.stack([found[c] for c in check], axis=1).view(np.uint64)
        node, sizes = found["node"], ends - starts
        first = starts[sizes == 2]
        close = np.bitwise_count(values[first] ^ values[first + 1]).sum(axis=1) <= distance
        a, b = [node[first[close]]], [node[first[close] + 1]]
        for start, end in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            i, j = forest(values[start:end], distance)
            a.append(node[start + i])
            b.append(node[start + j])
        return np.concatenate(a), np.concatenate(b)

    names = ["key", "low", "high", "node", *check]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, np.int64) for c in names}

        def answer(found: dict[str, np.ndarray], last: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
            fresh = np.ones(len(found["key"]), bool)
            fresh[1:] = np.any([found[c][1:] != found[c][:-1] for c in names[:3]], axis=0)
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(fresh))
            if not last:
                rest = {c: x[starts[-1] :].copy() for c, x in found.items()}
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = {}
            several = ends - starts > 1
            a, b = compare(found, starts[several], ends[several])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), rest

        for batch in batches:
            new = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            held = {c: np.concatenate([held[c], new[c]]) for c in names}
            if len(held["key"]):
                out, held = answer(held, False)
                yield out
        if len(held["key"]):
            yield answer(held, True)[0]

    return mapped(ordered, run, "a long, b long")


def classes(docs: DataFrame, distance: int = 4, blocks: int = 7, width: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Fingerprints of ``width``-word shingles, repeats included, link at ``distance`` or fewer differing
    bits; ``component_id`` is the smallest identifier that can be reached over links. Texts without
    words have fingerprint zero, which links like any other. A null identifier is never the smallest
    unless a component has no other; repeated rows each get a row. Fingerprints are computed once and
    held in the shared folder.
    """
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), [(width, seed, False, 1)])
    prints = stage(prints.select("doc_id", F.col("f0").alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = links(nodes.select("fp"), block_keys("fp", blocks, distance), "fp", ["fp"], distance)
    labels = component_ids(nodes, found)
    whole_rows = prints.join(labels, F.col("fp") == F.col("_fp"))
    return whole_rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def sketches(docs: DataFrame, width: int, bands: int, rows: int, checks: int, seed: int = 42, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with fp, size, the band keys k0, k1, ... and the sketch c0, c1, ... (long).

    All are of the set of distinct ``width``-word shingles: ``fp`` is its hash, equal for equal sets. Of
    64 * ``checks`` minima, each under a hash of its own, one bit goes to the sketch; the first ones
    make the band keys, ``rows`` at a time.
    """
    slim = docs.select(*[F.col(c) for c in keep], whole(text).cast("binary").alias("_text"))
    names = ["fp", "size", *[f"k{i}" for i in range(bands)], *[f"c{i}" for i in range(checks)]]
    fields = ", ".join([f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in names])
    if bands * rows > 64 * checks:
        raise ValueError("more minima in bands than there are")
    turns = np.random.default_rng(seed).integers(0, 1 << 63, (2, 64 * checks, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches, "_text"):
            prints, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            least = np.full((batch.num_rows, 64 * checks), (1 << 64) - 1, np.uint64)
            for row, text in enumerate(batch["_text"].to_pylist()):
                hashes = np.unique(shingle_hashes(text.lower().split(), width, seed))
                prints[row], sizes[row] = xxhash.xxh64_intdigest(hashes.tobytes(), seed), len(hashes)
                for at in range(0, len(hashes), 512):
                    found = (hashes[at : at + 512] * turns[0] + turns[1]).min(axis=1)
                    np.minimum(least[row], found, out=least[row])
            least = remixed(least, 1)
            bits = np.packbits((least >> np.uint64(63)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
            columns = [batch[c] for c in keep] + [pa.array(prints.view(np.int64)), pa.array(sizes)]
            for band in range(bands):
                key = np.full(batch.num_rows, band, np.uint64)
                for i in range(band * rows, (band + 1) * rows):
                    key = remixed(key ^ least[:, i], 2)
                columns.append(pa.array(key.view(np.int64)))
            columns += [pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(checks)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return mapped(slim, run, fields)


def allowed_bits(similarity: float, bits: int) -> int:
    """Differing bits, of so many in a sketch, that two texts with this Jaccard similarity of shingles may have.

    Minima differ with the chance 1 - s, and then so does every other bit; 4 standard deviations are granted.
    """
    chance = (1 - similarity) / 2
    return math.floor(bits * chance + 4 * math.sqrt(bits * chance * (1 - chance)))


def shingle_sets(docs: DataFrame, members: DataFrame, names: Sequence[str], width: int, seed: int = 42) -> DataFrame:
    """The columns ``names`` (long) of ``members`` with ``shingles``; their doc_id and text_hash find the text in ``docs``."""
    found = pick_rows(docs, members, [F.col("doc_id"), F.col("text_hash")], ["doc_id", "text_hash"], *names)
    slim = found.select(*names, whole(F.col("row.text")).cast("binary").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            sets = [np.unique(shingle_hashes(x.lower().split(), width, seed)).tobytes() for x in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sets, pa.binary())], [*names, "shingles"])

    return stage(mapped(slim, run, ", ".join(f"{c} long" for c in names) + ", shingles binary"))


def similar(labels: np.ndarray, active: np.ndarray, values: np.ndarray, sets: list[np.ndarray], distance: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (i, j) of at least this Jaccard similarity that join all labels which such links of ``active`` rows can join."""
    labels, a, b = labels.copy(), [], []
    edges = np.cumsum([0, *map(len, sets)])
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(numbers), bool)
    for at in np.flatnonzero(active).tolist():
        apart = labels != labels[at]
        apart[:at] &= ~active[:at]
        rest = np.flatnonzero(apart)
        near = rest[np.bitwise_count(values[rest] ^ values[at]).sum(axis=1) <= distance].tolist()
        if not near:
            continue
        own = flat[edges[at] : edges[at + 1]]
        marked[own] = True
        for other in near:
            if labels[other] == labels[at]:
                continue
            common = int(np.count_nonzero(marked[flat[edges[other] : edges[other + 1]]]))
            if common >= similarity * (len(own) + len(sets[other]) - common) - 1e-9:
                a.append(at)
                b.append(other)
                labels[labels == labels[other]] = labels[at]
        marked[own] = False
    return a, b


def confirmed(docs: DataFrame, members: DataFrame, check: Sequence[str], distance: int, similarity: float, width: int, share: int = SHARE) -> DataFrame:
    """(a, b): links of exactly ``similarity`` or more among the members of each ``root``, enough to reach all that such links reach.

    ``members`` have fp, root, size (shingles), the ``check`` columns, doc_id and text_hash. A root with
    more than ``share`` members, or ``SHINGLES`` shingles, is cut into chunks of about so many. First each
    chunk is linked on its own together with a few members that all chunks of the root get, which joins
    what is mostly near copies. What is then outside the largest component of its root meets every
    chunk of the root.
    """
    names = ["root", "low", "high", "fp", "label", "active", *check, "shingles"]

    def link(key: tuple, given: pa.Table) -> pa.Table:
        given = given.combine_chunks().sort_by("fp")
        fp = given["fp"].to_numpy()
        values = np.stack([given[c].to_numpy() for c in check], axis=1).view(np.uint64)
        held = [np.frombuffer(x, np.uint64) for x in given["shingles"].to_pylist()]
        a, b = similar(given["label"].to_numpy(), given["active"].to_numpy(), values, held, distance, similarity)
        return pa.table({"a": fp[a] if a else np.empty(0, np.int64), "b": fp[b] if b else np.empty(0, np.int64)})

    def linked(rows: DataFrame) -> DataFrame:
        return rows.select(*names).groupBy("root", "low", "high").applyInArrow(link, "a long, b long")

    send_package(docs.sparkSession)
    chunks = F.ceil(F.greatest(F.count("*") / share, F.sum("size") / SHINGLES))
    large = stage(members.groupBy(F.col("root").alias("_root")).agg(chunks.cast("long").alias("parts")).filter("parts > 1"))
    held = ["fp", "root", "part", *check]
    if large.isEmpty():
        sets = shingle_sets(docs, members.withColumn("part", F.lit(0).cast("long")), held, width)
        return linked(sets.withColumns({"low": F.col("part"), "high": F.lit(0), "label": F.col("fp"), "active": F.lit(True)}))
    cut = members.join(large, F.col("root") == F.col("_root"), "left").drop("_root")
    cut = cut.withColumns({"part": F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))), "draw": F.xxhash64("fp", F.lit(1))})
    cut = stage(cut.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))))
    hubs = cut.filter("parts > 1").groupBy("root", F.pmod("draw", F.lit(HUBS))).agg(F.min("fp").alias("_hub")).select("_hub")
    marked = cut.join(hubs, F.col("fp") == F.col("_hub"), "left").withColumn("hub", F.col("_hub").isNotNull().cast("long")).drop("_hub")
    sets = shingle_sets(docs, marked, [*held, "parts", "hub"], width)
    everywhere = F.when(F.col("hub") == 1, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
    first = sets.withColumns({"low": F.explode(everywhere), "high": F.lit(0), "label": F.col("fp"), "active": F.lit(True)})
    within = stage(linked(first))
    roots = groups(within, "a", "b").select(F.col("node").alias("_node"), F.col("root").alias("_label"))
    cut = cut.filter("parts > 1").join(roots, F.col("fp") == F.col("_node"), "left").withColumn("label", F.coalesce("_label", "fp"))
    labels = stage(cut.select("fp", "root", "label", "part", "parts", "draw"))
    sizes = labels.groupBy("root", "label").agg(F.count("*").alias("_size"))
    main = sizes.groupBy("root").agg(F.max(F.struct("_size", "label")).alias("_main"), F.sum("_size").alias("_all"))
    outside = F.col("_all") - F.col("_main._size")
    main = stage(main.filter(outside > 0).select(F.col("root").alias("_r"), F.col("_main.label").alias("_most"), F.ceil(outside / F.lit(share)).cast("int").alias("_others")))
    open_ = labels.join(main, F.col("root") == F.col("_r")).withColumn("_mine", F.pmod("draw", F.col("_others")).cast("int"))
    left = open_.withColumns({"low": F.col("part"), "high": F.explode(F.sequence(F.lit(0), F.col("_others") - 1)), "active": F.lit(False)})
    right = open_.filter("label != _most").withColumns({"low": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "high": F.col("_mine"), "active": F.lit(True)})
    places = [x.select(F.col("fp").alias("_fp"), "low", "high", "label", "active") for x in (left, right)]
    again = places[0].unionByName(places[1]).join(sets, F.col("_fp") == F.col("fp"))
    return within.unionByName(linked(again))


def _near(
    docs: DataFrame, similarity: float, width: int, bands: int, rows: int, checks: int, text: str, doc_id: str, share: int
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (_fp, _component) of every fp: see :func:`near_groups`."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    prints = stage(sketches(slim, width, bands, rows, checks, keep=["doc_id", "text_hash"]))
    keys, check = [f"k{i}" for i in range(bands)], [f"c{i}" for i in range(checks)]
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = stage(prints.groupBy("fp", "size", *keys, *check).agg(F.min(own).alias("first")))
    distance = allowed_bits(similarity, 64 * checks)
    found = groups(links(nodes, [F.col(k) for k in keys], "fp", check, distance), "a", "b")
    members = stage(nodes.select("fp", "size", "first.doc_id", "first.text_hash", *check).join(found, F.col("fp") == F.col("node")).drop("node"))
    return prints, component_ids(nodes.select("fp", "first"), confirmed(slim, members, check, distance, similarity, width, share))


def near_groups(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5, checks: int = 4, text: str = "text", doc_id: str = "doc_id", share: int = SHARE
) -> DataFrame:
    """(doc_id, text_hash, least): every row with the (doc_id, text_hash) that stays for its group.

    Texts meet by minima of their distinct ``width``-word shingles, in ``bands`` of ``rows``: whatever
    an edit is, passages or single words, two texts miss each other with the chance
    (1 - s ** rows) ** bands, 7 in 100 000 at a similarity of 0.8. They are then held to the distance
    that ``similarity`` allows between sketches. What such links reach is only a group of candidates:
    the groups are what links of :func:`confirmed` reach.
    Texts without words are one group; the row with the smallest identifier stays, a null one last,
    and of rows that share an identifier the one with the smallest hash of its text.
    """
    prints, labels = _near(docs, similarity, width, bands, rows, checks, text, doc_id, share)
    return prints.join(labels, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", F.col("_component").alias("least"))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with all its columns; see :func:`near_groups`."""
    _, labels = _near(docs, similarity, width, 24, 5, 4, text, doc_id, SHARE)
    least = labels.select("_component.doc_id", "_component.text_hash").distinct()
    return pick_rows(docs, least, [F.col(doc_id), F.xxhash64(F.col(text))], ["doc_id", "text_hash"]).select("row.*")


def component_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(_fp, _component): for each node its component's smallest ``first``.

    The table of the smallest is written, so that adaptive execution can cut a large component's rows in its join.
    """
    roots = groups(found, "a", "b").select(F.col("node").alias("_node"), "root")
    rooted = stage(nodes.join(roots, F.col("fp") == F.col("_node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = stage(rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_component")))
    return rooted.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "_component")
