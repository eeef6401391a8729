"""Clustering, search and the manifest against plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm import clusters, merkle, topk
from quadweave.schema import local_table
from samples import ODD

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="session")
def table(spark):
    """Embeddings with extra columns of names that the operators use."""
    schema = T.StructType.fromDDL("vec_id long, embedding array<float>, q string, block int, cluster string, score string, `group` string, ids int")
    return lambda *rows: local_table(spark, [(*r, "x", 1, "x", "x", "x", 2) for r in rows], schema)


def scaled(x, scale=256):
    return max(-(1 << 50), min(1 << 50, math.floor(scale * float(np.float32(x)))))


def usable(rows, dims=None):
    """(place, id, integers) of the vectors that take part."""
    kept = []
    for at, (key, v) in enumerate(rows):
        if v is not None and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v):
            kept.append((at, key, [scaled(x) for x in v]))
    return kept


# --- clusters ----------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, dims, seed=2):
    kept = usable(rows, dims)
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest(), q) for _, key, q in kept)
    centroids = [q for _, q in drawn[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, q in kept:
            groups[nearest(q)[1]].append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    top = (1 << 63) - 1
    return Counter((key, nearest(q)[1], min(nearest(q)[0], top)) for _, key, q in kept), centroids


def cloud(n, dims, seed, spread=0.2, centres=6):
    made = np.random.default_rng(seed)
    at = made.normal(0, 1, (centres, dims))
    return [(i, [float(x) for x in at[made.integers(centres)] + made.normal(0, spread, dims)]) for i in range(n)]


ODD_VECTORS = [
    (1, None),
    (2, [0.5, None, 0.25, 0.0]),
    (3, [0.5, NAN, 0.25, 0.0]),
    (4, [INF, 0.0, 0.25, 0.0]),
    (5, [0.5, 0.25]),
    (6, []),
    (7, [0.1, -0.2, 0.3, -0.4]),
    (7, [0.1, -0.2, 0.3, -0.4]),
    (7, [0.1, -0.2, 0.3, 0.4]),
    (None, [0.1, -0.2, 0.3, 0.5]),
    (None, [-0.001, 0.0, 0.0, 0.0]),
    (8, [1e4, -1e4, 0.0, 0.0]),
]


@pytest.mark.parametrize("n,k,dims,rounds,spread", [(600, 12, 8, 6, 0.2), (500, 7, 5, 3, 2.0), (5, 9, 4, 2, 1.0), (300, 1, 3, 2, 1.0)])
def test_clusters_are_those_of_plain_rounds(table, n, k, dims, rounds, spread):
    rows = cloud(n, dims, n, spread)
    got, centroids, evaluated = clusters.kmeans(table(*rows).repartition(5), k, rounds, dims)
    want, at = plain_kmeans(rows, k, rounds, dims)
    assert Counter(map(tuple, got.collect())) == want and centroids.tolist() == at
    assert evaluated <= n * min(n, k) * rounds


def test_bounds_save_distances(table):
    rows = cloud(2000, 16, 5, 0.05, 20)
    got, _, evaluated = clusters.kmeans(table(*rows), 20, 8, 16)
    assert Counter(map(tuple, got.collect())) == plain_kmeans(rows, 20, 8, 16)[0]
    assert evaluated < 0.4 * 2000 * 20 * 8


def test_clusters_of_odd_vectors(table):
    hot = [(100 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(400)]
    ties = [(600 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(30)]
    huge = [(900, [3e38, -3e38, 1.0, 1.0]), (901, [-3e38, 3e38, 1.0, 1.0])]
    for rows in (ODD_VECTORS, ODD_VECTORS + hot + ties, ODD_VECTORS + huge + ties):
        got, centroids, _ = clusters.kmeans(table(*rows).repartition(3), 6, 4, 4)
        want, at = plain_kmeans(rows, 6, 4, 4)
        assert Counter(map(tuple, got.collect())) == want and centroids.tolist() == at


def test_cluster_report(table):
    rows = cloud(200, 4, 3)
    labels, centroids, _ = clusters.kmeans(table(*rows), 5, 2, 4)
    got = clusters.report(labels, centroids).collect()
    sums = Counter()
    for r in got:
        sums[r.cluster] += r.distance
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert len(got) == 200


def test_clusters_of_nothing(table):
    for rows in ([], [(1, None), (2, [0.5])]):
        labels, centroids, _ = clusters.kmeans(table(*rows), 3, 2, 4)
        assert clusters.report(labels, centroids).collect() == []
    with pytest.raises(ValueError):
        clusters.kmeans(table(), rounds=0)


# --- search ------------------------------------------------------------------------------------


def plain_search(rows, k, every):
    kept, top = usable(rows), (1 << 63) - 1
    found = []
    for at, key, q in kept:
        if key is None or key % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), other is None, other or 0, other) for place, other, c in kept if place != at]
        found += [(key, r, x[3], max(-top - 1, min(top, -x[0]))) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(found)


@pytest.mark.parametrize("n,dims,k,every,parts", [(700, 6, 5, 50, 4), (60, 3, 100, 7, 3), (300, 2, 3, 1, 7)])
def test_search_is_that_of_all_pairs(table, monkeypatch, n, dims, k, every, parts):
    rows = [(i, [round(x, 1) for x in v]) for i, v in cloud(n, dims, n)]
    want = plain_search(rows, k, every)
    assert Counter(map(tuple, topk.search(table(*rows).repartition(parts), k, every).collect())) == want
    for name, size in (("ROWS", 16), ("ELEMENTS", 64), ("QUERIES", 5), ("GROUP_ELEMENTS", 256)):
        monkeypatch.setattr(topk, name, size)
    assert Counter(map(tuple, topk.search(table(*rows).repartition(parts), k, every).collect())) == want


def test_search_among_odd_vectors(table):
    hot = [(100 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(300)]
    huge = [(900, [3e38, -3e38]), (902, [-3e38, 3e38, 1.0, 1.0])]
    for rows in (ODD_VECTORS, ODD_VECTORS + hot, ODD_VECTORS + huge, [(0, [0.5])]):
        got = topk.search(table(*rows).repartition(3), 4, 2)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(map(tuple, got.collect())) == plain_search(rows, 4, 2)


def test_search_of_nothing(table):
    assert topk.search(table()).collect() == []
    assert topk.search(table((1, [0.5]), (3, [0.25])), 4, 2).collect() == []


# --- manifest ----------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, change=False):
    def one(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    text = r["text"].encode().lower().decode() if change and r["text"] is not None else r["text"]
    return sha(*[one(x) for x in (r["doc_id"], r["source"], r["lang"], text)])


def plain_tree(leaves, fan):
    """The root, and for every leaf its siblings (left, right) of each level."""
    paths, level = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for run in runs:
            for at, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append(("".join(d for d, _ in run[:at]), "".join(d for d, _ in run[at + 1 :])))
        level = [(sha(*[d for d, _ in run]), [i for _, m in run for i in m]) for run in runs]
    return level[0][0], paths


def plain_manifest(rows, fan, touched):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), plain_leaf(r, True) if touched(r) else plain_leaf(r), r))
    trees = {}
    for lang, found in groups.items():
        found.sort(key=lambda x: x[:3])
        trees[lang] = plain_tree([x[2] for x in found], fan)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, above = plain_tree([trees[x][0] for x in langs], fan)
    out = []
    for lang, upper in zip(langs, above):
        for x, lower in zip(groups[lang], trees[lang][1]):
            node = x[3]
            for left, right in lower + upper:
                node = sha(left, node, right)
            proof = sha(*[left + right for left, right in lower + upper])
            out.append((x[4]["doc_id"], lang, x[2], trees[lang][0], root, proof, node, node == root))
    return Counter(out)


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_manifest(spark, fan, monkeypatch):
    monkeypatch.setattr(merkle, "RANK_ROWS", 40)
    schema = "doc_id long, text string, source string, lang string, idx string, tree string, digest int, path string, n int"
    langs = ["de", None, "", "é", "zz", "en"]
    rows = [(i, f"Text {i} {'ÄA' * (i % 3)}" if i % 7 else None, "s" if i % 5 else None, "hot" if i % 2 else langs[i % 6]) for i in range(230)]
    rows += [(k, t, "s", "odd") for k, t, *_ in ODD] + [(None, "Lone", None, "one")]
    table = spark.createDataFrame([(*r, "x", "x", 1, "x", 2) for r in rows], schema).repartition(6)
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    names = ("doc_id", "source", "lang", "text")
    made = merkle.manifest(table, touched, fields=names, fan_out=fan)
    got = made.select("doc_id", "group", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded_root", "verified").collect()
    hit = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    want = plain_manifest([dict(zip(("doc_id", "text", "source", "lang"), r)) for r in rows], fan, hit)
    assert Counter(map(tuple, got)) == want
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_little(docs, empty):
    assert merkle.manifest(empty, group="source", fields=("doc_id", "text")).collect() == []
    (one,) = merkle.manifest(docs((1, "Alone")), group="source", fields=("doc_id", "text")).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1", "5:Alone") and one.path == [] and one.verified
