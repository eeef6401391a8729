"""Operators over groups of texts - copies, shards, mixes - and the pipeline, against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quadweave.llm import exact, graph, mixing, shards, simhash
from quadweave.llm.queries import QUERIES, SQL
from quadweave.schema import local_table
from samples import ODD

SF = "/root/testdata/sf0.001"


def lowered(text):
    return (text or "").encode().lower()


def order(key):
    return (key is not None, key)


# --- exact copies ------------------------------------------------------------------------------


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(docs, odd, largest):
    got = exact.dedup(odd, largest=largest).collect()
    groups = defaultdict(list)
    for k, t, *_ in ODD:
        groups[hashlib.sha256(lowered(t)).hexdigest()].append(k)
    assert Counter(r.doc_id for r in got) == Counter(k for k, *_ in ODD)
    for digest, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == digest]
        known = [k for k in ids if k is not None]
        best = (max if largest else min)(known) if known else None
        assert len(rows) == len(ids) and {(r.keep_id, r.group_size) for r in rows} == {(best, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [best]
    kept = exact.keep_one(odd, largest=largest)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_any_partitions(docs, empty):
    rows = [(i, f"text {i % 37}" if i % 3 else "HOT" if i % 2 else "hot") for i in range(900)]
    want = None
    for n in (1, 7, 300):
        table = docs(*rows).repartition(n)
        got = sorted(map(tuple, exact.dedup(table).collect()))
        want = want or got
        assert got == want
    runs = docs(*rows).select("doc_id", exact.digest(F.col("text")).alias("digest"), F.length("text").alias("n_bytes")).repartition(9)
    merged = [sorted(map(tuple, exact.merge_runs(runs, runs=256, bits=b).collect())) for b in (1, 4, 8)]
    assert merged[0] == merged[1] == merged[2]
    assert exact.dedup(empty).count() == 0 and exact.keep_one(empty).count() == 0


@pytest.mark.parametrize("runs,bits,start", [(1, 3, 50), (2, 1, 7), (8, 3, 1 << 18), (64, 2, 11), (256, 1, 40), (None, 3, 3)])
def test_sorted_runs_merge_in_rounds(docs, monkeypatch, runs, bits, start):
    """A hot text, null identifiers and repeated rows, from one run to many short ones."""
    monkeypatch.setattr(exact, "START", start)
    rows = [(None if i % 11 == 0 else i % 400, "hot" if i % 3 else f"text {i % 50}") for i in range(700)]
    entries = docs(*rows).select("doc_id", exact.digest(F.col("text")).alias("digest"), F.length("text").alias("n_bytes")).repartition(6)
    for largest in (True, False):
        want = defaultdict(list)
        for k, t in rows:
            want[hashlib.sha256(t.encode()).hexdigest(), len(t)].append(k)
        best = {k: ((max if largest else min)([x for x in v if x is not None], default=None), len(v)) for k, v in want.items()}
        got = exact.merge_runs(entries, largest, runs, bits).collect()
        assert len(got) == len(best) and {(r.digest, r.n_bytes): (r.keep_id, r.group_size) for r in got} == best
    with pytest.raises(ValueError):
        exact.merge_runs(entries, runs=3)


def test_runs_exchange_every_digest_to_its_range():
    keys = np.sort(np.frombuffer(np.random.default_rng(3).bytes(40 * 500), "S40"))
    run = exact.Run(keys, np.arange(500), np.ones(500, np.int64))
    for runs, bits in ((16, 1), (64, 4), (8, 3)):
        held = {5: run}
        for shift, width in exact._plan(runs, bits):
            sent = [exact._sent(n, r, runs, shift, width) for n, r in held.items()]
            pieces = defaultdict(list)
            for batch in sent:
                for row in batch.to_pylist():
                    pieces[row["run"]].append(exact.Run.of(row))
            held = {n: exact.multiway(p, True) for n, p in pieces.items()}
        top = 32 - (runs.bit_length() - 1)
        assert sum(len(r.keys) for r in held.values()) == 500
        assert all((exact.prefixes(r.keys) >> np.uint64(top) == n).all() for n, r in held.items())


# --- components and near copies ----------------------------------------------------------------


def plain_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (150, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7), (7, 7), (None, 3)]
    table = local_table(spark, pairs, T.StructType.fromDDL("x long, y long"))
    got = {r.node: r.root for r in graph.components(table, "x", "y").collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == plain_components({x for p in real for x in p}, real)
    assert graph.components(table.limit(0), "x", "y").count() == 0


def plain_print(text, width=4):
    import xxhash

    ws = lowered(text).split()
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + width]), 42) for i in range(max(1, len(ws) - width + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_classes(rows, distance=4):
    prints = [plain_print(t) for _, t in rows]
    values = np.array(prints, np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance) if j > i]
    roots = plain_components(range(len(rows)), pairs)
    known = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        known[roots[i]] += [k] if k is not None else []
    least = {r: min(ids) if ids else None for r, ids in known.items()}
    return [(k, f"{p:016x}", least[roots[i]]) for i, ((k, _), p) in enumerate(zip(rows, prints))]


def test_simhash_classes(docs, odd, empty):
    rng = np.random.default_rng(8)
    rows = [(r[0], r[1]) for r in ODD]
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    for i in range(120):
        text = list(base)
        for _ in range(i % 4):
            text[int(rng.integers(400))] = f"changed{i}"
        rows.append((100 + i, " ".join(text)))
    got = simhash.classes(docs(*rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_classes(rows))
    assert simhash.classes(empty).count() == 0


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op2_simhash_classes"](spark, SF).collect())) == Counter(plain_classes(rows))


@pytest.mark.parametrize("chunk", [2, 16, 2048])
def test_links_of_a_hot_key_in_chunks(spark, chunk):
    """Many fingerprints share every key; links join exactly what is close, however the key is cut."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 40, rng.integers(0, 9))) for _ in range(300)})
    nodes = local_table(spark, [(v,) for v in values], T.StructType.fromDDL("fp long"))
    found = simhash.links(nodes, simhash.block_keys("fp", 7, 4), "fp", ["fp"], 4, chunk=chunk).collect()
    assert all(bin(r.a ^ r.b).count("1") <= 4 for r in found)
    real = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 4]
    assert plain_components(values, [(r.a, r.b) for r in found]) == plain_components(values, real)


def near_rows():
    rng = np.random.default_rng(4)
    rows, groups = [], []
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, 300)]
        groups.append([])
        for copy in range(1 + g % 4):
            text = list(base)
            for at in rng.choice(300, 3 * (copy > 0), replace=False):
                text[int(at)] = f"new{g}x{copy}"
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(text)))
    return rows, groups


def test_near_copies(docs, odd, empty):
    rows, groups = near_rows()
    kept = {r.doc_id for r in simhash.keep_one(docs(*rows)).collect()}
    assert kept == {min(g) for g in groups}
    table = odd.unionByName(docs((11, "repeated row"), (11, "repeated row"), (11, "another text of that id")))
    left = simhash.keep_one(table)
    assert left.columns == odd.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert max(got.values()) == 1 and (11, "repeated row") in got and (11, "another text of that id") in got
    assert sum(k in (1, 2, 3, None) and not (t or "").split() for k, t in got) == 1
    assert simhash.keep_one(empty).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited_pairs(low, high, each, passages=(60, 200, 800)):
    """Pairs of texts of one Zipf vocabulary, a passage appended or replaced or words changed; their similarity is in the range."""
    rng = np.random.default_rng(11)
    draw = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 50_000]
    pairs = []
    for kind in ("appended", "replaced", "scattered"):
        for passage in passages if kind != "scattered" else (40,):
            found = 0
            while found < each:
                aim = rng.uniform(low, high)
                if kind == "appended":
                    base = draw(int(passage * aim / (1 - aim)))
                    other = base + draw(passage)
                else:
                    base = draw(int(passage * (1 + aim) / (1 - aim)))
                    at = int(rng.integers(0, len(base) - passage))
                    other = base[:at] + draw(passage) + base[at + passage :]
                if kind == "scattered":
                    other = [f"new{i}" if i % 53 == 7 and i < aim * 2000 else w for i, w in enumerate(base)]
                a, b = " ".join(base), " ".join(other)
                if kind == "scattered" or low <= jaccard(a, b) <= high:
                    pairs.append((a, b))
                    found += 1
    return pairs


def test_near_copies_by_passages(docs):
    """Every pair at 0.8 or above is joined, whatever was edited."""
    pairs = [(a, b) for a, b in edited_pairs(0.80, 0.87, 12) if jaccard(a, b) >= 0.8]
    assert len(pairs) >= 72
    rows = [(2 * i + side, t) for i, pair in enumerate(pairs) for side, t in enumerate(pair)]
    kept = {r.doc_id for r in simhash.keep_one(docs(*rows)).collect()}
    assert kept == {2 * i for i in range(len(pairs))}


def exact_groups(texts):
    """For each text the first one that links of 0.8 or more reach."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("share", [simhash.SHARE, 5])
def test_near_copies_are_confirmed(docs, share):
    """Pairs below 0.8 stay apart, also where candidates chain and where a large group is cut into chunks."""
    pairs = edited_pairs(0.65, 0.79, 6, passages=(60, 200))
    texts = [t for pair in pairs for t in pair]
    rng = np.random.default_rng(5)
    base = [f"b{x}" for x in rng.integers(0, 4000, 400)]
    for i in range(60):
        text = list(base)
        # Groups of three, each near copies of one another, whose likeness to other groups is below 0.8.
        for at in np.random.default_rng(i // 3).choice(400, 9, replace=False):
            text[int(at)] = f"group{i // 3}x{at}"
        text[i % 3 * 100] = f"own{i}"
        texts.append(" ".join(text))
    groups = simhash.near_groups(docs(*enumerate(texts)), share=share).collect()
    want = exact_groups(texts)
    assert 12 < len(set(want[-60:])) < 60
    assert {r.doc_id: r.least.doc_id for r in groups} == dict(enumerate(want))


# --- shards ------------------------------------------------------------------------------------


def test_schedule_is_longest_first():
    placed = shards.schedule([("a", 5), ("b", 5), ("c", 4), ("d", 3), ("e", 3)], 2)
    assert placed == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}


@pytest.mark.parametrize("bundles", [1, 4, 1024])
def test_shards(docs, odd, empty, bundles):
    rows = [(100 + i, f"text {i} " * (i % 50)) for i in range(700)] + [(1000 + i, "a copy that many rows share " * 5) for i in range(150)]
    table = odd.unionByName(docs(*rows))
    got = shards.assign(table, 6, bundles=bundles).collect()
    texts = [r[1] for r in ODD] + [r[1] for r in rows]
    assert len(got) == len(texts)
    assert sum(r.size for r in got) == sum(len((t or "").encode()) + 8 for t in texts)
    by_shard, by_crc = defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
        by_crc[(r.text_crc32, r.size)].add(r.shard)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    assert sum(len(s) > 1 for s in by_crc.values()) <= 1  # null and empty texts are two groups
    if bundles == 1024:
        loads = [sum(r.size for r in rows) for rows in by_shard.values()]
        assert len(loads) == 6
        groups = Counter()
        for t in texts:
            groups[t] += len((t or "").encode()) + 8
        plain = Counter()
        for key, shard in shards.schedule([(str(i), s) for i, s in enumerate(groups.values())], 6).items():
            plain[shard] += list(groups.values())[int(key)]
        assert max(loads) <= max(plain.values()) * 1.02
    assert shards.assign(empty, 6).count() == 0


def test_slots_over_parts(docs, monkeypatch):
    monkeypatch.setattr(shards, "RANK_ROWS", 10)
    got = shards.assign(docs(*[(i, f"text {i}") for i in range(400)]), 3).collect()
    for s in range(3):
        mine = [r.slot for r in got if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))


# --- mixing ------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix(docs, odd, block):
    rng = np.random.default_rng(block)
    rows = [(100 + i, "w " * int(rng.integers(0, 60)), f"src{int(rng.zipf(1.5)) % 9}") for i in range(300)]
    table = odd.filter("doc_id != 5 or doc_id is null").unionByName(docs(*rows))
    given = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in ODD if r[0] != 5] + rows
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(lowered(t).split())
    pieces, placed, plan = mixing.mix(table, block=block)
    got = mixing.taken(pieces, placed, plan).collect()
    want, taken = plain_targets(sizes), Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(lowered(t).split())) for k, t, _ in given)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    again = mixing.taken(*mixing.mix(table.repartition(5), block=block)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    # In any stretch of the schedule every source has nearly its share.
    slots = sorted(map(tuple, mixing.schedule(plan, block).select("slot", "source", "length").collect()))
    assert [s[0] for s in slots] == list(range(len(slots)))
    share = Counter(s[1] for s in slots)
    for stretch in (len(slots) // 3, len(slots) // 2):
        part = Counter(s[1] for s in slots[:stretch])
        assert all(abs(part[s] - n * stretch / len(slots)) < 6 for s, n in share.items())
    assert sorted(p.words for p in pieces.collect()) and all(p.words <= block for p in pieces.collect())


def test_mix_with_a_very_long_document(docs, odd):
    """A document of many blocks, alone in its source or most of one, is read in part or twice like any other."""
    rng = np.random.default_rng(8)
    rows = [(100 + i, "w " * int(rng.integers(0, 90)), "s" if i % 2 else None) for i in range(200)]
    given = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in ODD] + rows + [(900, "long " * 9_000, "s")]
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(lowered(t).split())
    table = odd.unionByName(docs(*rows, (900, "long " * 9_000, "s")))
    got, want, taken = mixing.taken(*mixing.mix(table, block=256)).collect(), plain_targets(sizes), Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(lowered(t).split())) for k, t, _ in given)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_mix_of_nothing(docs, empty):
    assert mixing.taken(*mixing.mix(empty)).count() == 0 and mixing.mixed_rows(empty).count() == 0
    got = mixing.taken(*mixing.mix(docs((1, None), (2, "")))).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_mixed_rows_follow_the_mix(docs):
    rows = [(i, f"w{i} " * (5 + i % 11), f"s{i % 4}") for i in range(200)] + [(7, "w7 " * 12, "s3")]
    table = docs(*rows)
    full = Counter()
    for r in mixing.taken(*mixing.mix(table)).collect():
        full[r.doc_id] += r.full
    out = mixing.mixed_rows(table)
    assert out.columns == table.columns
    assert Counter(r.doc_id for r in out.collect()) == +full


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    from quadweave.session import stage

    seen = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(step(spark, seen[-1], SF)))
        assert seen[-1].columns == columns, name
    raw, good, unique, apart, mixed = (x.toPandas() for x in seen)
    assert 0 < len(good) < len(raw) and good.doc_id.isin(raw.doc_id).all()
    last = {}
    for k, t in zip(good.doc_id, good.text):
        last[lowered(t)] = max(k, last.get(lowered(t), k))
    assert set(unique.doc_id) == set(last.values()) and len(unique) == len(last)
    assert apart.doc_id.is_unique and set(apart.doc_id) <= set(unique.doc_id)
    assert mixed.doc_id.value_counts().max() <= 2 and set(mixed.doc_id) <= set(apart.doc_id)
    final = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).toPandas()
    texts = dict(zip(mixed.doc_id, mixed.text))
    assert Counter(final.doc_id) == Counter(mixed.doc_id)
    assert all(d == hashlib.sha256(texts[k].encode()).hexdigest() for k, d in zip(final.doc_id, final.decoded_sha256))
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(whole.doc_id, whole.ids_sha256)) == Counter(zip(final.doc_id, final.ids_sha256))


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
