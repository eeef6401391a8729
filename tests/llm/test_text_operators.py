"""Operators that judge, score or encode single texts, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm import bpe, lm, quality, toxicity, urls, wavelet
from quadweave.llm.queries import QUERIES
from quadweave.llm.succinct import Bits, EliasFano, bundle, unbundle
from quadweave.llm.wavelet import Matrix
from quadweave.schema import local_table

from samples import ODD

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(text):
    return (text or "").encode().lower().split()


# --- url rules ---------------------------------------------------------------------------------

def judged(spark, rules, *links):
    schema = T.StructType.fromDDL("page_id long, url string, host string, h string, `row` string, best string")
    pages = local_table(spark, [(i, u, "x", "x", "x", "x") for i, u in enumerate(links)], schema)
    rules = local_table(spark, rules, T.StructType.fromDDL("host string, path string, verdict string"))
    found = sorted(urls.judge(pages, rules).collect(), key=lambda r: r.page_id)
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def test_rules_fit_hosts_subdomains_and_paths(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "", "block"), ("net", "", "allow")]
    rows = judged(
        spark, rules, "http://example.com/en/x", "http://www.Example.COM/en/x?q", "http://badexample.com/english", "http://a.example.com/english#t",
        "http://example.com", "no url", None, "http://x.net?a://b", "http://x.net", "", "http://a..net/x", "x://", "http://org/",
    )
    assert rows == [
        ("example.com", "/en/x", "example.com/en", "block"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("badexample.com", "/english", "com/", "allow"),
        ("a.example.com", "/english", "example.com/en", "block"),
        ("example.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.net", "", "net", "block"),
        ("x.net", "", "net", "block"),
        ("", "", None, "allow"),
        ("a..net", "/x", "net", "block"),
        ("", "", None, "allow"),
        ("org", "/", None, "allow"),
    ]


def test_urls_long_repeated_and_without_rules(spark):
    long = "http://" + "a." * 3000 + "com/" + "p/" * 20_000
    rows = judged(spark, [("com", "/p/", "block"), (None, None, None)], long, long, "http://com/p/")
    assert [r[3] for r in rows] == ["block"] * 3
    assert [r[2:] for r in judged(spark, [], "http://com/p/")] == [(None, "allow")]
    assert judged(spark, [("com", "/", "block")]) == []


def test_url_rules_by_shuffle(spark, monkeypatch):
    links = [f"http://h{i % 7}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(200)]
    rules = [("example.com", "/en/", "block"), ("h3.example.com", "/", "allow")]
    small = judged(spark, rules, *links)
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert judged(spark, rules, *links) == small


# --- quality -----------------------------------------------------------------------------------


def plain_quality(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(docs, odd):
    more = ["a b c d e f a b c d e g", "x\nx\n x\n\n \ny # $", "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5", "a a a a a a", "w " * 9 + "w"]
    table = odd.unionByName(docs(*[(100 + i, t) for i, t in enumerate(more)]))
    got = quality.judge(table, None)
    assert len([c for c in got.columns if c == "score"]) == 1
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(r.text)
        assert r.kept is not r.base_failed and r.score == 0 and r.source in ("s", "t", None)


def test_quality_ratio_is_that_of_the_two_multinomials(spark, docs):
    import xxhash

    clean = [f"good words make a fine text number {i} and here are some more of them" for i in range(20)]
    junk = ["buy### now!!! click%%% here### " + " ".join(f"spam{i}{j}" for j in range(10)) for i in range(20)]
    table = docs(*enumerate(clean + junk))
    cells = 512
    trusted = local_table(spark, [(i,) for i in [*range(10), 10**9, None, 3]], T.StructType.fromDDL("doc_id long"))
    ratios = quality.weights(table, trusted, cells=cells)

    def hashed(*ws):
        seed = 42
        for w in ws:
            seed = xxhash.xxh64_intdigest(w, seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % cells

    def grams(text):
        ws = text.split()
        return [hashed(w) for w in ws] + [hashed(a, b) for a, b in zip(ws, ws[1:])]

    raw, own = Counter(), Counter()
    for i, t in enumerate(clean + junk):
        raw.update(grams(t))
        if i < 10:
            own.update(grams(t))
    n, m = sum(raw.values()) + cells, sum(own.values()) + cells
    want = [math.log((own[c] + 1) / m) - math.log((raw[c] + 1) / n) for c in range(cells)]
    assert np.allclose(ratios, want, atol=1e-4)
    for r in quality.judge(table, ratios, threshold=-0.05, cells=cells).collect():
        g = grams(r.text)
        assert abs(r.score - sum(ratios[c] for c in g) / len(g)) < 1e-9
        assert r.kept == (r.score >= -0.05)
        assert r.kept or r.doc_id >= 10
        assert not r.kept or r.doc_id < 20


def test_quality_ids_by_shuffle_and_empty(spark, docs, odd, empty, monkeypatch):
    ids = local_table(spark, [(6,), (8,)], T.StructType.fromDDL("doc_id long"))
    small = quality.weights(odd, ids)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert quality.weights(odd, ids) == small
    assert quality.weights(empty, ids) is None
    assert quality.judge(empty, None).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_whole_texts(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts, flags = [], []
    for i in range(600):
        ws = [f"w{x}" for x in rng.integers(0, 300, 40)]
        toxic = i % 5 == 0
        if toxic:
            ws[int(rng.integers(40))] = "vileword"
            ws[int(rng.integers(40))] = "nastyword"
        texts.append(" ".join(ws))
        flags.append(int(toxic))
    table = docs(*enumerate(texts))
    labels = local_table(spark, [*[(i, f) for i, f in enumerate(flags) if i % 3], (None, 1), (7, None), (5, 1), (5, 0)], T.StructType.fromDDL("doc_id long, toxic int"))
    model = toxicity.fit(table, labels)
    assert 0 < len(model.cells) < 5000
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    toxic = [got[i] for i in held if flags[i]]
    clean = [got[i] for i in held if not flags[i]]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.97
    again = toxicity.fit(table, labels)
    assert (again.cells == model.cells).all() and (again.weights == model.weights).all()
    # A word at the end of a very long text counts.
    late = docs((1, "w1 " * 100_000), (2, "w1 " * 100_000 + "vileword nastyword"), (3, None), (4, ""))
    scores = {r.doc_id: r.score for r in toxicity.score(late, model).collect()}
    assert scores[2] > scores[1] and scores[3] == scores[4]
    assert toxicity.score(empty, model).count() == 0


def plain_ftrl(rows, how):
    """Per-coordinate FTRL-proximal, a cell at a time: z and n as in the published algorithm."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(cell):
        l1 = 0.0 if cell == "bias" else how.l1
        if abs(z[cell]) <= l1:
            return 0.0
        return -(z[cell] - math.copysign(l1, z[cell])) / ((how.beta + math.sqrt(n[cell])) / how.alpha + how.l2)

    for _ in range(how.rounds):
        for words, pairs, label in rows:
            value = {c: how.pair_value for c in pairs} | {c: 1.0 for c in words} | {"bias": 1.0}
            weights = {c: weight(c) for c in value}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(weights[c] * v for c, v in value.items())))))
            for c, v in value.items():
                g = (p - label) * v * (how.positive if label else 1.0)
                sigma = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / how.alpha
                z[c] += g - sigma * weights[c]
                n[c] += g * g
    return {c: weight(c) for c in z if weight(c)}


@pytest.mark.parametrize("how", [toxicity.Ftrl(), toxicity.Ftrl(0.3, 0.5, 0.2, 0.1, 3, 0.7, 2.0)])
def test_toxicity_weights_are_those_of_plain_ftrl(spark, docs, how):
    """Same rows, order and weights, from texts to the model and on to the scores."""
    import xxhash

    rng = np.random.default_rng(9)
    texts = [" ".join(f"W{x}." for x in rng.integers(0, 60, rng.integers(0, 25))) + (" vile word" if i % 4 == 0 else "") for i in range(160)]
    labels = [(i, int(i % 4 == 0)) for i in range(160)]
    model = toxicity.fit(docs(*enumerate(texts)), local_table(spark, labels, T.StructType.fromDDL("doc_id long, toxic int")), how=how)

    def cells(text):
        h = [xxhash.xxh64_intdigest(w) for w in (x.strip(".").encode() for x in text.lower().split())]
        pair = lambda a, b, k: (a * 0x9E3779B97F4A7C15 ^ (b + k) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
        shift = 64 - toxicity.BITS
        return {x >> shift for x in h}, {pair(a % (1 << 64), b, k) % (1 << 64) >> shift for k in (1, 2) for a, b in zip(h, h[k:])}

    order = [r[0] for r in spark.range(160).select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()]
    rows = [(*map(list, cells(texts[i])), labels[i][1]) for i in order]
    want = plain_ftrl(rows, how)
    bias = want.pop("bias", 0.0)
    got = dict(zip(model.cells.tolist(), model.weights.tolist()))
    assert got.pop(1 << toxicity.BITS, 0.0) == pytest.approx(bias, abs=1e-9)
    assert got == pytest.approx(want, abs=1e-9) and len(got) > 3
    for r in toxicity.score(docs(*enumerate(texts)), model).collect():
        words, pairs = cells(texts[r.doc_id])
        total = bias + sum(want.get(c, 0) for c in words) + how.pair_value * sum(want.get(c, 0) for c in pairs - words)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit(odd, local_table(spark, [], T.StructType.fromDDL("doc_id long, toxic int")))
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.5}


def test_toxicity_held_out_accuracy(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    scores = QUERIES["op4_toxicity"](spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df()
    both = scores[scores.held_out].merge(labels, on="doc_id")
    toxic, clean = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (clean >= 0.7).mean() < 0.01 and (toxic >= 0.7).mean() > 0.6


# --- language model ----------------------------------------------------------------------------


def plain_scores(rows, order, strength):
    counts, contexts = Counter(), Counter()
    for _, training, text in rows:
        ws = [lm.START, *words(text), lm.END]
        for i in range(1, len(ws) if training else 0):
            counts[(ws[i],)] += 1
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    counts[tuple(ws[i - n + 1 : i + 1])] += 1
                    contexts[tuple(ws[i - n + 1 : i])] += 1
    single = {k: v for k, v in counts.items() if len(k) == 1}
    tokens, distinct = sum(single.values()), len(single)
    out = []
    for doc, training, text in rows:
        ws = [lm.START, *words(text), lm.END]
        base = total = known = 0
        for i in range(1, len(ws)):
            p = (counts[(ws[i],)] + 0.5) / (tokens + 0.5 * (distinct + 1))
            base += math.log10(p)
            known += counts[(ws[i],)] > 0
            for n in range(2, order + 1):
                if i - n + 1 < 0 or not contexts[tuple(ws[i - n + 1 : i])]:
                    break
                k = strength[n - 2]
                p = (counts[tuple(ws[i - n + 1 : i + 1])] + k * p) / (contexts[tuple(ws[i - n + 1 : i])] + k)
            total += math.log10(p)
        out.append((doc, training, len(ws) - 1, known, tokens, base, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, docs, odd, order, monkeypatch):
    monkeypatch.setattr(lm.chunks_of, "__defaults__", (200,))
    rng = np.random.default_rng(order)
    rows = [(100 + i, " ".join(f"W{x}" for x in rng.zipf(1.6, 30) % 40)) for i in range(60)]
    table = odd.unionByName(docs(*rows)).repartition(3)
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    got, levels = lm.score(table, training, order=order, strength=(5.0, 2.0, 2.0))
    given = [(r[0], (r[0] or 0) % 3 != 1, r[1]) for r in [*ODD, *rows]]
    want = sorted(plain_scores(given, order, (5.0, 2.0, 2.0)), key=lambda r: (r[0] or -1, r[2], r[3]))
    found = sorted(map(tuple, got.collect()), key=lambda r: (r[0] or -1, r[2], r[3]))
    assert len(found) == len(want) and len(levels) == order
    for a, b in zip(found, want):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 * a[2] and abs(a[6] - b[6]) < 5e-4 * a[2]


def test_lm_of_words_never_seen(spark, docs, monkeypatch):
    """A chunk in which nothing can be asked backs off once, whatever the order."""
    monkeypatch.setattr(lm.chunks_of, "__defaults__", (12,))
    rows = [(i, f"a b c{i % 3} a") for i in range(0, 40, 2)] + [(1, "zzz"), (3, "yyy xxx"), (5, ""), (7, "a zzz b c1")]
    training = F.col("doc_id") % 2 == 0
    for order in (2, 3, 4):
        got = {r.doc_id: r.score for r in lm.score(docs(*rows), training, order=order, strength=(5.0, 2.0, 2.0))[0].collect()}
        for key, *_, want in plain_scores([(k, k % 2 == 0, t) for k, t in rows], order, (5.0, 2.0, 2.0)):
            assert got[key] == pytest.approx(want, abs=5e-3)


def test_lm_codes_of_any_size():
    logs = -np.concatenate([np.linspace(0, 30, 4000), np.geomspace(1e-3, 300, 500)])
    back = lm.dequantise(lm.quantise(logs))
    assert np.all(np.abs(back - logs) <= np.maximum(2e-4, -logs * 3e-4))
    assert np.array_equal(lm.quantise(lm.dequantise(np.arange(65_536))), np.arange(65_536))
    places = np.array([-1, 0, 0, 5, -1, 9, 9, 10**12, -1])
    assert np.array_equal(lm.places_of(lm.steps_of(places)), places) and len(lm.places_of(lm.steps_of(places[:0]))) == 0


def test_lm_hot_contexts_and_no_training(docs, empty):
    rows = [(i, "hot " + " hot ".join(f"x{j}" for j in range(i, i + 20))) for i in range(30)]
    training = F.col("doc_id") % 2 == 0
    usual = {r.doc_id: r.score for r in lm.score(docs(*rows), training)[0].collect()}
    contexts = np.array([3, 3, 3, 4], np.int64)
    spread = lm.shard_of(contexts, np.arange(4), np.array([100, 100, 100, 1]), 64, hot=10)
    assert len(set(spread[:3].tolist())) > 1
    assert {r.doc_id: r.score for r in lm.score(docs(*rows), training, hot=5)[0].collect()} == usual
    none = lm.score(docs(*rows), F.lit(False))[0].collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert lm.score(empty, training)[0].count() == 0


def test_lm_beats_single_tokens_on_held_out(spark):
    rows = QUERIES["op3_lm_scores"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_lm_query_has_contexts_of_two_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    want = {r.doc_id: r.score for r in lm.score(docs, training, order=3)[0].collect()}
    got = {r.doc_id: r.score for r in QUERIES["op3_lm_scores"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1), (1, 2**61), (7, 7), (900, 300), (900, 2**40), (5000, 2**16), (900, 2**62)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n).astype(np.uint64))
    held = EliasFano.of(unbundle(bundle(*EliasFano.parts(values))))
    assert (held.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 100).astype(np.uint64)])
    at = np.searchsorted(values, asked)
    want = [int(i) if i < n and values[i] == x else -1 for i, x in zip(at, asked)]
    assert held.find(asked).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 900])
def test_a_level_looks_up_a_context_once(n, monkeypatch):
    rng = np.random.default_rng(n)
    contexts, words = np.arange(0, 3 * n, 3), np.sort(rng.integers(0, 1000, (n, 4)), axis=1)
    codes = np.arange(4 * n).astype(np.uint16)
    level = lm.Level(lm.Level.arrays(contexts.astype(np.uint64), np.full(n, 4), words.ravel(), codes, codes[:n]))
    sizes, find = [], EliasFano.find
    monkeypatch.setattr(EliasFano, "find", lambda self, values: sizes.append(len(values)) or find(self, values))
    rank, at = level.find(np.repeat(contexts, 4).astype(np.uint64), words.ravel())
    assert rank.tolist() == np.repeat(np.arange(n), 4).tolist()
    assert (words.ravel()[at] == words.ravel()).all() and (at // 4 == rank).all()
    assert sizes == [n, 4 * n]


def test_many_bits_are_selected_in_one_pass():
    words = np.random.default_rng(3).integers(0, 1 << 62, 50).astype(np.uint64)
    bits = Bits(words)
    for one in (False, True):
        all_of = np.arange(bits.before[one][-1])
        assert bits.select(all_of, one).tolist() == [int(bits.select(np.array([i]), one)[0]) for i in all_of]


# --- token ids ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 700, n).astype(np.uint32)
    matrix = Matrix.from_bytes(Matrix.build(ids).to_bytes())
    assert matrix.size == n and (matrix.all() == ids).all() and (matrix.access(np.arange(n)) == ids).all()
    for token in (0, 5, 699, 1023, 1024, 1 << 30):
        assert matrix.count(token) == (ids == token).sum()
        assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()


def whole_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_wavelet_shards(spark, docs, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet.shards_of, "__defaults__", (2000,))
    tricky = ["don't We'LL they're_ok x's 's", "A\u030a J\u030c I\u0307 =\u0338", "<|endoftext|> <|startoftext|>", "a.b,c!! 12 3.4% ...", "naïve, œuvre; straße!"]
    table = odd.unionByName(docs(*[(20 + i, t) for i, t in enumerate(tricky)]))
    path = str(tmp_path / "shards")
    wavelet.write(table, path, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(wavelet.digests(wavelet.read(spark, path)).collect(), key=lambda r: r.start)
    rows = [*ODD, *[(20 + i, t) for i, t in enumerate(tricky)]]
    # Rows of one identifier may come in either order.
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda k: -1 if k is None else k)
    want = Counter((k, len(i := whole_ids(t)), zlib.crc32(np.array(i, "<u4").tobytes())) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted(wavelet.read(spark, path).collect(), key=lambda r: r.start)])
    token = int(np.bincount(ids).argmax())
    assert wavelet.count(spark, path, token).first().n == (ids == token).sum()
    assert sorted(r.position for r in wavelet.occurrences(spark, path, 1).collect()) == np.flatnonzero(ids == 1).tolist()
    none = str(tmp_path / "none")
    wavelet.write(empty, none, public_tokenizers.path("word_bpe_49k.json"))
    assert wavelet.read(spark, none).count() == 0


def test_wavelet_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in sorted(QUERIES["op7_wavelet_tokens"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = whole_ids(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_wavelet_query_takes_added_tokens_as_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b, don't", "<|ENDOFTEXT|> É <|endoftext|", "", "plain words", "<|endoftext|>" * 3]
    docs(*enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    for r in sorted(QUERIES["op7_wavelet_tokens"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert at > 0


def test_words_give_the_ids_of_the_library_on_random_texts():
    """Latin letters, combining marks, white space, signs and strings like added tokens, in any order."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), wavelet.Words(path, added=True)
    rng = np.random.default_rng(17)
    odd = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x370), 0x1E9E, 0x212A, 0x212B, 0x2126, 0x3A3, 0x3C2, 0xFB01, 0x4E2D, 0x1F600]]
    common = [*"abcxyz019.,!?-' ", "'s", "'ll", "n't", "i\u0307", "<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    pick = lambda: "".join(rng.choice(odd if rng.random() < 0.4 else common) for _ in range(rng.integers(0, 14)))
    texts = [pick() for _ in range(6000)] + ["1\u0130.", "a\u0130! b\u0130", "\u0130\u0130..x"]
    ids, lengths = words.encode([t.encode() for t in texts])
    ends = np.cumsum(lengths)
    for text, start, end in zip(texts, (ends - lengths).tolist(), ends.tolist()):
        assert ids[start:end].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def whole_bpe():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_bpe_pieces(size):
    plain = whole_bpe()
    texts = ["", " ", "a  b   c\n\n d 's don't\u00a0x \u2003y\x1cz", "x" * 100, " \n \n ", "word " * 50, "été  😀 \x85 中文 12 3"]
    for text in texts:
        assert "".join(bpe.pieces(text, size)) == text
        assert bpe.encode_text(text, RANKS, PATTERN, size).tolist() == plain.encode_ordinary(text)


def test_bpe_round_trip(spark, odd, empty):
    plain = whole_bpe()
    decoded = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(decoded).collect())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for k, t, *_ in ODD:
        ids = plain.encode_ordinary(t or "")
        want[(k, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode()))] += 1
    assert got == want
    # Half a character is kept as bytes.
    cut = local_table(spark, [(1, [plain.encode_ordinary("😀")[0]]), (2, None)], T.StructType.fromDDL("doc_id long, ids array<int>"))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(cut, RANKS, PATTERN).collect()}
    assert back[1] == plain.decode_bytes(plain.encode_ordinary("😀")[:1]) and back[2] == b""
    assert bpe.digests(bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS, PATTERN)).count() == 0
