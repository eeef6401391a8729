"""The registered queries of the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm import bpe, clusters, exact, lm, merkle, mixing, oracles, quality, shards, simhash, topk, toxicity, urls, wavelet
from quadweave.llm.common import table
from quadweave.schema import local_table
from quadweave.session import owned, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op1_url_rules",
    """
    WITH rules(r_host, r_path, r_verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    cut AS (
      SELECT page_id, url,
        CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
      FROM pages),
    part AS (
      SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw_host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut),
    site AS (
      SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM part),
    best AS (
      SELECT host, path, max({'n': length(r_host || r_path), 'rule': r_host || r_path, 'verdict': r_verdict}) AS b
      FROM (SELECT DISTINCT host, path FROM site), rules
      WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY host, path)
    SELECT page_id, site.host AS host, site.path AS path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
    FROM site LEFT JOIN best ON site.host = best.host AND site.path = best.path
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = local_table(spark, RULES, T.StructType.fromDDL("host string, path string, verdict string"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op2_simhash_classes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    scored, _ = lm.score(docs, ~held_out, order=3, keep=False)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query("op5_quality_ratio")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality.judge(docs, quality.weights(docs, trusted)).select(*names)


@query(
    "op6_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
      FROM documents),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS r,
        max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
      FROM d)
    SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM ranked
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


@query("op7_wavelet_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    owned(path)
    wavelet.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), added=True)
    return wavelet.digests(wavelet.read(spark, path))


@query("op8_lpt_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), 24)


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern))


@query("op11_ns_bounds_clusters", oracles.kmeans(40, 5, 64))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, centroids, _ = clusters.kmeans(table(spark, sf_dir, "embeddings"))
    return clusters.report(labels, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op12_merkle_manifest", oracles.manifest(8, 8, 3))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), touched)
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query("op13_exact_topk", oracles.TOPK)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))
