"""From raw documents to token ids: quality, copies, near copies, source mix, byte-level BPE.

Every stage reads the whole table that the stage before it wrote. All but the last return the columns
of ``documents``; the mix may take a document twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm import bpe, exact, mixing, quality, simhash
from quadweave.llm.common import table
from quadweave.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; null and empty texts go."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality.judge(docs, quality.weights(docs, trusted)).filter("kept")
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z and a-z, the one with the largest identifier."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five-word shingles join, the smallest identifier."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, sources weighing 5, 2, 1 in turn."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of the bytes they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near-duplicates", near_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Hashed n-gram ratios, fingerprints and BPE ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
