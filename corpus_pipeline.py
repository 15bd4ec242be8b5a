"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written and read again as the next one's
docs. All but the last return the columns of ``documents``; packing returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramspark.llm import decontamination, packing, quality_classifier, secret_scan, simhash
from paramspark.llm.common import materialize

#: Documents that score under this go.
REJECT_UNDER = 0.5
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the rows of ``labels`` that are not held out, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.learn_from(docs, labels), least=REJECT_UNDER)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.
    Candidates agree in a block of their SimHash fingerprints and are near by Hamming distance; an exact comparison follows."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of eight words of any benchmark item."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows in the sources' proportions."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good),
    ("simhash_near_dedup", unlike),
    ("decontamination", unleaked),
    ("secret_scan", redacted),
    ("packing", packed),
]
#: Classifier, SimHash groups, decoding worklist and tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
