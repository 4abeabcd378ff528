"""Cleaning a training corpus: five operators, each stage written and read back before the next one starts.

A stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last return the columns
of ``documents``; their decisions take effect:

* quality rules drop documents that fail the base rules or are outliers of their language and source;
* n-gram Jaccard join keeps one document of each group of near copies (five words, similarity of 0.8 or more), that with
  the smallest id; documents without words are linked with nothing and stay;
* substring dedup cuts words covered by a window of 13 that also starts in a document with a smaller id; rows stay;
* decontamination drops documents of which a twentieth or more lies in passages of the benchmark;
* byte-level BPE returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every remaining text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov.llm import bpe, decontaminate, jaccard, quality, substrings
from basecov.session import scratch_path

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80

#: Some stages cannot be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs, length=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
