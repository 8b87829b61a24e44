"""A training corpus from raw documents, in four stages.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: of each group of documents that are linked by similar five-word shingles, that with the smallest doc_id stays.
3. decontaminate: documents that hold a window of a benchmark item go.
4. encode: ids and round trip of what is left, as digests.

Each stage gets what its predecessor wrote, as Parquet, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailweir.llm import bpe, decontaminate, jaccard, quality
from mailweir.llm.common import read_table, stored


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, bpe.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("encode", encode_texts),
]

#: Compression and byte-pair merges aren't SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
