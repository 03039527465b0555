"""A training corpus from `documents`, as stages that each read what the one before wrote."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forgemart.llm import decontaminate, mixing, quality, simhash, token_store
from forgemart.llm.scratch import saved, scratch_folder

END = 2  # the id behind each document


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from `labels` and the words of all
    documents, as op4 does."""
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return simhash.keep_first(docs, shingle=4, radius=4)


def remove_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the passages that they share with `benchmark`."""
    return decontaminate.remove_overlaps(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of sources at their weights: a row for each pass over a document's words."""
    return mixing.mixed_texts(docs, weights=(1.0, 2.0, 3.0), repeats=3)


def write_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Writes token ids and reads them back: doc_id, start, n_tokens, ids_crc32 of every row."""
    place = scratch_folder(spark)
    token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), place, end=END)
    found = token_store.read_tokens(spark, place, lambda ids: zlib.crc32(ids.tobytes()), "long")
    return found.withColumnRenamed("value", "ids_crc32")


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("token_binary", write_ids),
]

#: Training and compression have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
