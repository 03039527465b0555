"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgemart.llm import (
    decontaminate,
    embeddings,
    html_text,
    line_dedup,
    mixing,
    pii,
    quality,
    repeats,
    simhash,
    spelling,
    token_counts,
    token_store,
    whitening,
)
from forgemart.llm.oracle import ORACLE  # noqa: F401  served with QUERIES
from forgemart.llm.scratch import scratch_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, folder, "embeddings"), cosine=0.98)


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, folder, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(_table(spark, folder, "documents"), model, limit=4096)


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, folder, "pages"))


def op7_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_folder(spark)
    model = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_tokens(_table(spark, folder, "documents"), model, place, end=2)
    found = token_store.read_tokens(spark, place, lambda ids: zlib.crc32(ids.tobytes()), "long")
    return found.withColumnRenamed("value", "ids_crc32")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    found = decontaminate.find_overlaps(docs, benchmark, window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_counts(_table(spark, folder, "documents"), weights=(1.0, 2.0, 3.0), repeats=3)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, folder, "documents"), min_chars=2, copies_from=1)
    return found.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts are of the base spans."""
    found = pii.personal_data(_table(spark, folder, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.base)
    return found.select(
        "doc_id", *map(of, pii.KINDS), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, folder, "documents"), typo_every=199, least_chars=6, least_count=5, ratio=5)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"), components=4, scale=256.0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_embedding_near_dedup,
        op3_suffix_array_dedup,
        op4_quality_classifier,
        op5_token_counts,
        op6_html_extraction,
        op7_token_binary,
        op8_decontamination,
        op9_mixing,
        op10_line_dedup,
        op11_pii,
        op12_spelling_variants,
        op13_embedding_whitening,
    )
}
