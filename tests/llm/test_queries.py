"""The registered queries on test tables: against SQL, and the pipeline against its parts."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from forgemart.llm import decontaminate, quality
from forgemart.llm.oracle import ORACLE
from forgemart.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    result = connection.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, data).select(columns).collect())


def test_pipeline_stages(spark, data, tmp_path):
    docs = source = spark.read.parquet(f"{data}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs)
        if i < 4:
            assert docs.dtypes == source.dtypes
    good, single, clean, mixed, ids = kept
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rejected = quality.classify(source, labels).where("predicted = 0").select("doc_id")
    assert good.count() == source.join(rejected, "doc_id", "left_anti").count()
    assert single.count() == single.select("doc_id").distinct().count() <= good.count()
    assert clean.count() == single.count()
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontaminate.find_overlaps(clean, benchmark).where("size(spans) > 0").count() == 0
    count = F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    before, after = clean.agg(count).first()[0], mixed.agg(count).first()[0]
    assert abs(after - before) < 0.02 * before
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for row in mixed.collect():
        array = np.array([*library.encode(row.text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((row.doc_id, len(array), zlib.crc32(array.tobytes())))
    assert sorted(expected) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in ids.collect())
    assert corpus_pipeline.run(spark, data).count() == mixed.count()
