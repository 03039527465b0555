from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from forgemart.operators import quality
from forgemart.sources import schema as S
from forgemart.sources import storage
from forgemart.sources.binding import AS_OF, BoundMart
from forgemart.sources.mart import CatalogMart, FrameMart, StoredMart, store

DATA = os.environ.get("FORGEMART_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def bound(spark, data):
    return BoundMart(spark, data)


@pytest.fixture(scope="module")
def stored(spark, bound):
    root = storage.new_root(spark)
    store(bound, root)
    return StoredMart(spark, root)


def test_schema_size():
    assert len(S.TABLES) == 17
    assert sum(len(S.column_names(t)) for t in S.TABLES) == 142
    assert sum(len(S.summable_columns(t)) for t in S.TABLES) == 41


def test_round_trip(spark, bound, stored):
    assert storage.validate(spark, {t: stored.table(t) for t in S.TABLES}).count() == 0
    for t in ("COOIS_OrderOperations", "CO24", "MARD"):
        assert stored.table(t).exceptAll(bound.table(t)).count() == 0


def test_stored_scans_prune_and_push(stored):
    df = stored.table("CO24", "Order", "MissingPart").where(F.col("MissingPart") == 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(MissingPart,1)" in plan
    assert "ReadSchema: struct<Order:string,MissingPart:int>" in plan


def test_conform_truncates_and_keeps_null(spark):
    loose = spark.createDataFrame([("-1.9", None)], "Level string, Parent string").select(
        F.lit("a").alias("ProductHierarchy"),
        F.lit(None).alias("Description"),
        F.col("Level").cast("double").alias("Level"),
        "Parent",
    )
    row = storage.conform(loose, "ProductHierarchy").first()
    assert tuple(row) == ("a", None, -1, None)


def test_run_log(spark):
    assert storage.run_log(spark, []).first()[0] == "none"
    long = "Traceback " + "x" * 6000 + " the cause"
    assert storage.run_log(spark, [("s", "ok", long)]).first()["detail"] == long
    assert storage.run_log(spark, [("s", "ok", long)], most=9).first()["detail"] == "the cause"
    root = storage.new_root(spark)

    def fail():
        raise RuntimeError("broken step")

    with pytest.raises(RuntimeError):
        storage.run_steps(spark, root, [("one", lambda: 1), ("two", fail), ("three", fail)])
    log = spark.read.parquet(storage.path_of(root, "run_log")).collect()
    assert {(r["step"], r["status"]) for r in log} == {("one", "ok"), ("two", "error")}
    assert any("broken step" in r["detail"] for r in log)


def test_dropped_column_is_reported(spark, bound):
    root = storage.new_root(spark)
    storage.save(bound.table("MARA").drop("MTART"), root, "MARA")
    storage.save(bound.table("MARC").withColumn("DZEIT", F.lit("3")), root, "MARC")
    for table, column in (("MARA", "MTART"), ("MARC", "DZEIT")):
        with pytest.raises(ValueError, match=column):
            storage.load(spark, root, table)
    found = storage.validate(spark, storage.stored_tables(spark, root), ["MARA", "MARC", "MARD"])
    assert {tuple(r) for r in found.collect()} == {
        ("MARA", "MTART", "string", "missing"),
        ("MARC", "DZEIT", "int", "string"),
        ("MARD", None, "table", "missing"),
    }


def test_nothing_is_left_behind(tmp_path):
    """A driver's folders go when it ends."""
    code = (
        "from forgemart.session import local_session; from forgemart.registry import QUERIES;"
        "s = local_session(2);"
        "[QUERIES[q](s, %r).count() for q in ('s04_overwrite', 'j22_hierarchy')]; s.stop()"
    ) % DATA
    options = {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=repo, env=os.environ | options, check=True, timeout=300)
    assert not list(tmp_path.glob("mart-*"))


def test_work_dir_follows_the_session(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(key, default=None):
            return "/shared/folder/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf

    assert storage.work_dir(Session) == "/shared/folder"


def test_valid_mart_has_no_violations(stored):
    t = stored.table
    assert quality.check_k1(t("CO24")).isEmpty()
    assert quality.check_k2(t("COOIS_Confirmations")).isEmpty()
    assert quality.check_k3(t("COOIS_OrderHeaders"), AS_OF).isEmpty()
    assert quality.check_k4(t("COOIS_OrderHeaders")).isEmpty()
    assert quality.check_k5(t("COOIS_OrderHeaders")).isEmpty()
    assert quality.check_k6(t("WorkCenters")).isEmpty()
    assert quality.check_k7(t("SOP_Targets")).isEmpty()
    assert quality.check_k8(t("COOIS_OrderHeaders")).isEmpty()
    assert quality.check_k10(t("COOIS_OrderOperations"), t("COOIS_Confirmations")).isEmpty()
    assert quality.check_k11(stored).isEmpty()
    assert quality.check_k12(t("MARD"), t("tmp_PartStockV1")).isEmpty()


def test_frames_and_files_agree(spark, stored):
    from forgemart.plans.analyses import bottleneck_board

    frames = FrameMart({t: stored.table(t) for t in S.TABLES})
    assert bottleneck_board(frames).exceptAll(bottleneck_board(stored)).count() == 0


def test_catalog_tables(spark, bound):
    root = storage.new_root(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS plant LOCATION '{root}/db'")
    storage.save_table(bound.table("MARC"), "plant", "MARA", root)
    storage.save_table(bound.table("MARA"), "plant", "MARA", root)
    held = CatalogMart(spark, "plant").table("MARA")
    assert held.columns == S.column_names("MARA")
    assert held.exceptAll(bound.table("MARA")).count() == 0
    assert storage.refresh_table(spark, "plant", "MARA").count() == held.count()
    spark.sql("DROP DATABASE plant CASCADE")


def test_delta_only_with_its_extension(spark):
    assert storage.table_format(spark) == "parquet"
