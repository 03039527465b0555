"""Stored layouts: what plans and readers see, not only what rows come out."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from forgemart.functions.measures import measure
from forgemart.operators.relations import join_edge
from forgemart.plans.evaluate import evaluate
from forgemart.sources import layout, storage
from forgemart.sources.binding import BoundMart
from forgemart.sources.mart import CatalogMart

HEADERS, CONFIRMATIONS = "COOIS_OrderHeaders", "COOIS_Confirmations"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bound(spark, data):
    return BoundMart(spark, data)


@pytest.fixture(scope="module")
def bucketed(spark, bound):
    database = layout.new_database(spark)
    layout.store_by_order(bound, database, 4)
    return CatalogMart(spark, database)


@pytest.mark.parametrize("name", ["J7", "J9", "J11", "J12"])
def test_joins_by_order_need_no_exchange(spark, bound, bucketed, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_edge(bucketed, name, one=["StatusShort"])
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        plain = join_edge(bound, name, one=["StatusShort"])
        assert "Exchange" in plan(plain)
        assert sorted(joined.collect(), key=repr) == sorted(plain.collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sums_by_order_need_no_exchange(bucketed):
    assert "Exchange" not in plan(bucketed.table(CONFIRMATIONS).groupBy("Order").agg(F.max("ActualEnd")))


def test_measures_over_buckets(bound, bucketed):
    wanted = [measure("Order Count"), measure("Scrap Rate"), measure("Missing Part Count")]
    by = ["COOIS_OrderHeaders.StatusShort"]
    a, b = (sorted(map(tuple, evaluate(m, wanted, by).collect()), key=repr) for m in (bound, bucketed))
    assert a == b and a


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_one_month_is_replaced(spark, bound, tmp_path):
    rows = layout.with_period(bound.table(CONFIRMATIONS, "Order", "ActualEnd", "YieldQuantity"), "ActualEnd")
    layout.save_partitioned(rows, str(tmp_path), CONFIRMATIONS)
    stored = layout.load_partitioned(spark, str(tmp_path), CONFIRMATIONS)
    assert dict(stored.dtypes)["Period"] == "string"
    months = sorted(r.Period for r in stored.select("Period").distinct().collect())
    place = storage.path_of(str(tmp_path), CONFIRMATIONS)
    before = files(place)
    one = stored.where(F.col("Period") == months[3]).limit(2).collect()
    layout.replace_partitions(spark.createDataFrame(one, stored.schema), str(tmp_path), CONFIRMATIONS)
    after = files(place)
    changed = {f for f in before ^ after}
    assert changed and all(f"Period={months[3]}" in f for f in changed)
    again = layout.load_partitioned(spark, str(tmp_path), CONFIRMATIONS)
    assert again.count() == rows.where(F.col("Period") != months[3]).count() + 2


def test_dimension_filters_prune_partitions(spark, bound, tmp_path):
    rows = layout.with_period(bound.table(CONFIRMATIONS, "Order", "ActualEnd"), "ActualEnd")
    layout.save_partitioned(rows, str(tmp_path), CONFIRMATIONS)
    stored = layout.load_partitioned(spark, str(tmp_path), CONFIRMATIONS)
    months = spark.createDataFrame([("199503", 1), ("199504", 1), ("199601", 2)], "Period string, term int")
    read = stored.join(months.where("term = 1"), "Period")
    assert "dynamicpruning" in plan(read)
    assert read.count() == rows.where(F.col("Period").isin("199503", "199504")).count()


def test_readers_do_not_notice_a_swap(spark):
    database = layout.new_database(spark)
    layout.swap_table(spark.range(1000).withColumnRenamed("id", "n"), database, "MARA")
    reader = storage.load_table(spark, database, "MARA")
    rows = reader.repartition(4).toLocalIterator()
    next(rows)
    layout.swap_table(spark.range(5).withColumnRenamed("id", "n"), database, "MARA")
    assert sum(1 for _ in rows) == 999
    assert reader.count() == 1000  # made before the swap, read after it
    assert storage.load_table(spark, database, "MARA").count() == 5
    with pytest.raises(ValueError, match="other columns"):
        layout.swap_table(spark.range(5), database, "MARA")


def test_checks_fail_before_the_table_changes(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "Part string, Stock double")
    negative = layout.Check("negative", F.col("Stock") < 0, limit=0)
    odd = layout.Check("missing", F.col("Part").isNull())
    assert layout.save_checked(good, root, "Stock", [negative, odd]) == {"rows": 2, "negative": 0, "missing": 0}
    bad = good.union(spark.createDataFrame([(None, -1.0)], good.schema))
    with pytest.raises(layout.CheckFailed, match="negative"):
        layout.save_checked(bad, root, "Stock", [negative, odd])
    stored = spark.read.parquet(storage.path_of(root, "Stock"))
    assert stored.count() == 2
    found = layout.save_checked(bad, root, "Stock", [odd])
    assert found == {"rows": 3, "missing": 1}
    assert spark.read.parquet(storage.path_of(root, "Stock")).count() == 3
    empty = layout.save_checked(good.where("false"), root, "Stock", [negative])
    assert empty == {"rows": 0, "negative": 0}
