"""A third of all facts on one key: joins split it, and no stage shuffles it unsummed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forgemart.functions.measures import measure
from forgemart.operators.joins import with_component
from forgemart.operators.relations import join_edge
from forgemart.operators.skew import lookup
from forgemart.plans.evaluate import evaluate
from forgemart.sources.binding import BoundMart
from forgemart.sources.mart import FrameMart

SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
}


@pytest.fixture
def no_broadcast(spark):
    for key, value in SMALL_SKEW.items():
        spark.conf.set(key, value)
    yield
    for key in SMALL_SKEW:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def skewed(spark):
    order = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 5000))
    operations = spark.range(0, 120_000, 1, 8).select(
        order.alias("Order"),
        F.sha2(F.col("id").cast("string"), 256).alias("OperationText"),
        (F.col("id") % 7).alias("BottleneckOperation"),
    )
    key = F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") - 1))
    headers = spark.range(5001).select(key.alias("Order"), F.lit("REL").alias("StatusShort"))
    return FrameMart({"COOIS_OrderOperations": operations, "COOIS_OrderHeaders": headers})


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_row_join_splits_the_key(skewed, no_broadcast):
    joined = join_edge(skewed, "J7", ["OperationText"], ["StatusShort"])
    assert "SortMergeJoin(skew=true)" in executed(joined)
    assert joined.count() == 120_000


def test_measure_sums_before_the_join(skewed, no_broadcast):
    result = evaluate(skewed, [measure("Operation Count")], ["COOIS_OrderHeaders.StatusShort"])
    plan = executed(result)
    assert "skew=true" not in plan and "partial_sum(operation_count" in plan
    assert result.first()["operation_count"] == 120_000


def test_lookup_of_sums_splits_the_key(skewed, no_broadcast):
    """Also where the one side is an aggregate by the same key."""
    operations = skewed.table("COOIS_OrderOperations")
    counts = operations.groupBy(F.col("Order").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(operations, counts, "Order", "o")
    assert "SortMergeJoin(skew=true)" in executed(joined)
    plain = operations.join(counts, F.col("Order") == F.col("o"), "left")
    assert joined.exceptAll(plain).count() == 0 and joined.count() == 120_000


def test_lookup_spreads_rows_without_a_key(spark, no_broadcast):
    rows = spark.range(0, 60_000, 1, 4).select(
        F.when(F.col("id") % 2 == 1, F.col("id")).alias("k"), F.col("id").alias("v")
    )
    ones = spark.range(0, 60_000, 3, 4).select(F.col("id").alias("o"), F.lit("x").alias("n"))
    joined = lookup(rows, ones, "k", "o")
    plain = rows.join(ones, F.col("k") == F.col("o"), "left")
    assert joined.exceptAll(plain).count() == 0 and joined.count() == 60_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = joined.groupBy(F.spark_partition_id().alias("p"))
        sizes = counts.agg(F.count("*").alias("rows"), F.count("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["rows"] for r in sizes) < 1.3 * 60_000 / len(sizes)


def test_components_meet_both_masters(spark, data):
    mart = BoundMart(spark, data)
    co24 = mart.table("CO24", "Order", "Component", "ShortageQuantity")
    masters = mart.table("MARA", "MATNR", "MTART"), mart.table("D_Part", "MATNR", "ABC_Class")
    found = with_component(co24, *masters)
    assert found.count() == co24.count()
    assert found.where("MTART is null or ABC_Class is null").isEmpty()
