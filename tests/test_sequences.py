"""Every key is windowed in bins; the outcome is that of one plain window per key."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgemart.operators.quality import check_k9
from forgemart.operators.sequences import previous_row, row_numbers, running_total
from forgemart.plans.analyses import queue_time
from forgemart.sources import binding
from forgemart.sources.binding import BoundMart


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of the rows; one row in ten has no key."""
    key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 97
    )
    return spark.range(3000).select(
        key.cast("bigint").alias("k"),
        (F.col("id") * 7919 % 3001).alias("seq"),
        (F.col("id") % 13).alias("v"),
    )


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def known(value):
    return F.when(F.col("k").isNotNull(), value)


@pytest.mark.parametrize("size", [10, 100, 10_000])
def test_row_numbers(events, size):
    got = row_numbers(events, "k", ["seq"], F.floor(F.col("seq") / size), "n")
    plain = known(F.row_number().over(W.partitionBy("k").orderBy("seq")))
    assert as_set(got) == as_set(events.withColumn("n", plain))


@pytest.mark.parametrize("size", [10, 50, 10_000])
def test_running_total(events, size):
    got = running_total(events, "k", "seq", F.floor(F.col("seq") / size), "v", "t")
    before = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    plain = known(F.coalesce(F.sum("v").over(before), F.lit(0)))
    assert as_set(got) == as_set(events.withColumn("t", plain))


@pytest.mark.parametrize("size", [10, 50, 10_000])
def test_previous_row(events, size):
    got = previous_row(events, "k", "seq", F.floor(F.col("seq") / size), ["v"], "p")
    lag = known(F.lag(F.struct("v")).over(W.partitionBy("k").orderBy("seq")))
    assert as_set(got) == as_set(events.withColumn("p", lag))


def test_rows_of_a_key_are_spread(spark):
    """1,500 frequent keys, and half of all rows without a key: no task holds much of either."""
    key = F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 3000)
    rows = spark.range(300_000).select(key.alias("k"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = row_numbers(rows, "k", ["seq"], F.floor(F.col("seq") / 30_000), "n")
        sizes = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.max("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) == 64
    assert max(r["rows"] for r in sizes) < 1.5 * 300_000 / 64


def test_same_plan_at_every_size(spark, data):
    def shape(root: str) -> list[str]:
        plan = BoundMart(spark, root).table("COOIS_OrderOperations")._jdf.queryExecution()
        lines = plan.optimizedPlan().toString().split("\n")
        return [line.strip(" :+-").split(" ")[0] for line in lines]

    assert shape(data) == shape(data.replace("0.001", "0.1"))


def test_bound_numbering_agrees(spark, data, monkeypatch):
    plain = as_set(BoundMart(spark, data).numbered_lines())
    monkeypatch.setattr(binding, "LINES_PER_BIN", 2)
    assert as_set(BoundMart(spark, data).numbered_lines()) == plain


def test_rows_without_an_order_are_in_no_sequence(spark):
    kind = "`Order` string, Operation string, StatusShort string, StartDate date, FinishDate date"
    rows = [(None, "0010", "REL", None, None), (None, "0020", "CNF", None, None)]
    operations = spark.createDataFrame(rows, kind)
    assert check_k9(operations).isEmpty()
    kind = "`Order` string, Operation string, ActualEnd timestamp, ActualMachineTime double"
    assert queue_time(operations, spark.createDataFrame([], kind)).isEmpty()
