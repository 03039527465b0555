from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forgemart.functions.measures import MEASURES, measure
from forgemart.operators.relations import widen
from forgemart.plans.evaluate import evaluate
from forgemart.registry import QUERIES
from forgemart.sources.binding import BoundMart


@pytest.fixture(scope="module")
def mart(spark, data):
    return BoundMart(spark, data)


ADDITIVE = ["Order Count", "Total Yield", "Missing Part Count", "Total Shortage Quantity"]


@pytest.mark.parametrize("name", ADDITIVE)
def test_groups_add_up_to_the_total(mart, name):
    m = measure(name)
    groups = evaluate(mart, [m], ["ProductGroup.ProductGroup"]).agg(F.sum(m.alias)).first()[0]
    assert groups == pytest.approx(evaluate(mart, [m]).first()[0])


def test_stepwise_sums_equal_joining_first(mart):
    names = ["Total Yield", "Scrap Rate", "Avg Posting Delay Hours"]
    measures = [measure(n) for n in names]
    columns = ["YieldQuantity", "ScrapQuantity", "DelayHours"]
    wide = widen(mart, "COOIS_Confirmations", columns, ["MARA.MTART", "WorkCenters.WERKS"])
    joined = wide.groupBy("`MARA.MTART`", "`WorkCenters.WERKS`").agg(*[m.column() for m in measures])
    stepwise = evaluate(mart, measures, ["MARA.MTART", "WorkCenters.WERKS"])
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(
        map(tuple, stepwise.collect()), key=str
    )


def test_drill_across_equals_single_facts(mart):
    measures = list(MEASURES.values())
    by = ["ProductGroup.ProductGroup"]
    across = {r["ProductGroup"]: r for r in evaluate(mart, measures, by).collect()}
    for m in measures:
        for r in evaluate(mart, [m], by).collect():
            assert across[r["ProductGroup"]][m.alias] == r[m.alias]


def test_filter_first_or_in_the_measure(mart):
    m = measure("Total Order Quantity")
    inside = m.where(lambda: F.col("Priority") == 1, ["Priority"]).named("inside")
    outside = evaluate(mart, [m], [], {"COOIS_OrderHeaders.Priority": lambda c: c == 1})
    assert evaluate(mart, [inside]).first()[0] == outside.first()[0]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


FORBIDDEN = ("CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")
WRITING = {"s01_scan", "s04_overwrite", "s05_row_counts", "s06_run_log", "s07_refresh"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_plans_stay_in_the_engine(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert not [node for node in FORBIDDEN if node in plan]


def test_measures_of_a_fact_share_one_scan(spark, mart):
    names = ["Order Count", "Released Order Load", "Backlog Order Count"]
    plan = plan_of(evaluate(mart, [measure(n) for n in names], ["COOIS_OrderHeaders.StatusShort"]))
    assert plan.count("FileScan") == 1


def test_counting_orders_reads_one_table(spark, data):
    plan = plan_of(QUERIES["q1_released_and_backlog"](spark, data))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_sums_precede_joins(spark, data):
    """Without broadcasts, every shuffle of a fact carries partial sums."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["m09_scrap"](spark, data))
        scan = plan.index("l_discount")
        assert plan.index("partial_sum") < scan
        assert plan.rindex("Exchange", 0, scan) < plan.rindex("partial_sum", 0, scan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_meet_one_dimension_map(spark, data):
    """Without broadcasts, raw rows are shuffled once, by the first key; and several facts share the
    map from orders to the wanted columns, whose shuffle is reused."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["i04_measure_by_dims"](spark, data))
        assert plan.count("hashpartitioning(COOIS_Confirmations.Order") == 1
        center = plan.index("Exchange hashpartitioning(COOIS_Confirmations.WorkCenter")
        assert center < plan.index("partial_sum(total_yield#0", center)
        df = QUERIES["i05_drill_across"](spark, data)
        df.collect()
        final = plan_of(df).split("Initial Plan")[0]
        assert final.count("lineitem.parquet") <= 4
        assert "ReusedExchange" in final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_lookups_read_few_columns(spark, data):
    plan = plan_of(BoundMart(spark, data).table("COOIS_OrderHeaders", "Order", "Material"))
    read = [line.split("ReadSchema: struct<")[1] for line in plan.split("\n") if "orders.parquet" in line]
    assert [sorted(c.split(":")[0] for c in r.rstrip(">").split(",")) for r in read] == [["o_custkey", "o_orderkey"]]
