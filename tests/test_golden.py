from __future__ import annotations

import pytest
from golden import AS_OF, golden_mart
from pyspark.sql import functions as F

from forgemart.functions import derivations as D
from forgemart.functions.measures import MEASURES, Measure, measure
from forgemart.operators import joins, quality
from forgemart.operators.joins import ancestors
from forgemart.operators.relations import EDGES, orphans, path, widen
from forgemart.operators.totals import implicit_sum
from forgemart.plans import analyses as A
from forgemart.plans.evaluate import evaluate
from forgemart.registry import QUERIES
from forgemart.sources.binding import BoundMart


@pytest.fixture(scope="module")
def mart(spark):
    return golden_mart(spark)


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


TOTALS = {
    "Order Count": 6,
    "Released Order Load": 5,
    "Backlog Order Count": 2,
    "Total Order Quantity": 94.0,
    "Total Delivered Quantity": 55.0,
    "Operation Count": 8,
    "Bottleneck Operation Count (Laser Balancing)": 4,
    "Total Yield": 108.0,
    "Total Scrap": 6.0,
    "Total Rework": 3.0,
    "Scrap Rate": 6 / 108,
    "Avg Posting Delay Hours": 6.875,
    "Missing Part Count": 3,
    "Total Shortage Quantity": 10.0,
    "Total Target Quantity": 180.0,
    "Total SOP Actual Quantity": 150.0,
    "SOP Deviation": -30.0,
}


def test_all_totals_in_one_evaluation(mart):
    assert set(TOTALS) == set(MEASURES)
    result = evaluate(mart, list(MEASURES.values())).first().asDict()
    for name, expected in TOTALS.items():
        assert result[MEASURES[name].alias] == pytest.approx(expected), name


@pytest.mark.parametrize("name", TOTALS)
def test_measure_as_one_aggregate(mart, name):
    m = measure(name)
    assert mart.table(m.fact).agg(m.column()).first()[0] == pytest.approx(TOTALS[name])


def test_case_sensitive_release(mart):
    headers = mart.table("COOIS_OrderHeaders")
    assert headers.where(D.is_released("SystemStatus", ignore_case=False)).count() == 4


def test_measures_by_product_group(mart):
    by = ["ProductGroup.ProductGroup"]
    counts = rows(evaluate(mart, [measure("Order Count")], by), "ProductGroup")
    assert {k: r["order_count"] for k, r in counts.items()} == {"P1": 3, "P2": 2, None: 1}
    rates = rows(evaluate(mart, [measure("Scrap Rate")], by), "ProductGroup")
    assert rates["P1"]["scrap_rate"] == pytest.approx(0.0375)
    assert rates["P2"]["scrap_rate"] == pytest.approx(3 / 28)
    assert rates[None]["scrap_rate"] is None


def test_drill_across(mart):
    names = ["Order Count", "Missing Part Count", "SOP Deviation"]
    result = rows(
        evaluate(mart, [measure(n) for n in names], ["ProductGroup.ProductGroup"]), "ProductGroup"
    )
    values = {k: tuple(r)[1:] for k, r in result.items()}
    assert values == {
        "P1": (3, 1, -10.0),
        "P2": (2, 2, 10.0),
        "P3": (None, None, -30.0),
        None: (1, None, None),
    }


def test_unreachable_dimension_is_named(mart):
    with pytest.raises(ValueError, match="WorkCenters cannot be reached from CO24"):
        evaluate(mart, [measure("Missing Part Count")], ["WorkCenters.WERKS"])
    with pytest.raises(ValueError):
        path("COOIS_OrderHeaders", "MRP_Cntr")


def test_override_replaces_outer_filter_and_group(mart):
    status = "COOIS_OrderHeaders.StatusShort"
    orders = measure("Order Count")
    everywhere = orders.where(
        lambda: F.col("StatusShort") == "REL", ["StatusShort"], override=True
    ).named("Released Anywhere")
    here = orders.where(lambda: F.col("StatusShort") == "REL", ["StatusShort"]).named("Here")
    where = {status: lambda c: c.isin("REL", "CNF")}
    result = rows(evaluate(mart, [orders, here, everywhere], [status], where), "StatusShort")
    assert {k: tuple(r)[1:] for k, r in result.items()} == {"REL": (2, 2, 2), "CNF": (1, 0, 2)}
    alone = rows(evaluate(mart, [everywhere], [status], where), "StatusShort")
    assert {k: r["released_anywhere"] for k, r in alone.items()} == {"REL": 2, "CNF": 2}
    assert evaluate(mart, [everywhere], [], where).first()[0] == 2


def test_filter_on_dimension(mart):
    result = evaluate(
        mart, [measure("Total Yield")], [], {"MARA.MTART": lambda c: c == "FERT"}
    ).first()
    assert result["total_yield"] == 80.0


def test_compose_needs_one_fact():
    with pytest.raises(ValueError):
        Measure.compose("x", lambda v: v[0], measure("Total Yield"), measure("Order Count"))


def test_empty_facts(mart, spark):
    from forgemart.sources.mart import FrameMart

    empty = FrameMart(
        {t: mart.table(t).where("false") for t in {m.fact for m in MEASURES.values()}}
    )
    result = evaluate(empty, list(MEASURES.values())).first().asDict()
    for name, m in MEASURES.items():
        assert result[m.alias] == (0 if name.endswith("Count") or "Load" in name or "(" in name else None)


def test_filter_that_keeps_nothing(mart):
    names = ["Order Count", "Total Order Quantity", "Scrap Rate"]
    none = {"MARA.MTART": lambda c: c == "none"}
    assert tuple(evaluate(mart, [measure(n) for n in names], [], none).first()) == (0, None, None)


def test_headline_questions(mart):
    t = mart.table
    total = A.released_and_backlog(t("COOIS_OrderHeaders")).first()
    assert (total["orders"], total["released"], total["backlog"]) == (6, 5, 2)
    ops = A.bottleneck_operations(t("COOIS_OrderOperations"), t("WorkCenters")).first()
    assert tuple(ops) == (8, 4, 5)
    waiting = rows(A.waiting_on_parts(t("COOIS_OrderHeaders"), t("CO24")), "Order")
    assert (waiting["O1"]["shortage_quantity"], waiting["O1"]["missing_parts"]) == (5.0, 1)
    assert (waiting["O2"]["shortage_quantity"], waiting["O2"]["missing_parts"]) == (5.0, 2)
    assert (waiting[None]["shortage_quantity"], waiting[None]["orders"]) == (10.0, 2)
    assert A.top_scrap_group(mart).first()["ProductGroup"] == "P2"
    assert A.posting_delay(t("COOIS_Confirmations")).first()["avg_posting_delay_hours"] == 6.875


def test_capacity_buffer_utilization(mart):
    t = mart.table
    load = rows(A.utilization(t("COOIS_OrderOperations"), t("WorkCenters")), "WorkCenter")
    assert {k: (r["load_hours"], r["capacity_hours_per_day"]) for k, r in load.items()} == {
        "WA1": (4.0, 18.72),
        "WL1": (9.0, 7.6),
        "WL2": (1.5, 7.44),
    }
    buffer = A.material_buffer(t("COOIS_OrderOperations"), t("COOIS_OrderHeaders"))
    assert {k: r["orders"] for k, r in rows(buffer, "WorkCenter").items()} == {"WA1": 1, "WL1": 2}


def test_throughput_and_precedence(mart):
    t = mart.table
    compared = rows(A.throughput_compare(t("MATDOC"), t("COOIS_Confirmations")), "Order")
    assert {k: tuple(r)[1:] for k, r in compared.items()} == {
        "O2": (None, 8.0, None),
        "O4": (38.0, 40.0, -2.0),
        "O5": (7.0, 0.0, 7.0),
    }
    best = A.delivered_by_precedence(
        t("MATDOC"), t("COOIS_Confirmations"), t("COOIS_OrderHeaders"), t("COOIS_OrderOperations")
    )
    assert {k: tuple(r)[1:] for k, r in rows(best, "Order").items()} == {
        "O1": (0.0, "headers"),
        "O2": (8.0, "confirmations"),
        "O3": (0.0, "headers"),
        "O4": (38.0, "movements"),
        "O5": (7.0, "movements"),
        "O6": (0.0, "headers"),
    }


def test_consumption(mart):
    net = A.consumption(mart.table("MATDOC"), mart.table("MovementTypes"), ["Order"])
    assert {k: r["net"] for k, r in rows(net, "Order").items()} == {
        "O2": -14.0,
        "O4": 38.0,
        "O5": 7.0,
        "O9": 0.0,
    }


def test_orphans_and_order_selections(mart):
    held = [e for e in EDGES if e.many not in ("MARC", "MARD", "D_Part")]
    lost = {(r["edge"], r["key"]) for r in orphans(mart, held).collect()}
    assert lost == {("J6", "M9"), ("J12", "O9")}
    headers, co24 = mart.table("COOIS_OrderHeaders"), mart.table("CO24")
    assert {r["Order"] for r in joins.clean_orders(headers, co24).collect()} == {"O4", "O5", "O6"}
    assert {r["Order"] for r in joins.waiting_orders(headers, co24).collect()} == {"O1", "O2"}


def test_widen_keeps_every_fact_row(mart):
    wide = widen(
        mart,
        "COOIS_Confirmations",
        ["Confirmation"],
        ["ProductGroup.Description", "WorkCenters.WERKS"],
    )
    found = {r["Confirmation"]: (r[1], r[2]) for r in wide.collect()}
    assert found["C5"] == (None, "1000") and found["C3"] == ("One", "2000") and len(found) == 5


def test_hierarchy(mart):
    walk = {(r["node"], r["ancestor"], r["distance"]) for r in joins.ancestors(mart.table("ProductHierarchy")).collect()}
    assert walk == {
        ("N0", "N0", 0), ("N1", "N1", 0), ("N2", "N2", 0), ("N1", "N0", 1), ("N2", "N0", 1),
    }
    top = rows(A.by_hierarchy(mart, [measure("Scrap Rate"), measure("Total Yield")], 1), "ancestor")
    assert top["N0"]["scrap_rate"] == pytest.approx(6 / 108)
    assert top[None]["total_yield"] == 0.0


def test_prioritize(mart):
    ranked = A.prioritize(mart.table("COOIS_OrderHeaders"), mart.table("CO24"), 2).collect()
    assert [(r["rank"], r["Order"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [
        (1, "O1"),
        (2, "O2"),
    ]


def test_bottleneck_board(mart):
    board = rows(A.bottleneck_board(mart), "WorkCenter")
    assert set(board) == {"WL1", "WL2"}
    assert board["WL1"]["buffer_orders"] == 2 and board["WL1"]["missing_parts"] == 3
    assert board["WL2"]["received_quantity"] == 38.0 and board["WL2"]["buffer_orders"] is None


def test_checks_find_seeded_faults(mart):
    t = mart.table
    assert quality.check_k1(t("CO24")).count() == 0
    assert quality.check_k1(t("CO24").withColumn("MissingPart", F.lit(1))).count() == 2
    assert quality.check_k3(t("COOIS_OrderHeaders"), AS_OF).count() == 0
    assert quality.check_k4(t("COOIS_OrderHeaders")).select("Order").first()[0] == "O4"
    assert quality.check_k6(t("WorkCenters")).count() == 0
    assert quality.check_k7(t("SOP_Targets")).count() == 0
    assert quality.check_k9(t("COOIS_OrderOperations")).count() == 0
    assert quality.check_k10(t("COOIS_OrderOperations"), t("COOIS_Confirmations")).count() == 0
    twice = t("COOIS_Confirmations").unionByName(t("COOIS_Confirmations"))
    assert quality.check_k10(t("COOIS_OrderOperations"), twice).count() == 5
    assert quality.duplicate_keys(t("CO24"), "CO24", ["Order", "Component"]).first()["rows"] == 3


def test_overrides_chain(mart):
    """A later override keeps what an earlier one replaces."""
    both = (
        measure("Order Count")
        .where(lambda: F.col("StatusShort") == "REL", ["StatusShort"], override=True)
        .where(lambda: F.col("Priority") >= 0, ["Priority"], override=True)
    )
    assert set(both.replaces) == {"StatusShort", "Priority"}
    where = {"COOIS_OrderHeaders.StatusShort": lambda c: c == "CNF"}
    headers = mart.table("COOIS_OrderHeaders")
    released = headers.where("StatusShort = 'REL' and Priority >= 0").count()
    assert released > 0
    assert evaluate(mart, [both], where=where).first()[0] == released


def test_sums_keep_small_values(spark):
    rows = spark.range(10_000).select(F.lit(0.00004).alias("ScrapQuantity"))
    assert rows.agg(measure("Total Scrap").column()).first()[0] == 0.4
    assert implicit_sum(rows, "COOIS_Confirmations", ["ScrapQuantity"]).first()[0] == 0.4


def test_unknown_quantities_stay_unknown(spark):
    rows = spark.createDataFrame(
        [(None, 1.0, 0.0), (5.0, None, 0.0), (5.0, 1.0, None), (5.0, 6.0, 0.0), (5.0, 1.0, 0.0)],
        "r double, c double, i double",
    )
    gap = D.shortage("r", "c", "i")
    found = [tuple(r) for r in rows.select(gap, D.missing_part(gap)).collect()]
    assert found == [(None, None)] * 3 + [(0.0, 0), (4.0, 1)]
    due = rows.select(D.missing_part(gap, F.lit("2026-01-01").cast("date"), "2025-12-31"))
    assert {r[0] for r in due.collect()} == {0}


def test_document_numbers_do_not_meet(spark):
    from forgemart.sources.binding import _line_number

    rows = spark.createDataFrame([(1, 12345), (11, 2345), (112, 345)], "l_orderkey long, op_seq long")
    numbers = [r[0] for r in rows.select(_line_number(10)).collect()]
    assert len(set(numbers)) == 3


def test_allowed_days_are_arguments(spark):
    days = [("a", 0, 0), ("b", 10, 40), ("c", -1, 5), ("d", 2, -1)]
    start = F.lit("2026-01-10").cast("date")
    headers = spark.createDataFrame(days, "`Order` string, lead int, span int").select(
        "Order",
        start.alias("CreationDate"),
        F.date_add(start, F.col("lead")).alias("StartDate"),
        F.date_add(start, F.col("lead") + F.col("span")).alias("FinishDate"),
    )
    assert {r["Order"] for r in quality.check_k8(headers).collect()} == {"c", "d"}
    assert {r["Order"] for r in quality.check_k8(headers, (0, 5), (1, None)).collect()} == {"a", "b", "c", "d"}


def test_grid_follows_the_actuals(spark, data, tmp_path):
    """All line items moved by twenty years: the planning grid still has every actual."""
    for table in ("part", "orders"):
        spark.read.parquet(f"{data}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    moved = lines.withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 240 months"))
    moved.write.parquet(str(tmp_path / "lineitem.parquet"))
    grid = QUERIES["x04_sop_grid"](spark, str(tmp_path))
    actuals = BoundMart(spark, str(tmp_path)).table("SOP_Targets").count()
    assert grid.where("ActualQuantity is not null").count() == actuals


def test_deep_and_circular_hierarchies(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)]
    found = ancestors(spark.createDataFrame(chain, "ProductHierarchy string, Parent string"))
    assert found.count() == 150 * 151 // 2
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "ProductHierarchy string, Parent string")
    assert ancestors(ring).count() == 9
