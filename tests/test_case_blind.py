"""Case-blind comparison in filters, groups, joins and distinct counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forgemart.functions.measures import count_of, distinct_of, sum_of
from forgemart.plans.evaluate import evaluate, evaluate_levels
from forgemart.sources.case_blind import CaseBlindMart, case_blind
from forgemart.sources.mart import FrameMart

HEADERS = "COOIS_OrderHeaders"


@pytest.fixture(scope="module")
def mart(spark):
    headers = [("a1", "m1", "REL", 1.0), ("A1", "M1", "rel", 2.0), ("a2", "m2", "Rel", 4.0), ("a3", "M2", "CNF", 8.0), ("a4", None, None, 16.0), ("a5", "m9", "cnf", 32.0)]
    materials = [("M1", "FERT"), ("m2", "fert"), ("m3", "HALB")]
    return FrameMart(
        {
            HEADERS: spark.createDataFrame(headers, "`Order` string, Material string, StatusShort string, OrderQuantity double"),
            "MARA": spark.createDataFrame(materials, "MATNR string, MTART string"),
        }
    )


def upper(df):
    """Rows with the texts of groups in one case."""
    texts = {f.name for f in df.schema if f.dataType.simpleString().startswith("string")}
    return {tuple(r) for r in df.select(*[F.upper(F.col(c).cast("string")) if c in texts else c for c in df.columns]).collect()}


def test_groups_joins_and_filters_agree(mart):
    wanted = [count_of("Orders", HEADERS), distinct_of("Keys", HEADERS, "Order"), sum_of("Quantity", HEADERS, "OrderQuantity")]
    blind = CaseBlindMart(mart)
    assert upper(evaluate(blind, wanted, ["MARA.MTART"])) == {("FERT", 4, 3, 15.0), (None, 2, 2, 48.0)}
    assert upper(evaluate(blind, wanted, [f"{HEADERS}.StatusShort"])) == {("REL", 3, 2, 7.0), ("CNF", 2, 2, 40.0), (None, 1, 1, 16.0)}
    kept = evaluate(blind, wanted, ["MARA.MTART"], {f"{HEADERS}.StatusShort": lambda c: c.isin("rel", "open")})
    assert upper(kept) == {("FERT", 3, 2, 7.0)}
    released = evaluate(blind, wanted, (), {f"{HEADERS}.StatusShort": lambda c: c.contains("rE")})
    assert upper(released) == {(3, 2, 7.0)}
    levels = evaluate_levels(blind, wanted[:2], ["MARA.MTART"])
    assert upper(levels) == {("FERT", 0, 4, 3), (None, 0, 2, 2), (None, 1, 6, 5)}
    exact = evaluate(mart, wanted, [f"{HEADERS}.StatusShort"])
    assert exact.count() == 6


def test_only_named_columns(mart):
    table = case_blind(mart.table(HEADERS), ["StatusShort"])
    assert table.where("StatusShort = 'rel'").count() == 3
    assert table.where("`Order` = 'a1'").count() == 1
    assert dict(table.dtypes)["OrderQuantity"] == "double"
