from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from forgemart import fixed_values as fixed
from forgemart.functions import derivations as D
from forgemart.operators.generate import expand_locations, expand_routing, periods, sop_grid
from forgemart.operators.schedule import schedule


def one(spark, column, **values):
    """Value of a column expression over one row."""
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "width", "expected"),
    [("7", 3, "007"), ("1234", 3, "1234"), ("123", 3, "123"), ("", 2, "00")],
)
def test_pad_key_never_cuts(spark, text, width, expected):
    assert one(spark, D.pad_key("a", width), a=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("007", "7"), ("000", "0"), ("70", "70"), ("0A", "A")])
def test_strip_zeros(spark, text, expected):
    assert one(spark, D.strip_zeros("a"), a=text) == expected


def test_codes(spark):
    assert one(spark, D.decode("a", fixed.ROLE_TEXT), a="LASER") == "Laser Balancing"
    assert one(spark, D.decode("a", fixed.ROLE_TEXT), a="XX") == "XX"
    assert one(spark, D.system_status("a"), a="TECO") == "REL CNF DLV TECO"
    assert one(spark, D.system_status("a"), a="NEW") is None
    assert one(spark, D.mrp_controller("p", "g"), p="1000", g="PG40") == "103"
    assert one(spark, D.mrp_controller("p", "g"), p="2000", g="PG40") == "201"
    assert one(spark, D.assign_work_center("p", "r"), p="2000", r="INSP") == "WC-LASER02"
    assert one(spark, D.hierarchy_key("g"), g="PG30") == "RE03000000"
    assert one(spark, D.operation_no("n"), n=3) == "0030"


def test_float_traps(spark):
    assert one(spark, D.shortage("a", "b", "c"), a=0.8, b=0.7, c=0.1) == 0.0
    assert one(spark, D.shortage("a", "b", "c"), a=1.0, b=2.0, c=0.0) == 0.0
    assert one(spark, D.shortage("a", "b", "c"), a=10.25, b=0.0, c=0.0) == 10.3
    assert one(spark, D.sop_deviation("a", "b"), a=0.3, b=0.1) == 0.2
    assert one(spark, D.rnd("a", 2), a=0.125) == 0.13
    assert one(spark, D.rnd("a", 2, half_even=True), a=0.125) == 0.12


def test_delay_hours(spark):
    a, b = datetime(2026, 7, 1, 8, 0, 0), datetime(2026, 7, 1, 8, 12, 0)
    assert one(spark, D.delay_hours("a", "b"), a=a, b=b) == 0.2
    assert one(spark, D.delay_hours("b", "a"), a=a, b=b) == -0.2


def test_backlog_is_strict(spark):
    flag = D.backlog_flag("s", "f", "2026-07-15")
    assert one(spark, flag, s="REL", f=date(2026, 7, 15)) == 0
    assert one(spark, flag, s="CRTD", f=date(2026, 7, 14)) == 1
    assert one(spark, flag, s="CNF", f=date(2026, 7, 14)) == 0


def test_status_progress(spark):
    done = D.confirmed_operations("s", "n", "d")
    assert one(spark, done, s="PCNF", n=4, d=3) == 3
    assert one(spark, done, s="REL", n=4, d=5) == 4
    assert one(spark, done, s="CRTD", n=1, d=5) == 0
    assert one(spark, done, s="DLV", n=4, d=1) == 4
    status = D.op_status("s", "p", "k")
    assert [one(spark, status, s="PCNF", p=p, k=2) for p in (1, 2, 3, 4)] == [
        "CNF", "CNF", "PCNF", "REL",
    ]
    assert one(spark, status, s="CRTD", p=1, k=0) == "CRTD"
    assert one(spark, D.expected_delivered("s", "q", 0.35), s="PCNF", q=10.0) == 3.0


def test_signed_quantity(spark):
    signed = D.signed_quantity("q", "s")
    assert [one(spark, signed, q=5.0, s=s) for s in "+-0?"] == [5.0, -5.0, 0.0, None]


def test_formats(spark):
    assert one(spark, D.fmt("a", "#,0"), a=1234567.5) == "1,234,568"
    assert one(spark, D.fmt("a", "0.0%"), a=0.05556) == "5.6%"
    assert one(spark, D.fmt("a", "0.0"), a=6.875) == "6.9"
    moment = datetime(2026, 7, 15, 7, 30)
    assert one(spark, D.fmt("a", "yyyy-mm-dd hh:nn:ss"), a=moment) == "2026-07-15 07:30:00"


def test_generators(spark):
    orders = spark.createDataFrame([("1", "PG50"), ("2", "none")], "`Order` string, ProductGroup string")
    steps = [(r["Order"], r["position"], r["role"]) for r in expand_routing(orders).collect()]
    assert steps == [("1", 1, "TURN"), ("1", 2, "INSP")]
    places = expand_locations(spark.createDataFrame([("m",)], "MATNR string"))
    assert [r["LGORT"] for r in places.collect()] == ["0001", "0002"]
    groups = spark.createDataFrame([("g",)], "ProductGroup string")
    start = F.lit("2026-04-20").cast("date")
    assert [r["Period"] for r in periods(groups, start, 6).collect()] == [
        "202604", "202605", "202606", "202607", "202608", "202609",
    ]
    assert sop_grid(groups, start, 6).count() == 12


def test_schedule(spark):
    ops = spark.createDataFrame(
        [
            ("o", "0010", 1.0, 15.0, date(2026, 7, 1)),
            ("o", "0020", 0.1, 0.1, date(2026, 7, 1)),
            ("o", "0030", 1.0, 7.0, date(2026, 7, 1)),
        ],
        "`Order` string, Operation string, SetupTime double, MachineTime double, OrderStart date",
    )
    placed = {r["Operation"]: (r["ScheduledStart"], r["ScheduledEnd"]) for r in schedule(ops, 2).collect()}
    assert placed["0010"] == (datetime(2026, 7, 1), datetime(2026, 7, 3))
    assert placed["0020"] == (datetime(2026, 7, 3, 2), datetime(2026, 7, 3, 14))
    assert placed["0030"] == (datetime(2026, 7, 3, 16), datetime(2026, 7, 4, 16))
