"""Distinct counts, subtotals, idle times, doubling of paths, sketches and one rounding."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from forgemart.functions import derivations as D
from forgemart.functions.measures import Measure, count_of, distinct_of, measure, sum_of
from forgemart.operators import sketches
from forgemart.operators.joins import ancestors, ancestors_at_level
from forgemart.plans.evaluate import evaluate, evaluate_levels
from forgemart.plans.idle import gaps, idle_time
from forgemart.sources.mart import FrameMart

# ---- distinct counts and levels -----------------------------------------------------------


@pytest.fixture(scope="module")
def mart(spark):
    draw = random.Random(2)
    orders = [(f"o{i}", draw.choice(["m1", "m2", "m3", None]), draw.choice(["REL", "CNF"]), i % 3) for i in range(40)]
    ops = [(draw.choice([f"o{i}" for i in range(45)] + [None] * 5), f"{k}", draw.choice(["w1", "w2", None]), draw.choice(["REL", "CNF"]), float(k)) for k in range(300)]
    return FrameMart(
        {
            "COOIS_OrderHeaders": spark.createDataFrame(orders, "`Order` string, Material string, StatusShort string, Priority int"),
            "COOIS_OrderOperations": spark.createDataFrame(ops, "`Order` string, Operation string, WorkCenter string, StatusShort string, TargetQuantity double"),
            "WorkCenters": spark.createDataFrame([("w1", "p1"), ("w2", None)], "WorkCenter string, WERKS string"),
            "MARA": spark.createDataFrame([("m1", "FERT"), ("m2", "FERT"), ("m3", None)], "MATNR string, MTART string"),
        }
    )


OPS = "COOIS_OrderOperations"


def plain_rows(mart):
    """Operations with what dimensions say of them."""
    heads = {r["Order"]: r for r in mart.table("COOIS_OrderHeaders").collect()}
    kinds = {r.MATNR: r.MTART for r in mart.table("MARA").collect()}
    plants = {r.WorkCenter: r.WERKS for r in mart.table("WorkCenters").collect()}
    for r in mart.table(OPS).collect():
        head = heads.get(r["Order"])
        yield r, kinds.get(head.Material) if head else None, plants.get(r.WorkCenter), head.Priority if head else None


def test_distinct_counts_by_any_dimension(mart):
    orders = distinct_of("Orders", OPS, "Order")
    waiting = orders.where(lambda: F.col("StatusShort") != "CNF", ["StatusShort"]).named("Waiting")
    found = evaluate(mart, [orders, waiting, count_of("Rows", OPS)], ["MARA.MTART", "WorkCenters.WERKS"], {"COOIS_OrderHeaders.Priority": lambda c: c > 0})
    groups = {}
    for r, kind, plant, priority in plain_rows(mart):
        if priority is not None and priority > 0:
            groups.setdefault((kind, plant), []).append(r)
    expected = {
        (*g, len({r["Order"] for r in rows} - {None}), len({r["Order"] for r in rows if r.StatusShort != "CNF"} - {None}), len(rows))
        for g, rows in groups.items()
    }
    assert {tuple(r) for r in found.collect()} == expected
    total = evaluate(mart, [orders, distinct_of("Nothing", OPS, "Order").where(lambda: F.lit(False))])
    assert tuple(total.first()) == (len({r["Order"] for r, *_ in plain_rows(mart)} - {None}), 0)
    by_own = evaluate(mart, [orders], [f"{OPS}.StatusShort"])
    assert {tuple(r) for r in by_own.collect()} == {tuple(r) for r in mart.table(OPS).groupBy("StatusShort").agg(F.count_distinct("Order")).collect()}
    assert mart.table(OPS).agg(orders.column()).first()[0] == total.first()[0]


def test_ratios_of_distinct_counts(mart):
    per_order = Measure.compose("Per Order", lambda v: v[0] / v[1], sum_of("Target", OPS, "TargetQuantity"), distinct_of("Orders", OPS, "Order"))
    found = evaluate(mart, [per_order], [f"{OPS}.WorkCenter"]).collect()
    rows = mart.table(OPS).groupBy("WorkCenter").agg(F.sum("TargetQuantity") / F.count_distinct("Order")).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in rows}


@pytest.mark.parametrize("cube", [False, True])
def test_levels(mart, cube):
    rate = Measure.compose("Per Row", lambda v: v[0] / v[1], sum_of("Target", OPS, "TargetQuantity"), count_of("Rows", OPS))
    wanted = [distinct_of("Orders", OPS, "Order"), rate, count_of("Rows", OPS), count_of("Heads", "COOIS_OrderHeaders")]
    found = evaluate_levels(mart, wanted, ["MARA.MTART", "COOIS_OrderHeaders.Priority"], cube=cube)
    assert found.columns == ["MTART", "Priority", "subtotal_level", "orders", "per_row", "rows", "heads"]
    kinds = {r.MATNR: r.MTART for r in mart.table("MARA").collect()}
    heads = [(kinds.get(r.Material), r.Priority) for r in mart.table("COOIS_OrderHeaders").collect()]
    facts = [((kind, priority), r) for r, kind, _, priority in plain_rows(mart)]
    expected = set()
    for hidden in (0, 1, 2, 3) if cube else (0, 1, 3):
        def level(group, hidden=hidden):
            return tuple(None if hidden >> (1 - at) & 1 else v for at, v in enumerate(group))

        for g in {level(g) for g, _ in facts} | {level(g) for g in heads}:
            own = [r for f, r in facts if level(f) == g]
            n = sum(level(h) == g for h in heads)
            if own:
                told = (len({r["Order"] for r in own} - {None}), sum(r.TargetQuantity for r in own) / len(own), len(own))
            else:
                told = (None, None, None)
            expected.add((*g, hidden, *told, n or None))
    assert {tuple(r) for r in found.collect()} == expected


def test_levels_refuse_overriding_measures(mart):
    replaced = measure("Order Count").where(lambda: F.lit(True), ["StatusShort"], override=True)
    with pytest.raises(ValueError, match="overriding"):
        evaluate_levels(mart, [replaced], ["COOIS_OrderHeaders.Priority"])


# ---- idle times -----------------------------------------------------------------------------


def test_gaps_against_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for center in ("a", "b", "c"):
        for _ in range(60 if center != "c" else 1):
            begin = draw.randint(0, 100_000)
            rows.append((center, begin, begin + draw.choice([1, 50, 600, 9000])))
    rows += rows[:20]  # repeated intervals
    found = gaps(spark.createDataFrame(rows, "WorkCenter string, begin long, end long"))
    expected = set()
    for center in ("a", "b", "c"):
        own = sorted(r[1:] for r in rows if r[0] == center)
        latest = own[0][1]
        for begin, end in own:
            if begin > latest:
                expected.add((center, latest, begin))
            latest = max(latest, end)
    assert {tuple(r) for r in found.collect()} == expected and expected


def test_idle_days(spark):
    rows = [("w", "2024-01-01 10:00:00", 2.0), ("w", "2024-01-01 09:30:00", 1.0), ("w", "2024-01-03 01:00:00", 2.0), ("w", None, 1.0), (None, "2024-01-01 10:00:00", 1.0), ("v", "2024-01-01 10:00:00", 0.0)]
    table = spark.createDataFrame(rows, "WorkCenter string, ActualEnd string, ActualMachineTime double")
    found = idle_time(table.withColumn("ActualEnd", F.col("ActualEnd").cast("timestamp")))
    got = {(r.WorkCenter, str(r.day)): (r.busy_hours, r.idle_hours, r.longest_gap_hours) for r in found.collect()}
    assert got == {("w", "2024-01-01"): (2.0, 14.0, 14.0), ("w", "2024-01-02"): (1.0, 23.0, 23.0), ("w", "2024-01-03"): (1.0, 0.0, 0.0)}


# ---- hierarchies -----------------------------------------------------------------------------


def test_deep_chain_in_few_steps(spark, monkeypatch):
    from forgemart.operators import joins

    steps = []
    keep = joins.written
    monkeypatch.setattr(joins, "written", lambda df: (steps.append(1), keep(df))[1])
    limits = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")}
    n = 10_000
    chain = spark.range(1, n + 1).selectExpr("cast(id as string) ProductHierarchy", "cast(id as string) Description", "id Level", "if(id > 1, cast(id - 1 as string), null) Parent")
    found = ancestors_at_level(chain, 1)
    assert found.count() == n and {r.ancestor for r in found.select("ancestor").distinct().collect()} == {"1"}
    assert len(steps) <= 15  # the pointers, and one step for each doubling
    steps.clear()
    short = chain.where("Level <= 300")
    pairs = ancestors(short)
    assert pairs.count() == 300 * 301 // 2
    assert pairs.where("cast(node as int) - cast(ancestor as int) != distance").count() == 0
    assert len(steps) <= 11
    assert limits == {k: spark.conf.get(k) for k in limits}


def test_cycles_and_several_parents(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("u", "t"), ("x", None), ("y", "x"), ("z", "y"), ("z", "x"), ("s", "s")]
    found = {tuple(r) for r in ancestors(spark.createDataFrame(rows, "ProductHierarchy string, Parent string")).collect()}
    up = {}
    for node, parent in rows:
        up.setdefault(node, set()).update({parent} - {None})
    expected = set()
    for node in up:
        seen, edge, distance = {node: 0}, {node}, 0
        while edge:
            distance += 1
            edge = {p for e in edge for p in up.get(e, ())} - set(seen)
            seen |= dict.fromkeys(edge, distance)
        expected |= {(node, a, d) for a, d in seen.items()}
    assert found == expected
    table = spark.createDataFrame([("a", "A", 2, "b"), ("b", "B", 3, "a"), ("t", "T", 3, "a"), ("q", "Q", 3, "gone"), ("r", "R", 3, None)], "ProductHierarchy string, Description string, Level int, Parent string")
    assert {tuple(r) for r in ancestors_at_level(table, 2).collect()} == {("a", "a", "A"), ("b", "a", "A"), ("t", "a", "A")}
    assert ancestors_at_level(table, 9).count() == 0
    assert ancestors(table.where("false")).count() == ancestors_at_level(table.where("false"), 1).count() == 0


# ---- sketches ----------------------------------------------------------------------------------


def test_sketches_merge(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 7).alias("day"), (F.col("id") % 2).alias("plant"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7).alias("hours")
    ).union(spark.sql("select 1L, 1L, cast(null as double)"))
    daily = sketches.quantile_sketches(rows, ["day", "plant"], "hours")
    merged = sketches.merge_sketches(daily, ["plant"])
    assert merged.agg(F.sum("rows")).first()[0] == 20_000
    errors = sketches.quantile_errors(rows, merged, ["plant"], "hours", (1, 50, 90)).collect()
    assert len(errors) == 2 and all(0 <= r[f"off_{p}"] < 0.015 for r in errors for p in (1, 50, 90))


def test_bitmaps_count_distinct_values(spark):
    rows = spark.range(100_000).select((F.col("id") % 9).alias("day"), F.pmod(F.xxhash64("id"), F.lit(70_000)).cast("string").alias("key"))
    rows = rows.union(spark.sql("select 1L, cast(null as string)"))
    numbers = sketches.numbered(rows, "key")
    n = rows.agg(F.count_distinct("key")).first()[0]
    assert tuple(numbers.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first()) == (n, n, 0, n - 1)
    daily = sketches.value_bitmaps(rows.join(numbers, "key", "left"), ["day"])
    got = {tuple(r) for r in sketches.bitmap_counts(daily, ["day"], "keys").collect()}
    assert got == {tuple(r) for r in rows.groupBy("day").agg(F.count_distinct("key")).collect()}
    assert sketches.bitmap_counts(sketches.merge_bitmaps(daily, []), [], "keys").first()[0] == n


# ---- rounding ------------------------------------------------------------------------------------


def test_values_are_rounded_once(spark):
    def value(column):
        return spark.range(1).select(column).first()[0]

    assert value(D.rnd(F.lit(1.00499996), 2)) == 1.0
    assert value(D.shortage(F.lit(0.04999996), F.lit(0.0), F.lit(0.0))) == 0.0
    assert value(D.sop_deviation(F.lit(0.04999996), F.lit(0.0))) == 0.0
    assert value(D.rnd(F.lit(1.005), 2)) == 1.01 and value(D.rnd(F.lit(-1.005), 2)) == -1.01
    assert value(D.rnd(F.lit(1.005), 2, half_even=True)) == 1.0
    assert value(D.shortage(F.lit(0.8), F.lit(0.7), F.lit(0.1))) == 0.0
    assert value(D.shortage(F.lit(0.25), F.lit(0.0), F.lit(0.0))) == 0.3
    assert value(D.shortage(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))) is None
    for a, b in product((0.05, 0.15, 0.25, 10.35), (0.0, 5.0)):
        assert value(D.sop_deviation(F.lit(a), F.lit(b))) == pytest.approx(float(D_round(a, b)), abs=0)


def D_round(a, b):
    import decimal

    apart = decimal.Decimal(repr(a)) - decimal.Decimal(repr(b))
    return apart.quantize(decimal.Decimal("0.1"), decimal.ROUND_HALF_UP)
