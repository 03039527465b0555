"""Rule-book analyses and headline questions.

Facts that meet are summed to their common key first. Where the result combines several facts,
the sums are stacked and grouped once instead of being joined pairwise. Formulas that the rule
book only names, and that are chosen here, say so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgemart.functions.derivations import SCALE, amount, is_released, period, units
from forgemart.functions.measures import Measure, exact_avg, exact_sum, measure
from forgemart.operators import joins
from forgemart.operators.quality import operation_bin, operation_number
from forgemart.operators.sequences import previous_row
from forgemart.operators.totals import OUTPUT, stock_total, subtotal_sums
from forgemart.plans.evaluate import evaluate, finish, partial_sums

GOODS_RECEIPT = "101"


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _released(headers: DataFrame) -> DataFrame:
    return headers.where(is_released("SystemStatus"))


# ---- headline questions -----------------------------------------------------------------


def released_and_backlog(headers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order, released and backlog counts per group, with a total row when grouped."""
    counts = headers.groupBy(*by).agg(
        _rows("orders"),
        F.count_if(is_released("SystemStatus")).alias("released"),
        F.count_if(F.col("Backlog") == 1).alias("backlog"),
    )
    if not by:
        return counts
    return counts.rollup(*by).agg(
        F.grouping_id().alias("subtotal_level"),
        *[F.sum(c).alias(c) for c in ("orders", "released", "backlog")],
    )


def bottleneck_operations(operations: DataFrame, centers: DataFrame) -> DataFrame:
    """Operations at the bottleneck: by their own flag, and by the centre they run on. The two
    differ where an unflagged operation runs on a bottleneck centre."""
    per_center = operations.groupBy("WorkCenter").agg(
        _rows("operations"), F.count_if(F.col("BottleneckOperation") == 1).alias("by_flag")
    )
    flags = centers.select("WorkCenter", "Bottleneck")
    at_center = F.when(F.col("Bottleneck") == 1, F.col("operations")).otherwise(0)
    return per_center.join(flags, "WorkCenter", "left").agg(
        F.sum("operations").alias("operations"),
        F.sum("by_flag").alias("by_flag"),
        F.sum(at_center).alias("by_work_center"),
    )


def waiting_on_parts(headers: DataFrame, co24: DataFrame) -> DataFrame:
    """Waiting orders with missing parts and shortage, and one row (null order) for the total.
    Lines become one row per order before they meet the headers, which hold an order once. The
    total is taken from the same grouped lines, whose shuffle Spark reuses, so the orders are not
    shuffled a second time as a rollup would."""
    per_order = (
        co24.where(F.col("MissingPart") == 1)
        .groupBy("Order")
        .agg(_rows("missing_parts"), F.sum(amount("ShortageQuantity")).alias("shortage"))
        .join(headers.select("Order"), "Order")
    )
    total = per_order.agg(
        F.count("Order").alias("orders"),
        F.sum("missing_parts").alias("missing_parts"),
        F.sum("shortage").alias("shortage"),
    )
    return _stack(
        per_order.withColumns({"subtotal_level": F.lit(0), "orders": F.lit(1).cast("bigint")}),
        total.withColumn("subtotal_level", F.lit(1)),
    ).select(
        "Order",
        "subtotal_level",
        "orders",
        "missing_parts",
        F.col("shortage").cast("double").alias("shortage_quantity"),
    )


def top_scrap_group(mart, n: int = 1) -> DataFrame:
    """The ``n`` product groups with the highest scrap rate; ties go by group."""
    rates = evaluate(
        mart,
        [measure("Scrap Rate"), measure("Total Scrap"), measure("Total Yield")],
        by=["ProductGroup.ProductGroup"],
    )
    return rates.orderBy(F.col("scrap_rate").desc_nulls_last(), "ProductGroup").limit(n)


def posting_delay(confirmations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average hours between the real end and its posting."""
    return confirmations.groupBy(*by).agg(
        F.count("DelayHours").alias("postings"),
        exact_avg("DelayHours").alias("avg_posting_delay_hours"),
    )


# ---- load, buffer, capacity -------------------------------------------------------------


def order_load(headers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Released orders: count, quantity and open quantity (ordered minus delivered, chosen here)."""
    quantity, delivered = amount("OrderQuantity"), amount("DeliveredQuantity")
    return _released(headers).groupBy(*by).agg(
        _rows("released_orders"),
        F.sum(quantity).cast("double").alias("order_quantity"),
        F.sum(quantity - delivered).cast("double").alias("open_quantity"),
    )


def material_buffer(operations: DataFrame, headers: DataFrame) -> DataFrame:
    """Released orders with an unfinished operation at a work centre, and what is still to be
    made there (target minus actual, chosen here). Operations shrink to one row per order and
    centre before they meet the headers, so counting rows then counts distinct orders. The headers
    hold an order once; a semi join would be moved below the sums by the optimizer."""
    waiting = (
        operations.where(F.col("StatusShort") != "CNF")
        .groupBy("Order", "WorkCenter")
        .agg(F.sum(amount("TargetQuantity") - amount("ActualQuantity")).alias("open_units"))
    )
    released = _released(headers).select("Order")
    return (
        waiting.join(released, "Order")
        .groupBy("WorkCenter")
        .agg(_rows("orders"), F.sum("open_units").cast("double").alias("open_quantity"))
    )


def _open_hours(operations: DataFrame) -> DataFrame:
    return (
        operations.where(F.col("StatusShort") != "CNF")
        .groupBy("WorkCenter")
        .agg(F.sum(amount("SetupTime") + amount("MachineTime")).alias("load_units"))
    )


def utilization(operations: DataFrame, centers: DataFrame) -> DataFrame:
    """Open set-up and machine hours of every centre over its hours per day: days of load
    (chosen here)."""
    load = F.coalesce("load_units", F.lit(0)).cast("double")
    capacity = F.col("TheoreticalCapacityHrDay")
    return centers.join(_open_hours(operations), "WorkCenter", "left").select(
        "WorkCenter",
        load.alias("load_hours"),
        capacity.alias("capacity_hours_per_day"),
        F.try_divide(load, capacity).alias("load_days"),
    )


def actual_utilization(confirmations: DataFrame, centers: DataFrame) -> DataFrame:
    """Confirmed machine hours of a centre and day over its capacity (chosen here)."""
    daily = confirmations.groupBy("WorkCenter", F.to_date("ActualEnd").alias("day")).agg(
        exact_sum("ActualMachineTime").alias("machine_hours")
    )
    capacity = centers.select("WorkCenter", "TheoreticalCapacityHrDay")
    return daily.join(capacity, "WorkCenter", "left").select(
        "WorkCenter",
        "day",
        "machine_hours",
        F.try_divide("machine_hours", "TheoreticalCapacityHrDay").alias("utilization"),
    )


# ---- throughput and precedence ----------------------------------------------------------


def _received(matdoc: DataFrame) -> DataFrame:
    """Goods received per order."""
    receipts = matdoc.where(F.col("MovementType") == GOODS_RECEIPT)
    return receipts.groupBy("Order").agg(exact_sum("Quantity").alias("value"))


def _last_operation(df: DataFrame, column: str) -> DataFrame:
    """Value of the last operation of each order."""
    last = F.max_by(F.col(column), operation_number())
    return df.groupBy("Order").agg(last.alias("value"))


def throughput_compare(matdoc: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Per order: goods received against the yield of its last confirmed operation, and the gap
    (chosen here). Yield is not summed, since every operation reports the same pieces again."""
    stacked = _stack(
        _received(matdoc).withColumnRenamed("value", "real_quantity"),
        _last_operation(confirmations, "YieldQuantity").withColumnRenamed(
            "value", "reported_quantity"
        ),
    )
    return (
        stacked.groupBy("Order")
        .agg(
            F.max("real_quantity").alias("real_quantity"),
            F.max("reported_quantity").alias("reported_quantity"),
        )
        .withColumn("gap", F.col("real_quantity") - F.col("reported_quantity"))
    )


def by_precedence(
    key: str, *sources: tuple[str, DataFrame, Callable[[Column], Column]]
) -> DataFrame:
    """First non-null value per ``key`` in the order of the sources, and its source. A source is a
    name, rows of (key, value), and the aggregate that makes one value of a key's rows. Each gets its
    own column, and all are stacked as they are, so one hash aggregation forms the values and
    decides: a task holds one table of keys, not one for each source."""
    columns = [f"_{name}" for name, _, _ in sources]
    stacked = _stack(
        *[
            df.select(key, F.col("value").alias(column))
            for column, (_, df, _) in zip(columns, sources, strict=True)
        ]
    )
    found = [F.when(F.col(c).isNotNull(), F.lit(c.removeprefix("_"))) for c in columns]
    formed = [form(F.col(c)).alias(c) for c, (_, _, form) in zip(columns, sources, strict=True)]
    return (
        stacked.groupBy(key)
        .agg(*formed)
        .select(key, F.coalesce(*columns).alias("value"), F.coalesce(*found).alias("source"))
        .where(F.col("value").isNotNull())
    )


def delivered_by_precedence(
    matdoc: DataFrame, confirmations: DataFrame, headers: DataFrame, operations: DataFrame
) -> DataFrame:
    """Delivered quantity per order: movements, else confirmations, else header, else operations."""
    receipts = matdoc.where(F.col("MovementType") == GOODS_RECEIPT)

    def numbered(df: DataFrame, column: str) -> DataFrame:
        row = F.struct(F.col(column).alias("value"), operation_number().alias("number"))
        return df.select("Order", row.alias("value"))

    def last(c: Column) -> Column:
        return F.max_by(c["value"], c["number"])

    return by_precedence(
        "Order",
        ("movements", receipts.select("Order", F.col("Quantity").alias("value")), exact_sum),
        ("confirmations", numbered(confirmations, "YieldQuantity"), last),
        ("headers", headers.select("Order", F.col("DeliveredQuantity").alias("value")), F.max),
        ("operations", numbered(operations, "ActualQuantity"), last),
    )


# ---- delay, queue and throughput time ---------------------------------------------------


def delay_profile(
    confirmations: DataFrame,
    by: Sequence[str] = (),
    percents: Sequence[int] = (50, 90),
    limits: Sequence[float] = (1, 8, 24),
) -> DataFrame:
    """Total and mean delay, exact discrete percentiles, and postings within each limit
    (percentiles and limits chosen here). Rows become one count per group and distinct delay
    before anything is ordered."""
    histogram = (
        confirmations.where(F.col("DelayHours").isNotNull())
        .groupBy(*by, "DelayHours")
        .agg(_rows("n"))
    )
    group = W.partitionBy(*by)
    upto = group.orderBy("DelayHours").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(group)
    )
    hours = F.sum(F.col("n").cast("decimal(15,0)") * F.col("DelayHours").cast("decimal(22,12)"))
    hours = hours.cast("double")
    quantiles = [
        F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("DelayHours"))).alias(
            f"p{p}_hours"
        )
        for p in percents
    ]
    within = [
        F.sum(F.when(F.col("DelayHours") <= limit, F.col("n")).otherwise(0)).alias(
            f"within_{limit:g}h"
        )
        for limit in limits
    ]
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("postings"),
        hours.alias("delay_hours"),
        (hours / F.sum("n")).alias("avg_delay_hours"),
        *quantiles,
        *within,
    )


def queue_time(operations: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Wait before every operation but the first (chosen here): planned days from the previous
    finish to the start, and actual hours from the previous real end to the own one, less the
    machine time."""
    rows = joins.with_confirmation(
        operations.select("Order", "Operation", "StartDate", "FinishDate"),
        confirmations.select("Order", "Operation", "ActualEnd", "ActualMachineTime"),
    ).withColumn("_number", operation_number())
    linked = previous_row(
        rows, "Order", "_number", operation_bin(), ["FinishDate", "ActualEnd"], "_before"
    )
    seconds = F.unix_seconds("ActualEnd") - F.unix_seconds("_before.ActualEnd")
    hours = (seconds * SCALE / 3600 - units("ActualMachineTime")) / SCALE
    return linked.where(F.col("_before").isNotNull()).select(
        "Order",
        "Operation",
        F.date_diff("StartDate", "_before.FinishDate").cast("bigint").alias("planned_wait_days"),
        F.round(hours, 4).alias("actual_wait_hours"),
    )


def throughput_time(headers: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Orders and mean hours from planned start to last real end, by month of that end (chosen
    here)."""
    ends = confirmations.groupBy("Order").agg(F.max("ActualEnd").alias("last_end"))
    start = F.unix_seconds(F.col("StartDate").cast("timestamp"))
    return (
        ends.join(headers.select("Order", "StartDate"), "Order")
        .groupBy(period("last_end").alias("Period"))
        .agg(
            _rows("orders"),
            (F.sum(F.unix_seconds("last_end") - start) / F.count("StartDate") / 3600).alias(
                "avg_throughput_hours"
            ),
        )
    )


# ---- prioritisation and bottleneck ------------------------------------------------------


def prioritize(headers: DataFrame, co24: DataFrame, n: int) -> DataFrame:
    """The first ``n`` open released orders: planning relevant, then late, then with most missing
    parts, then by priority (ordering chosen here). The cut is a distributed top-n; only its
    ``n`` rows are numbered."""
    parts = (
        co24.where(F.col("MissingPart") == 1)
        .groupBy("Order")
        .agg(_rows("missing_parts"), exact_sum("ShortageQuantity").alias("shortage_quantity"))
    )
    open_orders = _released(headers).where(F.col("StatusShort").isin("REL", "PCNF"))
    order = [
        F.col("SOP_Relevant").desc(),
        F.col("Backlog").desc(),
        F.col("missing_parts").desc(),
        F.col("Priority").asc(),
        F.col("Order").asc(),
    ]
    top = (
        open_orders.select("Order", "SOP_Relevant", "Backlog", "Priority")
        .join(parts, "Order", "left")
        .fillna({"missing_parts": 0, "shortage_quantity": 0.0})
        .orderBy(*order)
        .limit(n)
    )
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def bottleneck_board(mart) -> DataFrame:
    """One row per bottleneck centre: waiting orders, load, capacity, confirmed output, and the
    missing parts and goods receipts of the orders that pass through it."""
    centers = mart.table(
        "WorkCenters", "WorkCenter", "Bottleneck", "TheoreticalCapacityHrDay"
    ).where(F.col("Bottleneck") == 1)
    keys = centers.select("WorkCenter")
    operations = mart.table(
        "COOIS_OrderOperations",
        "Order",
        "WorkCenter",
        "StatusShort",
        "SetupTime",
        "MachineTime",
    ).join(keys, "WorkCenter", "left_semi")
    headers = mart.table("COOIS_OrderHeaders", "Order", "SystemStatus")
    confirmed = (
        mart.table("COOIS_Confirmations", "WorkCenter", "YieldQuantity", "ScrapQuantity")
        .join(keys, "WorkCenter", "left_semi")
        .groupBy("WorkCenter")
        .agg(
            _rows("confirmations"),
            exact_sum("YieldQuantity").alias("total_yield"),
            exact_sum("ScrapQuantity").alias("total_scrap"),
        )
    )
    missing = (
        mart.table("CO24", "Order", "MissingPart")
        .where(F.col("MissingPart") == 1)
        .groupBy("Order")
        .agg(_rows("missing_parts"))
    )
    received = _received(mart.table("MATDOC", "Order", "MovementType", "Quantity"))
    released = _released(headers).select("Order", F.lit(1).alias("released"))
    per_order = _stack(missing, received, released).groupBy("Order").agg(
        F.max("missing_parts").alias("missing_parts"),
        F.max("value").alias("received"),
        F.max("released").alias("released"),
    )
    # Operations are read once: a row for each order and centre, then for each centre.
    open_ = F.col("StatusShort") != "CNF"
    work = F.when(open_, amount("SetupTime") + amount("MachineTime"))
    through = (
        operations.groupBy("Order", "WorkCenter")
        .agg(F.max(open_).alias("waiting"), F.sum(work).alias("load"))
        .join(per_order, "Order", "left")
        .groupBy("WorkCenter")
        .agg(
            F.nullif(F.count_if(F.col("waiting") & (F.col("released") == 1)), F.lit(0)).alias("buffer_orders"),
            F.sum("load").cast("double").alias("load_hours"),
            _rows("passing_orders"),
            F.sum("missing_parts").alias("missing_parts"),
            exact_sum("received").alias("received_quantity"),
        )
    )
    facts = _stack(confirmed, through)
    values = [c for c in facts.columns if c != "WorkCenter"]
    board = facts.groupBy("WorkCenter").agg(*[F.max(c).alias(c) for c in values])
    return (
        centers.drop("Bottleneck")
        .withColumnRenamed("TheoreticalCapacityHrDay", "capacity_hours_per_day")
        .join(board, "WorkCenter", "left")
    )


# ---- output, planning, stock, status ----------------------------------------------------


def output_by(confirmations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Yield, scrap, rework and times per group with subtotals (chosen here), and scrap rate."""
    sums = subtotal_sums(confirmations, by, OUTPUT, rows="confirmations")
    return sums.withColumn("scrap_rate", F.try_divide("total_scrap", "total_yield"))


def sop_attainment(sop: DataFrame, by: Sequence[str], cube: bool = False) -> DataFrame:
    """Target, actual and deviation per group, and attainment = actual over target (chosen here)."""
    sums = {
        "target_quantity": "TargetQuantity",
        "actual_quantity": "ActualQuantity",
        "deviation": "Deviation",
    }
    totals = subtotal_sums(sop, by, sums, cube=cube)
    return totals.withColumn("attainment", F.try_divide("actual_quantity", "target_quantity"))


def critical_shortage(co24: DataFrame, d_part: DataFrame) -> DataFrame:
    """Missing parts and shortage of critical components by their classes. Lines are summed per
    component before they meet the parts."""
    per_component = (
        co24.where(F.col("MissingPart") == 1)
        .groupBy("Component")
        .agg(_rows("missing_parts"), F.sum(amount("ShortageQuantity")).alias("shortage"))
    )
    critical = d_part.where(F.col("CriticalPart") == 1).select(
        "MATNR", "ABC_Class", "XYZ_Class", "CriticalPart"
    )
    return (
        joins.with_component(per_component, d_part=critical)
        .where(F.col("CriticalPart") == 1)
        .groupBy("ABC_Class", "XYZ_Class")
        .agg(
            _rows("components"),
            F.sum("missing_parts").alias("missing_parts"),
            F.sum("shortage").cast("double").alias("shortage_quantity"),
        )
    )


def stock_cover(co24: DataFrame, mard: DataFrame) -> DataFrame:
    """Shortage of a component in a plant against the stock there (chosen here)."""
    need = (
        co24.where(F.col("MissingPart") == 1)
        .groupBy("Component", "WERKS")
        .agg(exact_sum("ShortageQuantity").alias("shortage_quantity"))
    )
    stock = stock_total(mard).select(
        F.col("MATNR").alias("Component"), "WERKS", F.col("Stock").alias("stock")
    )
    on_hand = F.coalesce("stock", F.lit(0.0))
    covered = F.least(F.col("shortage_quantity"), on_hand)
    return need.join(stock, ["Component", "WERKS"], "left").select(
        "Component",
        "WERKS",
        "shortage_quantity",
        on_hand.alias("stock_quantity"),
        covered.alias("covered_quantity"),
        (units(F.col("shortage_quantity")) / SCALE - covered).alias("uncovered_quantity"),
    )


def status_mix(headers: DataFrame) -> DataFrame:
    """Orders by status and their share; the window runs over one row per status."""
    counts = headers.groupBy("StatusShort").agg(_rows("orders"))
    total = F.sum("orders").over(W.partitionBy())
    return counts.withColumn("share", F.col("orders") / total)


def by_hierarchy(mart, measures: Sequence[Measure], level: int) -> DataFrame:
    """Measures of one fact at a level of the product hierarchy. Partial sums per node climb to
    their ancestor, so ratios are formed from sums at that level; nodes above it, and rows
    without a node, meet in the null row."""
    facts = {m.fact for m in measures}
    if len(facts) != 1:
        raise ValueError("measures of one fact are needed")
    if not all(part.additive for m in measures for part in m.parts):
        raise ValueError("distinct counts of nodes can't be summed to their ancestor's")
    node = "ProductHierarchy.ProductHierarchy"
    sums = partial_sums(mart, facts.pop(), measures, [node], {})
    above = joins.ancestors_at_level(mart.table("ProductHierarchy"), level)
    climbed = sums.join(above, F.col("ProductHierarchy") == F.col("node"), "left")
    return finish(measures, climbed, ["ancestor", "ancestor_text"])


def consumption(
    matdoc: DataFrame, types: DataFrame, by: Sequence[str] = ("Order", "Matnr")
) -> DataFrame:
    """Goods issued, received and net quantity; transfers move nothing. The few types are joined
    to the rows first, so that a movement is shuffled once, for its sum."""
    signed = joins.with_movement_type(matdoc.select(*by, "MovementType", "Quantity"), types)
    moved = amount("SignedQuantity")
    return signed.groupBy(*by).agg(
        F.sum(F.when(F.col("Direction") == "GI", -moved).otherwise(0)).cast("double").alias("issued"),
        F.sum(F.when(F.col("Direction") == "GR", moved).otherwise(0)).cast("double").alias("received"),
        F.sum(moved).cast("double").alias("net"),
    )
