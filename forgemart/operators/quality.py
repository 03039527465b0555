"""Data-quality checks. Each returns the violating rows; valid data returns none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart import fixed_values as fixed
from forgemart.functions import derivations as D
from forgemart.operators.sequences import previous_row
from forgemart.operators.totals import stock_total
from forgemart.sources import schema as S

OPERATIONS_PER_BIN = 10_000


def operation_number(c: str = "Operation") -> Column:
    """Operations are numbered in tens; compared as numbers, since text puts 10000 before 9990."""
    return F.col(c).cast("bigint")


def operation_bin() -> Column:
    return F.floor(operation_number() / (10 * OPERATIONS_PER_BIN))


def _differs(a: Column | str, b: Column) -> Column:
    return ~(F.col(a) if isinstance(a, str) else a).eqNullSafe(b)


def check_k1(co24: DataFrame) -> DataFrame:
    """Stored shortage and flag follow from the quantities."""
    expected = D.shortage("Reqmnt_qty", "Comm_qty", "Qty_issued")
    return co24.withColumn("ExpectedShortage", expected).where(
        _differs("ShortageQuantity", F.col("ExpectedShortage"))
        | _differs("MissingPart", D.missing_part("ExpectedShortage"))
    )


def check_k2(confirmations: DataFrame) -> DataFrame:
    """Stored delay is the time between the event and its posting, which comes later."""
    expected = D.delay_hours("ActualEnd", "SAP_PostingTime")
    return confirmations.withColumn("ExpectedDelay", expected).where(
        _differs("DelayHours", F.col("ExpectedDelay"))
        | (F.col("SAP_PostingTime") < F.col("ActualEnd"))
    )


def check_k3(headers: DataFrame, as_of: str) -> DataFrame:
    """Stored backlog flag holds at ``as_of``."""
    expected = D.backlog_flag("StatusShort", "FinishDate", as_of)
    return headers.withColumn("ExpectedBacklog", expected).where(
        _differs("Backlog", F.col("ExpectedBacklog"))
    )


def check_k4(headers: DataFrame) -> DataFrame:
    """Status string belongs to the status code."""
    return headers.where(_differs("SystemStatus", D.system_status("StatusShort")))


def check_k5(headers: DataFrame) -> DataFrame:
    """Delivered quantity fits the status and never exceeds the order quantity."""
    delivered, quantity = D.exact("DeliveredQuantity"), D.exact("OrderQuantity")
    status = F.col("StatusShort")
    wrong = (
        F.when(status.isin(*fixed.FINISHED_STATUSES), _differs(delivered, quantity))
        .when(status.isin("CRTD", "REL"), delivered != 0)
        .otherwise((delivered < 0) | (delivered > quantity))
    )
    return headers.where(wrong)


def check_k6(centers: DataFrame) -> DataFrame:
    """Stored capacity follows from utilisation, shift hours and units."""
    expected = D.capacity("NGRAD", "EINZH", "AZNOR")
    return centers.withColumn("ExpectedCapacity", expected).where(
        _differs("TheoreticalCapacityHrDay", F.col("ExpectedCapacity"))
    )


def check_k7(sop: DataFrame) -> DataFrame:
    """Stored deviation is actual minus target."""
    expected = D.sop_deviation("ActualQuantity", "TargetQuantity")
    return sop.withColumn("ExpectedDeviation", expected).where(
        _differs("Deviation", F.col("ExpectedDeviation"))
    )


def check_k8(
    headers: DataFrame,
    lead_days: tuple[int, int | None] = (0, None),
    span_days: tuple[int, int | None] = (0, None),
) -> DataFrame:
    """Start doesn't precede creation, nor finish start; ``lead_days`` and ``span_days`` are the
    least and most days allowed between them, without a limit where None."""
    def outside(days: Column, least: int, most: int | None) -> Column:
        return (days < least) if most is None else ~days.between(least, most)

    lead = F.date_diff("StartDate", "CreationDate")
    span = F.date_diff("FinishDate", "StartDate")
    return headers.where(outside(lead, *lead_days) | outside(span, *span_days))


def check_k9(operations: DataFrame) -> DataFrame:
    """A confirmed operation never follows an unconfirmed one of its order. Operations without an
    order follow nothing."""
    rows = operations.withColumn("_number", operation_number())
    linked = previous_row(
        rows, "Order", "_number", operation_bin(), ["Operation", "StatusShort"], "_before"
    )
    return (
        linked.where((F.col("StatusShort") == "CNF") & (F.col("_before.StatusShort") != "CNF"))
        .withColumn("PreviousOperation", F.col("_before.Operation"))
        .withColumn("PreviousStatus", F.col("_before.StatusShort"))
        .drop("_number", "_before")
    )


def check_k10(
    operations: DataFrame,
    confirmations: DataFrame,
    allowed: Sequence[str] = fixed.CONFIRMED_OPERATION_STATUSES,
) -> DataFrame:
    """Confirmations of operations that are not confirmed, and operations confirmed twice. Both sides
    are stacked and counted by one hash aggregation, which sorts nothing. An operation without one
    of its keys confirms nothing."""
    keys = ["Order", "Operation"]
    allowing = operations.where(F.col("StatusShort").isin(*allowed)).dropna(subset=keys)
    stacked = confirmations.select(*keys, F.lit(1).alias("posted"), F.lit(0).alias("allowed")).unionByName(
        allowing.select(*keys, F.lit(0).alias("posted"), F.lit(1).alias("allowed"))
    )
    per_operation = (
        stacked.groupBy(*keys)
        .agg(F.sum("posted").alias("confirmations"), F.max("allowed").alias("allowed"))
        .where("confirmations > 0")
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("allowed") == 0, "not confirmable"),
            F.when(F.col("confirmations") > 1, "confirmed twice"),
        )
    )
    return per_operation.select(*keys, "confirmations", F.explode(rules).alias("rule"))


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row carries."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .select(F.lit(table).alias("table"), key.alias("key"), "rows")
    )


def check_k11(mart, keys: Mapping[str, Sequence[str]] = S.KEYS) -> DataFrame:
    """Repeated keys of every table that has one."""
    found = [duplicate_keys(mart.table(t, *k), t, k) for t, k in keys.items()]
    return reduce(DataFrame.unionByName, found)


def check_k12(mard: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock snapshot equals the stock of all storage locations, on both sides."""
    total = stock_total(mard).withColumnRenamed("Stock", "LocationStock")
    snapshot = stock.select(F.col("Part").alias("MATNR"), "WERKS", "Stock")
    both = snapshot.join(total, ["MATNR", "WERKS"], "full")
    return both.where(_differs("Stock", F.col("LocationStock")))
