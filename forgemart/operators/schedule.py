"""Forward schedule of the operations of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.functions.derivations import op_duration
from forgemart.operators.quality import operation_bin, operation_number
from forgemart.operators.sequences import running_total


def schedule(operations: DataFrame, gap_hours: Column | float) -> DataFrame:
    """Add ``ScheduledStart`` and ``ScheduledEnd``. Each operation starts ``gap_hours`` after the
    previous one ends; the first starts at ``OrderStart``. Time runs in whole seconds, so the
    running total is exact."""
    gap = gap_hours if isinstance(gap_hours, Column) else F.lit(gap_hours)
    seconds = F.rint(op_duration("SetupTime", "MachineTime") * 86_400).cast("bigint")
    timed = operations.select(
        "*",
        operation_number().alias("_number"),
        seconds.alias("_seconds"),
        (seconds + F.rint(gap * 3600).cast("bigint")).alias("_step"),
    )
    placed = running_total(timed, "Order", "_number", operation_bin(), "_step", "_before")
    start = F.unix_seconds(F.col("OrderStart").cast("timestamp")) + F.col("_before")
    return placed.select(
        *operations.columns,
        F.timestamp_seconds(start).alias("ScheduledStart"),
        F.timestamp_seconds(start + F.col("_seconds")).alias("ScheduledEnd"),
    )
