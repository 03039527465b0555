"""Idle times of work centres: what their merged busy intervals leave free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.operators.sequences import running_max

DAY, HOUR = 86_400, 3_600
BIN = 28 * DAY


def busy_intervals(confirmations: DataFrame) -> DataFrame:
    """(WorkCenter, begin, end) in seconds: a confirmation occupies its centre for its machine time
    up to its real end (chosen here). Rows without a centre, an end or machine time occupy none."""
    taken = F.round(F.col("ActualMachineTime") * HOUR).cast("bigint")
    end = F.unix_seconds("ActualEnd")
    return (
        confirmations.where(F.col("WorkCenter").isNotNull())
        .select("WorkCenter", (end - taken).alias("begin"), end.alias("end"))
        .where("end > begin")
    )


def _reached(intervals: DataFrame) -> DataFrame:
    """Adds the latest end of those intervals of a centre that begin before.

    Intervals are ordered by begin inside bins of four weeks; the latest end so far is carried from
    bin to bin, so that a centre that holds a third of all rows is spread over its bins. Shorter
    bins would hold a row or two of most centres, and the carry as many rows as there are intervals."""
    return running_max(
        intervals, "WorkCenter", "begin", F.floor(F.col("begin") / BIN), "end", "reached"
    )


def gaps(intervals: DataFrame) -> DataFrame:
    """(WorkCenter, begin, end) of the stretches between a centre's first begin and last end in which
    none of its intervals runs. Intervals may overlap, repeat and hold one another."""
    return _reached(intervals).where("begin > reached").select(
        "WorkCenter", F.col("reached").alias("begin"), F.col("begin").alias("end")
    )


def _stretches(intervals: DataFrame) -> DataFrame:
    """(WorkCenter, begin, end, free): the time between a centre's first begin and last end, cut into
    stretches without overlaps in which it is free, or busy."""
    start = F.greatest("begin", "reached")  # of what an interval adds; leaves out null
    free = F.struct(F.col("reached").alias("begin"), F.col("begin").alias("end"), F.lit(True).alias("free"))
    busy = F.struct(start.alias("begin"), F.col("end").alias("end"), F.lit(False).alias("free"))
    both = F.array(F.when(F.expr("begin > reached"), free), F.when(F.col("end") > start, busy))
    return _reached(intervals).select("WorkCenter", F.inline(F.array_compact(both)))


def _day(seconds: Column) -> Column:
    return F.floor(seconds / DAY).cast("bigint")


def _by_day(stretches: DataFrame) -> DataFrame:
    """Stretches cut at midnight: (WorkCenter, day, free, seconds)."""
    days = F.sequence(_day(F.col("begin")), _day(F.col("end") - 1))
    start = F.col("day") * DAY
    seconds = F.least("end", start + DAY) - F.greatest("begin", start)
    return stretches.withColumn("day", F.explode(days)).select(
        "WorkCenter", "day", "free", seconds.alias("seconds")
    )


def idle_time(confirmations: DataFrame) -> DataFrame:
    """Busy and idle hours and the longest gap of every centre on each day from its first begin to
    its last end; days count from midnight in UTC, gaps are cut there.

    A day that is free as a whole has one stretch, and is a result as it is. Only days on which
    something begins or ends are shuffled and summed, so that memory follows the confirmations and
    not the calendar of all centres."""
    cut = _by_day(_stretches(busy_intervals(confirmations)))
    whole = F.col("free") & (F.col("seconds") == DAY)
    seconds, free = F.col("seconds"), F.col("free")
    mixed = (
        cut.where(~whole)
        .groupBy("WorkCenter", "day")
        .agg(
            F.sum(F.when(free, 0).otherwise(seconds)).alias("busy"),
            F.sum(F.when(free, seconds).otherwise(0)).alias("idle"),
            F.max(F.when(free, seconds).otherwise(0)).alias("longest"),
        )
    )
    idle_days = cut.where(whole).select(
        "WorkCenter", "day", F.lit(0).cast("bigint").alias("busy"), seconds.alias("idle"), seconds.alias("longest")
    )
    return mixed.unionByName(idle_days).select(
        "WorkCenter",
        F.date_from_unix_date(F.col("day").cast("int")).alias("day"),
        (F.col("busy") / HOUR).alias("busy_hours"),
        (F.col("idle") / HOUR).alias("idle_hours"),
        (F.col("longest") / HOUR).alias("longest_gap_hours"),
    )
