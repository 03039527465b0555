"""Ordered computations inside a key (row number, running total, previous row) that survive a key
holding a large part of all rows.

There is one route for every key and size: rows are windowed by (key, bin), where bins follow the
sort order, and a summary of one row for each bin carries the state from a key's bins into the
next. Keys of one bin, which is most keys, have no carry, so that the summary that is joined back
holds later bins alone. Rows that agree in key and bin stay together. Rows without a key are in no
sequence: they are dealt out by what they hold, and their result is null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgemart.operators.skew import spread


def _binned(df: DataFrame, key: str, bin_of: Column) -> DataFrame:
    known = F.col(key).isNotNull()
    return df.withColumn("_bin", F.when(known, bin_of.cast("bigint")).otherwise(spread(df)))


def _carried(rows: DataFrame, key: str, summary: Column, carry: Column) -> DataFrame:
    """(key, bin, state that enters the bin) of all bins but a key's first."""
    before = W.partitionBy(key).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key, "_bin")
        .agg(summary.alias("_summary"))
        .select(
            F.col(key).alias("_key"),
            F.col("_bin").alias("_at"),
            carry.over(before).alias("_carry"),
            F.row_number().over(W.partitionBy(key).orderBy("_bin")).alias("_place"),
        )
        .where("_place > 1")
        .drop("_place")
    )


def _with_carry(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    same = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at"))
    return rows.join(carried, same, "left").drop("_key", "_at")


def _known(key: str, value: Column) -> Column:
    return F.when(F.col(key).isNotNull(), value)


def row_numbers(
    df: DataFrame, key: str, order: Sequence[str], bin_of: Column, name: str
) -> DataFrame:
    """Add 1, 2, 3 … per ``key`` in the order of ``order``, which orders a key's rows totally.
    ``bin_of`` must grow with that order."""
    rows = _binned(df, key, bin_of)
    carried = _carried(rows, key, F.count(F.lit(1)), F.sum("_summary"))
    inside = F.row_number().over(W.partitionBy(key, "_bin").orderBy(*order)).cast("bigint")
    placed = _with_carry(rows.withColumn(name, inside), carried, key)
    number = F.col(name) + F.coalesce("_carry", F.lit(0))
    return placed.withColumn(name, _known(key, number)).drop("_bin", "_carry")


def key_bins(
    df: DataFrame, key: str, bin_of: Column, sums: Mapping[str, tuple[Column, Callable[[str], Column]]]
) -> DataFrame:
    """(_key, _at, _place, _carry, sums): one row for each bin of a key, with the place of the bin,
    the rows of the key in earlier bins, and aggregates over the whole key, each given as that of a
    bin and as what makes one of several bins' aggregates."""
    whole = W.partitionBy(key)
    before = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    known = _binned(df, key, bin_of).where(F.col(key).isNotNull())
    parts = known.groupBy(key, "_bin").agg(
        F.count(F.lit(1)).alias("_rows"), *[part.alias(name) for name, (part, _) in sums.items()]
    )
    return parts.select(
        F.col(key).alias("_key"),
        F.col("_bin").alias("_at"),
        F.row_number().over(whole.orderBy("_bin")).alias("_place"),
        F.sum("_rows").over(before).alias("_carry"),
        *[merge(name).over(whole).alias(name) for name, (_, merge) in sums.items()],
    )


def numbered_with(
    df: DataFrame, key: str, order: Sequence[str], bin_of: Column, name: str, bins: DataFrame
) -> DataFrame:
    """``row_numbers``, and the further columns of the row that ``bins``, made by ``key_bins`` of the
    same bins, has for a row's key: rows are shuffled once for both."""
    rows = _binned(df, key, bin_of)
    inside = F.row_number().over(W.partitionBy(key, "_bin").orderBy(*order)).cast("bigint")
    placed = _with_carry(rows.withColumn(name, inside), bins.drop("_place"), key)
    number = F.col(name) + F.coalesce("_carry", F.lit(0))
    return placed.withColumn(name, _known(key, number)).drop("_bin", "_carry")


def running_total(
    df: DataFrame, key: str, order_by: str, bin_of: Column, value: str, name: str
) -> DataFrame:
    """Add the sum of ``value`` over the rows of ``key`` that precede the row."""
    rows = _binned(df, key, bin_of)
    carried = _carried(rows, key, F.sum(value), F.sum("_summary"))
    before = W.partitionBy(key, "_bin").orderBy(order_by)
    inside = F.sum(value).over(before.rowsBetween(W.unboundedPreceding, -1))
    placed = _with_carry(rows.withColumn(name, F.coalesce(inside, F.lit(0))), carried, key)
    total = F.col(name) + F.coalesce("_carry", F.lit(0))
    return placed.withColumn(name, _known(key, total)).drop("_bin", "_carry")


def running_max(
    df: DataFrame, key: str, order_by: str, bin_of: Column, value: str, name: str
) -> DataFrame:
    """Add the greatest ``value`` of the rows of ``key`` that precede the row, null on the first."""
    rows = _binned(df, key, bin_of)
    carried = _carried(rows, key, F.max(value), F.max("_summary"))
    before = W.partitionBy(key, "_bin").orderBy(order_by)
    inside = F.max(value).over(before.rowsBetween(W.unboundedPreceding, -1))
    placed = _with_carry(rows.withColumn(name, inside), carried, key)
    return placed.withColumn(name, _known(key, F.greatest(name, "_carry"))).drop("_bin", "_carry")


def previous_row(
    df: DataFrame, key: str, order_by: str, bin_of: Column, fields: Sequence[str], name: str
) -> DataFrame:
    """Add a struct ``name`` with ``fields`` of the row before, null on the first row."""
    row = F.struct(*fields)
    rows = _binned(df, key, bin_of)
    carried = _carried(rows, key, F.max_by(row, F.col(order_by)), F.last("_summary"))
    inside = F.lag(row).over(W.partitionBy(key, "_bin").orderBy(order_by))
    placed = _with_carry(rows.withColumn(name, inside), carried, key)
    return placed.withColumn(name, _known(key, F.coalesce(name, "_carry"))).drop("_bin", "_carry")
