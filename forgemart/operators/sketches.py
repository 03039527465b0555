"""Summaries of fixed size that can be stored per small group and merged upwards: quantile sketches
and bitmaps of numbered values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgemart.sources.steps import written

BINS = 4096  # in which values are numbered
WORD = 64  # numbers whose bits are kept in one bigint

# ---- quantiles --------------------------------------------------------------------------


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """(by, rows, sketch): a KLL sketch of the non-null values of each group. Its size follows ``k``,
    not the rows; a quantile's rank is off by 1.3 / k ^ 0.9 or so."""
    known = df.where(F.col(value).isNotNull())
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), k)
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of larger groups from those of smaller ones; no row is read again."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantile(percent: float) -> Column:
    """The value at a percentile of a group's ``sketch``."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(percent / 100))


def quantile_errors(df: DataFrame, sketches: DataFrame, by: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """(by, rows, off_<percent>): how far the sketch's quantile is from the rank it stands for, as a
    share of the group's rows; 0 where it is one of the exact quantiles. Measured on counts of
    distinct values."""
    names = {p: f"q_{p:g}" for p in percents}
    found = sketches.select(*by, "rows", *[quantile(p).alias(n) for p, n in names.items()])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    both = counts.alias("l").join(found.alias("r"), same).select("l.*", "rows", *names.values())
    sums = []
    for p, name in names.items():
        below = F.sum(F.when(F.col(value) < F.col(name), F.col("n")).otherwise(0))
        upto = F.sum(F.when(F.col(value) <= F.col(name), F.col("n")).otherwise(0))
        rank = F.col("rows") * p / 100
        sums.append((F.greatest(below - F.max(rank), F.max(rank) - upto, F.lit(0)) / F.max("rows")).alias(f"off_{p:g}"))
    return both.groupBy(*by).agg(F.max("rows").alias("rows"), *sums)


# ---- distinct values --------------------------------------------------------------------


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, number) of the distinct non-null values: 0, 1, 2 … without gaps, for bitmaps.

    Values are numbered inside bins by their hash, and bins follow one another by their counts, so no
    task orders all values. Written down, so that a number stays a value's."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = values.withColumn("_bin", F.pmod(F.xxhash64(column), F.lit(BINS)))
    sizes = values.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_bin", F.coalesce(before, F.lit(0)).alias("_start"))  # a row a bin
    place = F.row_number().over(W.partitionBy("_bin").orderBy(column)) - 1
    rows = values.withColumn("_place", place).join(starts, "_bin")
    return written(rows.select(column, (F.col("_start") + F.col("_place")).alias("number")))


def value_bitmaps(df: DataFrame, by: Sequence[str], number: str = "number") -> DataFrame:
    """(by, bucket, bits): which numbers occur in each group, 64 of them to a bucket, whose bits are
    one whole number. A group has a row only for buckets that it has numbers in, so that small groups
    take what their values take and not a page of zeros each, and hashing sums them up in place."""
    known = df.where(F.col(number).isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD)).cast("int"))
    return known.groupBy(*by, F.shiftright(F.col(number).cast("bigint"), 6).alias("bucket")).agg(
        F.bit_or(bit).alias("bits")
    )


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of larger groups from those of smaller ones."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bit_or("bits").alias("bits"))


def bitmap_counts(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """How many distinct values each group has; ``by`` are the bitmaps' own group columns."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bit_count("bits").cast("bigint")).alias(name))
