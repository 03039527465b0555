"""Totals over one fact: default sums, confirmation output, stock, and subtotal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.functions.derivations import amount
from forgemart.functions.measures import exact_sum
from forgemart.sources import schema as S


def implicit_sum(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Default aggregate of a table's numeric columns. All of them sum, also those where a sum
    says little, such as a utilisation percentage or a hierarchy level."""
    return df.agg(*[exact_sum(c).alias(c) for c in columns or S.summable_columns(table)])


def subtotal_sums(
    df: DataFrame,
    by: Sequence[str],
    sums: Mapping[str, str],
    rows: str | None = None,
    cube: bool = False,
) -> DataFrame:
    """Sums per group with subtotals: ``sums`` is {result: column}, ``rows`` names a row count.

    Rows are grouped fully first, and only these groups are rolled up (or cubed). The
    ``subtotal_level`` is 0 for a plain group and has one bit per group column summed over.
    """
    first: list[Column] = [F.sum(amount(c)).alias(name) for name, c in sums.items()]
    if rows:
        first.append(F.count(F.lit(1)).alias(rows))
    groups = df.groupBy(*by).agg(*first)
    grouped = groups.cube(*by) if cube else groups.rollup(*by)
    second = [F.sum(name).cast("double").alias(name) for name in sums]
    if rows:
        second.append(F.sum(rows).alias(rows))
    return grouped.agg(F.grouping_id().alias("subtotal_level"), *second)


OUTPUT = {
    "total_yield": "YieldQuantity",
    "total_scrap": "ScrapQuantity",
    "total_rework": "ReworkQuantity",
    "machine_hours": "ActualMachineTime",
    "labor_hours": "ActualLaborTime",
}


def output_totals(confirmations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Yield, scrap, rework, machine and labour hours together in one pass."""
    return confirmations.groupBy(*by).agg(
        *[exact_sum(c).alias(name) for name, c in OUTPUT.items()]
    )


def stock_total(mard: DataFrame) -> DataFrame:
    """Stock of a material in a plant, over its storage locations."""
    return mard.groupBy("MATNR", "WERKS").agg(exact_sum("LABST").alias("Stock"))
