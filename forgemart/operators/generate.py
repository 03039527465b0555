"""Operators that make rows: routings, storage locations, periods and the planning grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart import fixed_values as fixed


def expand_routing(
    orders: DataFrame, routings: Mapping[str, Sequence[str]] = fixed.ROUTINGS
) -> DataFrame:
    """One row per order and step of its product group's routing: ``position`` 1…n, ``role``.

    The routings are a map literal, so orders are not shuffled; a group without a routing
    yields no rows.
    """
    pairs = [
        item
        for group, roles in routings.items()
        for item in (F.lit(group), F.array(*[F.lit(r) for r in roles]))
    ]
    route = F.try_element_at(F.create_map(*pairs), F.col("ProductGroup"))
    return orders.select("*", F.posexplode(route).alias("_pos", "role")).select(
        *orders.columns, (F.col("_pos") + 1).cast("bigint").alias("position"), "role"
    )


def expand_locations(
    materials: DataFrame, locations: Sequence[str] = fixed.STORAGE_LOCATIONS
) -> DataFrame:
    """One row per material and storage location."""
    return materials.select(
        "*", F.explode(F.array(*[F.lit(x) for x in locations])).alias("LGORT")
    )


def periods(df: DataFrame, start: Column, n: Column | int) -> DataFrame:
    """Every row once per month: ``n`` consecutive yyyyMM periods from the month of ``start``."""
    first = F.trunc(start, "month")
    count = n if isinstance(n, Column) else F.lit(n)
    months = F.sequence(first, F.add_months(first, count - 1), F.expr("interval 1 month"))
    return df.select("*", F.explode(months).alias("_month")).select(
        *df.columns, F.date_format("_month", "yyyyMM").alias("Period")
    )


def sop_grid(
    groups: DataFrame, start: Column, n: Column | int, plants: Sequence[str] = fixed.PLANTS
) -> DataFrame:
    """Every product group × period × plant. Periods and plants are exploded literals, so the
    grid needs no product join."""
    return periods(groups.select("ProductGroup"), start, n).select(
        "*", F.explode(F.array(*[F.lit(p) for p in plants])).alias("WERKS")
    )
