"""Joins between tables that no model relationship covers, and order selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.functions.derivations import is_released, signed_quantity
from forgemart.operators.skew import lookup
from forgemart.sources.steps import written


def orders_with_missing_parts(co24: DataFrame) -> DataFrame:
    """Distinct orders with a missing part; reduced before any join, so an order with very
    many components is one row there."""
    return co24.where(F.col("MissingPart") == 1).select("Order").distinct()


def waiting_orders(headers: DataFrame, co24: DataFrame) -> DataFrame:
    """Orders that wait for at least one part."""
    return headers.join(orders_with_missing_parts(co24), "Order", "left_semi")


def clean_orders(headers: DataFrame, co24: DataFrame) -> DataFrame:
    """Released orders that miss no part."""
    released = headers.where(is_released("SystemStatus"))
    return released.join(orders_with_missing_parts(co24), "Order", "left_anti")


def with_movement_type(matdoc: DataFrame, types: DataFrame) -> DataFrame:
    """Movements with sign, direction and signed quantity."""
    kinds = types.select("MovementType", "Sign", "Direction")
    return matdoc.join(kinds, "MovementType", "left").withColumn(
        "SignedQuantity", signed_quantity("Quantity", "Sign")
    )


def with_component(
    co24: DataFrame,
    mara: DataFrame | None = None,
    d_part: DataFrame | None = None,
) -> DataFrame:
    """Missing-part lines with the component's material and part attributes."""
    df = co24
    for master in (mara, d_part):
        if master is not None:
            clashes = {c: f"Component{c}" for c in master.columns if c in df.columns}
            attributes = master.withColumnsRenamed(clashes).withColumnRenamed("MATNR", "_key")
            df = lookup(df, attributes, "Component", "_key").drop("_key")
    return df


def with_confirmation(operations: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Operations with their confirmation; both keys together, so one large order is spread
    over many tasks."""
    keys = ["Order", "Operation"]
    clashes = {
        c: f"Confirmed{c}"
        for c in confirmations.columns
        if c in operations.columns and c not in keys
    }
    return operations.join(confirmations.withColumnsRenamed(clashes), keys, "left")


def with_stock(marc: DataFrame, stock: DataFrame) -> DataFrame:
    """Plant materials with their stock snapshot."""
    snapshot = stock.withColumnRenamed("Part", "MATNR")
    return marc.join(snapshot, ["MATNR", "WERKS"], "left")


def with_controller(headers: DataFrame, marc: DataFrame, controllers: DataFrame) -> DataFrame:
    """Orders with the controller responsible for their material in their plant."""
    plant_data = marc.select(F.col("MATNR").alias("Material"), "WERKS", "DISPO")
    people = controllers.select("DISPO", F.col("Name").alias("Controller"), "ResponsibilityArea")
    return headers.join(plant_data, ["Material", "WERKS"], "left").join(people, "DISPO", "left")


def ancestors(hierarchy: DataFrame) -> DataFrame:
    """Every (node, ancestor, distance) of a parent/child table, each once with its least distance,
    the node itself included.

    Paths double: pairs known up to a distance are continued, from those at that very distance, by
    all of them, so a walk of any depth takes as many steps as its binary logarithm, each a join
    that is written down. A path that meets its start, or a pair known at less distance, ends there:
    cycles and several parents are allowed. The jobs run while the result is built.
    """
    node = F.col("ProductHierarchy")
    own = hierarchy.select(node.alias("node"), node.alias("ancestor"), F.lit(0).alias("distance"))
    up = hierarchy.where(node != F.col("Parent"))
    known = written(
        up.select(node.alias("node"), F.col("Parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    )
    reach = 1
    while not known.where(F.col("distance") == reach).isEmpty():
        far = known.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("middle"))
        onward = known.select(F.col("node").alias("middle"), "ancestor", "distance")
        further = (
            far.join(onward, "middle")
            .where("node != ancestor")
            .select("node", "ancestor", (F.col("distance") + reach).alias("distance"))
        )
        pairs = known.union(further).groupBy("node", "ancestor")
        known = written(pairs.agg(F.min("distance").alias("distance")))
        reach *= 2
    return own.distinct().union(known)


def ancestors_at_level(hierarchy: DataFrame, level: int) -> DataFrame:
    """(node, ancestor, ancestor_text): the first ancestor of each node at ``level``, nodes there
    being their own; nodes above it have none. A node has one parent.

    Every node points to its parent, those at the level to themselves; pointers are then replaced by
    their pointers' pointers, one row a node, until all have arrived or, in cycles and branches that
    miss the level, as many steps have been made as the hierarchy can have levels.
    """
    node, here = F.col("ProductHierarchy"), F.coalesce(F.col("Level") == level, F.lit(False))
    pointers = written(
        hierarchy.select(
            node.alias("node"), F.when(here, node).otherwise(F.col("Parent")).alias("ancestor"), here.alias("there")
        ).where("ancestor IS NOT NULL")
    )
    for _ in range(pointers.count().bit_length()):
        if pointers.where("NOT there").isEmpty():
            break
        onward = pointers.select(F.col("node").alias("middle"), F.col("ancestor").alias("next"), F.col("there").alias("arrived"))
        pointers = written(
            pointers.join(onward, F.col("ancestor") == F.col("middle")).select(
                "node", F.col("next").alias("ancestor"), F.col("arrived").alias("there")
            )
        )
    levels = hierarchy.where(here).select(node.alias("ancestor"), F.col("Description").alias("ancestor_text"))
    return pointers.where("there").join(levels, "ancestor").select("node", "ancestor", "ancestor_text")
