"""The relationship model: many-to-one edges, paths along them, and joins that follow them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.sources import schema as S


@dataclass(frozen=True)
class Edge:
    name: str
    many: str
    many_key: str
    one: str
    one_key: str


# The relationships of the model, each from a many side to a one side.
EDGES = (
    Edge("J0", "MARC", "MATNR", "MARA", "MATNR"),
    Edge("J1", "MARD", "MATNR", "MARA", "MATNR"),
    Edge("J2", "D_Part", "MATNR", "MARA", "MATNR"),
    Edge("J3", "MARA", "ProductGroup", "ProductGroup", "ProductGroup"),
    Edge("J4", "MARA", "PRDHA", "ProductHierarchy", "ProductHierarchy"),
    Edge("J5", "MARC", "DISPO", "MRP_Cntr", "DISPO"),
    Edge("J6", "COOIS_OrderHeaders", "Material", "MARA", "MATNR"),
    Edge("J7", "COOIS_OrderOperations", "Order", "COOIS_OrderHeaders", "Order"),
    Edge("J8", "COOIS_OrderOperations", "WorkCenter", "WorkCenters", "WorkCenter"),
    Edge("J9", "COOIS_Confirmations", "Order", "COOIS_OrderHeaders", "Order"),
    Edge("J10", "COOIS_Confirmations", "WorkCenter", "WorkCenters", "WorkCenter"),
    Edge("J11", "CO24", "Order", "COOIS_OrderHeaders", "Order"),
    Edge("J12", "MATDOC", "Order", "COOIS_OrderHeaders", "Order"),
    Edge("J13", "SOP_Targets", "ProductGroup", "ProductGroup", "ProductGroup"),
)


def edge(name: str) -> Edge:
    return next(e for e in EDGES if e.name == name)


def path(fact: str, dim: str) -> tuple[Edge, ...]:
    """Edges that lead from a fact to a dimension. A filter travels only from the one side to
    the many side, so a table that is no one side on the way cannot be reached."""
    if fact == dim:
        return ()
    found = [
        (e, *rest)
        for e in EDGES
        if e.many == fact and (rest := _path_or_none(e.one, dim)) is not None
    ]
    if not found:
        raise ValueError(f"{dim} cannot be reached from {fact}")
    return min(found, key=len)


def _path_or_none(table: str, dim: str) -> tuple[Edge, ...] | None:
    try:
        return path(table, dim)
    except ValueError:
        return None


def narrow_column(table: str) -> str:
    """A column that is cheap to read when only rows are counted."""
    return next((e.many_key for e in EDGES if e.many == table), S.column_names(table)[0])


def prefixed(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns renamed to ``Table.column``, so tables that share names can be joined."""
    return df.select(*[F.col(c).alias(f"{table}.{c}") for c in columns or df.columns])


def dotted(name: str) -> Column:
    return F.col(f"`{name}`")


def follow(df: DataFrame, mart, e: Edge, columns: Sequence[str] = ()) -> DataFrame:
    """Left join one edge. ``df`` has prefixed columns; unmatched rows keep nulls. Spark
    broadcasts the one side only when it knows it to be small; otherwise both sides are
    shuffled on the key and adaptive execution splits an overlarge key."""
    needed = tuple(dict.fromkeys((e.one_key, *columns)))
    one = prefixed(mart.table(e.one, *needed), e.one, needed)
    return df.join(one, dotted(f"{e.many}.{e.many_key}") == dotted(f"{e.one}.{e.one_key}"), "left")


def join_edge(
    mart, name: str, many: Sequence[str] = (), one: Sequence[str] = ()
) -> DataFrame:
    """Fact rows with the matching dimension row beside them."""
    e = edge(name)
    many_columns = tuple(dict.fromkeys((e.many_key, *many)))
    return follow(prefixed(mart.table(e.many, *many_columns), e.many), mart, e, one)


def widen(
    mart, fact: str, columns: Sequence[str], dim_columns: Sequence[str]
) -> DataFrame:
    """Fact rows with ``Table.column`` values of any reachable dimensions."""
    wanted = [c.split(".", 1) for c in dim_columns]
    edges = list(dict.fromkeys(e for table, _ in wanted for e in path(fact, table)))
    keys = [e.many_key for e in edges if e.many == fact]
    df = prefixed(mart.table(fact, *dict.fromkeys((*columns, *keys))), fact)
    for e in edges:
        onward = [n.many_key for n in edges if n.many == e.one]
        asked = [column for table, column in wanted if table == e.one]
        df = follow(df, mart, e, (*onward, *asked))
    return df.select(
        *[dotted(f"{fact}.{c}").alias(c) for c in columns], *[dotted(c) for c in dim_columns]
    )


def orphans(mart, edges: Sequence[Edge] = EDGES) -> DataFrame:
    """Keys of a many side that the one side lacks, with how many rows carry them. The many sides
    of one dimension are stacked: rows are counted per edge and key once, so a frequent key is one
    row before the dimension's join, of which there is one."""
    def of(one: str, one_key: str) -> DataFrame:
        sides = [
            mart.table(e.many, e.many_key)
            .where(F.col(e.many_key).isNotNull())
            .select(F.lit(e.name).alias("edge"), F.lit(e.many).alias("many"), F.col(e.many_key).alias("key"))
            for e in edges
            if (e.one, e.one_key) == (one, one_key)
        ]
        keys = reduce(DataFrame.unionByName, sides).groupBy("edge", "many", "key")
        keys = keys.agg(F.count(F.lit(1)).alias("rows"))
        known = mart.table(one, one_key).select(F.col(one_key).alias("key"))
        missing = keys.join(known, "key", "left_anti")
        return missing.select("edge", "many", F.lit(one).alias("one"), "key", "rows")

    ones = dict.fromkeys((e.one, e.one_key) for e in edges)
    return reduce(DataFrame.unionByName, [of(*one) for one in ones])
