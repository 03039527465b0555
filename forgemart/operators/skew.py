"""Joins to a one-row-per-key side whose other side may have very frequent keys, or no key at all.

There is one route for every size. Adaptive execution splits an overlarge key of a join only where
both sides reach it by exchanges of their own, so both join on the key and its hash: an
aggregate by the key then gets such an exchange, of one row a key. Rows without a key, which match
nothing, are dealt out by a hash of what they hold instead of meeting in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 4096  # places that rows without a key are dealt to


def spread(df: DataFrame, by: Sequence[str] = ()) -> Column:
    """A number below SPREAD from a row's ``by`` columns, or from all its numbers, texts and times."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by or plain)), F.lit(SPREAD)).cast("int")


def lookup(
    df: DataFrame, one: DataFrame, key: str, one_key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Left join to the row of ``one`` with the same key, which ``one`` holds once. ``by`` are the
    columns that deal out rows without a key; name few where ``df`` has more than is asked for,
    since all of them are read."""
    known = F.xxhash64(key)  # a constant would be taken out of the join's keys
    rows = df.withColumn("_spread", F.when(F.col(key).isNull(), spread(df, by)).otherwise(known))
    side = one.withColumn("_side", F.xxhash64(one_key))
    same = (F.col(key) == F.col(one_key)) & (F.col("_spread") == F.col("_side"))
    return rows.join(side, same, "left").drop("_spread", "_side")
