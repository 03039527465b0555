"""Stored layouts: buckets by a join key, partitions by period, swaps that readers don't notice, and
checks taken in the pass that writes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forgemart.sources import schema as S
from forgemart.sources import storage


def new_database(spark: SparkSession) -> str:
    """A new database of the session catalog whose tables lie in a folder of their own."""
    name = f"mart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{storage.new_root(spark)}'")
    return name


BUCKET_BYTES = 16 << 20  # of the source of a fact, for one bucket

# ---- buckets ----------------------------------------------------------------------------


def save_bucketed(df: DataFrame, database: str, table: str, key: str, buckets: int) -> None:
    """Replace a catalog table stored in ``buckets`` buckets by ``key``, each sorted by it.

    Tables of the same number of buckets join and group by the key without a shuffle. A task then
    reads whole buckets and nothing splits them, so choose a key without overlarge values, and
    enough buckets for one to fit a task; elsewhere plain tables let adaptive execution split.
    Rows are dealt out by the key first, so that a bucket is one file.
    """
    rows = df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").format("parquet").option("compression", storage.CODEC)
    writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(f"{database}.{S.physical_name(table)}")


def buckets_for(spark: SparkSession, path: str, least: int) -> int:
    """Buckets for tables that grow with what is stored at ``path``, so that one still fits a task."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(least, files.getContentSummary(place).getLength() // BUCKET_BYTES)


#: Facts and the dimension they share, all stored by order.
BY_ORDER = (
    "COOIS_OrderHeaders",
    "COOIS_OrderOperations",
    "COOIS_Confirmations",
    "CO24",
    "MATDOC",
)


def store_by_order(mart, database: str, buckets: int, tables: Sequence[str] = BY_ORDER) -> None:
    for table in tables:
        save_bucketed(storage.conform(mart.table(table), table), database, table, "Order", buckets)


# ---- partitions -------------------------------------------------------------------------


def with_period(df: DataFrame, moment: str) -> DataFrame:
    """Adds Period, the month (yyyyMM) of a time, by which facts are stored."""
    return df.withColumn("Period", F.date_format(moment, "yyyyMM"))


def save_partitioned(df: DataFrame, root: str, table: str, by: str = "Period") -> None:
    """Replace a whole table stored in partitions. Rows of a partition are spread over a few tasks
    by what adaptive execution finds, so that a frequent partition is not one task."""
    spread = df.hint("rebalance", by)
    spread.write.mode("overwrite").format("parquet").partitionBy(by).save(storage.path_of(root, table))


def replace_partitions(df: DataFrame, root: str, table: str, by: str = "Period") -> None:
    """Replace those partitions that ``df`` has rows of; all other ones stay untouched."""
    spread = df.hint("rebalance", by)
    writer = spread.write.mode("overwrite").format("parquet").partitionBy(by)
    writer.option("partitionOverwriteMode", "dynamic").save(storage.path_of(root, table))


def load_partitioned(spark: SparkSession, root: str, table: str, by: str = "Period") -> DataFrame:
    """The stored table. Periods look like numbers; the schema keeps them texts."""
    path = storage.path_of(root, table)
    schema = spark.read.parquet(path).schema
    schema[by].dataType = S.schema("SOP_Targets")["Period"].dataType
    return spark.read.schema(schema).parquet(path)


# ---- swaps ------------------------------------------------------------------------------


def swap_table(df: DataFrame, database: str, table: str) -> None:
    """Replace the rows of a catalog table without touching the files of its readers.

    The rows are written to a folder of their own before the catalog's entry moves there, so a
    reader sees all old rows or all new ones, and one that began before goes on reading. Folders
    that were left are deleted when the driver ends. A table that does not exist is made.
    """
    spark = df.sparkSession
    name, place = f"{database}.{S.physical_name(table)}", storage.new_root(spark)
    df.write.mode("overwrite").parquet(place)
    if spark.catalog.tableExists(name):
        if spark.table(name).schema.simpleString() != df.schema.simpleString():
            raise ValueError(f"{name} has other columns than the rows that are to replace it")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=place, source="parquet", schema=df.schema)


# ---- checks while writing ---------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """``wrong`` is true for rows that break the rule; more than ``limit`` of them fail a step."""

    name: str
    wrong: Column
    limit: int | None = None


class CheckFailed(ValueError):
    pass


def save_checked(df: DataFrame, root: str, table: str, checks: Sequence[Check]) -> Mapping[str, int]:
    """Replace a table and count, in the same pass, its rows and those that break each rule.

    Gives {"rows": n, check: wrong rows, ...}. The rows go to a folder beside the table first: if a
    count is above its limit, the old table stays, and the error names all such checks.
    """
    spark = df.sparkSession
    counts = [F.count_if(c.wrong).alias(c.name) for c in checks]
    seen = Observation(f"checks of {table} {uuid.uuid4().hex}")
    fresh = f"{storage.new_root(spark)}/fresh"
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(fresh)
    found = dict(seen.get)
    broken = {c.name: found[c.name] for c in checks if c.limit is not None and found[c.name] > c.limit}
    if broken:
        raise CheckFailed(f"{table}: rows beyond the limits: {broken}")
    _move(spark, fresh, storage.path_of(root, table))
    return found


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in place of another one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = path(target), path(source)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.mkdirs(old.getParent())
    if not files.rename(new, old):
        raise OSError(f"{source} could not be moved to {target}")
    spark.catalog.refreshByPath(target)
