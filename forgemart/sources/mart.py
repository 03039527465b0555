"""Where operators get their tables from: any object with ``table(name, *columns)``."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from forgemart.sources import schema as S
from forgemart.sources import storage

WRITES_AT_ONCE = 4


class FrameMart:
    """Tables held as DataFrames."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self._frames = dict(frames)

    def table(self, name: str, *columns: str) -> DataFrame:
        df = self._frames[name]
        return df.select(*columns) if columns else df


class StoredMart:
    """Tables in files under one root; Parquet reads only the columns asked for."""

    def __init__(self, spark: SparkSession, root: str, fmt: str | None = None):
        self._spark, self._root, self._fmt = spark, root, fmt

    def table(self, name: str, *columns: str) -> DataFrame:
        df = storage.load(self._spark, self._root, name, self._fmt)
        return df.select(*columns) if columns else df


class CatalogMart:
    """Tables of a database in the session catalog, by lower-case name."""

    def __init__(self, spark: SparkSession, database: str):
        self._spark, self._database = spark, database

    def table(self, name: str, *columns: str) -> DataFrame:
        df = storage.load_table(self._spark, self._database, name)
        return df.select(*columns) if columns else df


def store(mart, root: str, tables: tuple[str, ...] = S.TABLES, fmt: str | None = None) -> None:
    """Write mart tables under ``root``, each conformed to its schema. The tables do not depend
    on each other, so a few are written at the same time."""
    def write(name: str) -> None:
        storage.save(storage.conform(mart.table(name), name), root, name, fmt)

    with ThreadPoolExecutor(max_workers=WRITES_AT_ONCE) as pool:
        list(pool.map(write, tables))
