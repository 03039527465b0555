"""Tables written between steps, and what operators share when they call Python on batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame, SparkSession

from forgemart.sources import storage

#: Bytes of text that a Python step works on at once, whatever the size of Arrow's batches.
BATCH_BYTES = 4 << 20


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir, deleted when the driver ends. Only where
    that is unset and Spark runs locally, as in tests, a temporary folder stands in."""
    return storage.new_root(spark)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="forgemart-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in package.rglob("*.py"):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_pandas(df: DataFrame, function: Callable, schema) -> DataFrame:
    ship_code(df.sparkSession)
    return df.mapInPandas(function, schema)


def saved(df: DataFrame) -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them back.

    Cuts lineage: a lost executor costs its running tasks, not the steps before this one.
    """
    spark = df.sparkSession
    path = scratch_folder(spark) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with marks before those that the columns have (in any case)."""
    taken = {c.lower() for c in df.columns}
    mark = ""
    while any((mark + name).lower() in taken for name in names):
        mark += "_"
    return [mark + name for name in names]


def whole_number(df: DataFrame, column) -> int:
    """The value of an aggregate over all rows, 0 for none."""
    return df.agg(column).first()[0] or 0


def texts_as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a batch in UTF-8; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes in the column; one row may exceed it."""
    for batch in batches:
        start = size = 0
        lengths = pa.compute.binary_length(batch.column(name)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    df: DataFrame, name: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """`function` over batches of bounded text, keeping partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            yield function(batch)

    return map_arrow(df, run, schema)
