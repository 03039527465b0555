"""Tables written between the steps of an iterative operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgemart.sources import storage


def written(df: DataFrame) -> DataFrame:
    """Writes the rows under the folder that all executors share and reads them back: later steps
    start from there, also when an executor is lost."""
    spark = df.sparkSession
    path = f"{storage.new_root(spark)}/step"
    df.write.parquet(path, compression=storage.CODEC)
    return spark.read.schema(df.schema).parquet(path)
