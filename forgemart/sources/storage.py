"""Load, conform, save, refresh and check mart tables."""

from __future__ import annotations

import tempfile
import traceback
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgemart.sources import schema as S

CODEC = "zstd"  # of stored tables and of steps between: two thirds of what Spark's default takes
LOG_SCHEMA = "step string, status string, detail string"


@cache
def _local_work_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="forgemart-")


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where Spark runs locally."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_work_dir(spark.sparkContext.applicationId)


def new_root(spark: SparkSession) -> str:
    """A new folder for one set of stored tables, deleted when the driver ends."""
    root = f"{work_dir(spark)}/mart-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def table_format(spark: SparkSession) -> str:
    """Delta where the session has its extension, else Parquet."""
    extensions = spark.conf.get("spark.sql.extensions", "") or ""
    return "delta" if "DeltaSparkSessionExtension" in extensions else "parquet"


def path_of(root: str, table: str) -> str:
    return f"{root}/{S.physical_name(table)}"


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the source columns named in ``{source: model}``, under their model names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's types in its column order; nulls stay, fractions of ints are cut."""
    target = S.schema(table)
    return df.select(
        *[F.col(f"`{field.name}`").cast(field.dataType).alias(field.name) for field in target]
    ).to(target)


def load(spark: SparkSession, root: str, table: str, fmt: str | None = None) -> DataFrame:
    """The stored table, with the columns that its own files have; an error names those of the
    model that are missing or of another type."""
    df = spark.read.format(fmt or table_format(spark)).load(path_of(root, table))
    if wrong := drift(table, df):
        raise ValueError(f"stored {table} differs from the model: {wrong}")
    return df


def stored_tables(
    spark: SparkSession, root: str, fmt: str | None = None, tables: Sequence[str] = S.TABLES
) -> dict[str, DataFrame]:
    """Those of the tables that are stored, with their files' own schemas, whatever they are."""
    hadoop, names = spark.sparkContext._jsc.hadoopConfiguration(), {}
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path_of(root, table))
        if path.getFileSystem(hadoop).exists(path):
            reader = spark.read.format(fmt or table_format(spark))
            names[table] = reader.load(path_of(root, table))
    return names


def _overwrite(df: DataFrame, fmt: str | None):
    return (
        df.write.mode("overwrite")
        .format(fmt or table_format(df.sparkSession))
        .option("overwriteSchema", "true")
        .option("compression", CODEC)
    )


def save(df: DataFrame, root: str, table: str, fmt: str | None = None) -> None:
    """Replace the whole table, schema included."""
    _overwrite(df, fmt).save(path_of(root, table))


def save_table(
    df: DataFrame, database: str, table: str, root: str | None = None, fmt: str | None = None
) -> None:
    """Replace a catalog table; its files go under ``root``, or to the warehouse without one."""
    writer = _overwrite(df, fmt)
    if root:
        writer = writer.option("path", path_of(root, table))
    writer.saveAsTable(f"{database}.{S.physical_name(table)}")


def load_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    return spark.table(f"{database}.{S.physical_name(table)}")


def refresh_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    """Like ``refresh``, for a catalog table that another session rewrote."""
    spark.catalog.refreshTable(f"{database}.{S.physical_name(table)}")
    return load_table(spark, database, table)


def refresh(spark: SparkSession, root: str, table: str, fmt: str | None = None) -> DataFrame:
    """Drop what Spark remembers of the table's files and read it again."""
    spark.catalog.refreshByPath(path_of(root, table))
    return load(spark, root, table, fmt)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table. Pass stored tables: Parquet counts come from file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def scan_profile(name: str, df: DataFrame) -> DataFrame:
    """Rows, columns and filled cells of one table, in one pass over all its columns."""
    filled = reduce(lambda a, b: a + b, [F.count(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), filled.alias("filled_cells")).select(
        F.lit(name).alias("table"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "filled_cells",
    )


def run_log(
    spark: SparkSession, steps: Iterable[tuple[str, str, object]], most: int | None = None
) -> DataFrame:
    """Log table of (step, status, detail); one placeholder row stands for an empty log. Details
    stay whole, or keep their last ``most`` characters, where a traceback names its cause."""
    rows = [(step, status, str(detail)) for step, status, detail in steps]
    log = spark.createDataFrame(rows or [("none", "none", "none")], LOG_SCHEMA)
    return log if most is None else log.withColumn("detail", F.right("detail", F.lit(most)))


def run_steps(
    spark: SparkSession, root: str, steps: Iterable[tuple[str, Callable[[], object]]]
) -> DataFrame:
    """Run named steps in order and store their log. A failing step is logged and raised."""
    done: list[tuple[str, str, object]] = []
    try:
        for name, step in steps:
            try:
                done.append((name, "ok", step()))
            except Exception:
                done.append((name, "error", traceback.format_exc()))
                raise
    finally:
        _overwrite(run_log(spark, done), None).save(path_of(root, "run_log"))
    return spark.read.format(table_format(spark)).load(path_of(root, "run_log"))


def drift(table: str, df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, expected, found) of the columns that are missing or of another type."""
    found = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in S.schema(table)}
    have = {name: found.get(name.lower(), "missing") for name in wanted}
    return [(name, kind, have[name]) for name, kind in wanted.items() if have[name] != kind]


def validate(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    expected: Sequence[str] = S.TABLES,
) -> DataFrame:
    """Missing tables, missing columns and changed types. Reads metadata only; pass tables with
    their own schemas, as ``stored_tables`` gives them."""
    wrong: list[tuple[str, str | None, str, str]] = []
    for table in expected:
        if table not in tables:
            wrong.append((table, None, "table", "missing"))
        else:
            wrong += [(table, *row) for row in drift(table, tables[table])]
    columns = ("table", "column", "expected", "found")
    return spark.createDataFrame(wrong, ", ".join(f"{c} string" for c in columns))
