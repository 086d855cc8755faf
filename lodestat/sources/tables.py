"""Reading tables in and writing results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestat.columns import numeric_features
from lodestat.errors import ColumnNotFound


def read_csv(spark: SparkSession, path: str, schema: str | None = None, nan: str = "nan") -> DataFrame:
    """A CSV with a header line; types are inferred unless ``schema`` is given.

    Inference reads the file once more, so pass a schema for large inputs.
    """
    reader = spark.read.option("header", True).option("nanValue", nan)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV, Parquet, ORC or JSON, by ``format`` or by the file's ending."""
    kind = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(path)


def read_stream(spark: SparkSession, path: str, schema: str | StructType, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The files that arrive in a folder, or match a pattern, as a stream.

    Spark streams folders; to stream one file, write it as a pattern such as
    ``data/event[s].parquet``.
    """
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def check_target(df: DataFrame, target: str | None) -> None:
    """Raise unless the target is absent or names a numeric column."""
    if target is not None and target not in numeric_features(df):
        raise ColumnNotFound(target)


def load_dataset(spark: SparkSession, path: str, target: str | None = None, format: str | None = None, schema: str | None = None):
    """The table and a one-row description (status, path, rows, columns)."""
    df = read_table(spark, path, format, schema)
    check_target(df, target)
    summary = spark.createDataFrame(
        [("ok", path, df.count(), len(numeric_features(df, target)))], "status string, path string, rows bigint, columns int"
    )
    return df, summary


def write_result(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Write an operator's result in any format Spark supports."""
    df.write.format(format).mode(mode).save(path)
