"""Audit tables from csv, json and parquet; the census table; csv and json sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as K


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, rows: int | None = None, multi_line: bool = False
) -> DataFrame:
    """A csv table with a header. Types are inferred only where no schema is given; ``rows``
    is an optional sample mode. An empty table is an error.

    ``multi_line`` allows line breaks in cells, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df if rows is None else df.limit(rows)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """The headerless income table: '?' is missing, rows with a missing cell are dropped."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in K.CENSUS_COLUMNS)
    raw = spark.read.csv(path, schema=schema, nullValue="?", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.na.drop().withColumn("label", F.col("income").contains(">50K").cast("int"))


def read_dataset(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """A stored dataset by its file extension."""
    if extension == "csv":
        return read_csv(spark, path)
    if extension == "json":
        return spark.read.json(path)
    if extension == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported dataset format: {extension}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
