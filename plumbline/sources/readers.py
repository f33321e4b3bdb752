"""Reading tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """CSV with a header, or Parquet; the format follows the file name unless given. CSV needs a schema."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        if schema is None:
            raise ValueError("give a schema for CSV: inferring it reads the data twice")
        return spark.read.schema(schema).csv(path, header=True)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def from_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small table from rows with an explicit schema."""
    return spark.createDataFrame(rows, schema)


def with_history(history: DataFrame, source: DataFrame) -> DataFrame:
    """History and new rows in one table; columns one side lacks are NULL."""
    return history.unionByName(source, allowMissingColumns=True)
