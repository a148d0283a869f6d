"""Readers. Filters and columns are stated up front so that they reach the file scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    partition: Mapping[str, str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """Parquet folder with an optional declared schema, restricted by partition value and predicate."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    for name, value in (partition or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    if where:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def day_scan(spark: SparkSession, path: str, schema: T.StructType | str | None, day: str | None = None) -> DataFrame:
    """One ``year_month_day`` partition of a raw table, or all of them."""
    return parquet_scan(spark, path, schema, partition={"year_month_day": day} if day else None)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
    """Catalog table, or an empty frame of the given schema when there is no such table."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def path_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet folder, or an empty frame of the given schema when the folder is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def sample_rows(df: DataFrame, rows: int = 20) -> DataFrame:
    """First rows of a dataset, for a preview."""
    return df.limit(rows)
