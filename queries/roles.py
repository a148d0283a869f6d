"""The driver's tables in the roles of the quality data model, once for Spark and once as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and oracle texts of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.oracles[key] = sql.strip()
            return fn

        return put


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables; its footer is read once per process, not once per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers widened, as in the oracle texts."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float") or kind.startswith("decimal"):
            out.append(f"round(double(`{name}`), {digits}) + 0D AS `{name}`")
        elif kind in ("int", "smallint", "tinyint"):
            out.append(f"bigint(`{name}`) AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


def shift(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour < 8, "A").when(hour < 16, "B").otherwise("C")


SHIFT_SQL = "CASE WHEN hour(ts) < 8 THEN 'A' WHEN hour(ts) < 16 THEN 'B' ELSE 'C' END"


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Measured values with limits, from ``events``."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("analysis_id"),
        F.col("event_type").alias("process_id"),
        F.concat(F.lit("T"), F.col("user_id") % 3).alias("tank_name"),
        F.lit("value").alias("item_name"),
        shift(F.col("ts")).alias("shift"),
        F.to_date("ts").alias("analysis_date"),
        F.col("ts").alias("analysis_datetime"),
        F.col("value").alias("x"),
        F.lit(1.0).alias("lsl"),
        F.lit(150.0).alias("usl"),
        F.lit(50.0).alias("cl"),
    )


MEASUREMENTS_SQL = f"""meas AS (
  SELECT event_id AS analysis_id, event_type AS process_id, 'T' || (user_id % 3) AS tank_name,
         'value' AS item_name, {SHIFT_SQL} AS shift, CAST(ts AS DATE) AS analysis_date,
         ts AS analysis_datetime, value AS x, 1.0::DOUBLE AS lsl, 150.0::DOUBLE AS usl, 50.0::DOUBLE AS cl
  FROM events)"""
TIE = ("analysis_id",)

QTY_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x_price")


def quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped quantities by month, from ``lineitem``; months have enough points for subgroup limits."""
    i = table(spark, sf, "lineitem")
    return i.select(
        F.col("l_returnflag").alias("process_id"),
        F.lit("line").alias("tank_name"),
        F.lit("qty").alias("item_name"),
        F.trunc("l_shipdate", "MM").alias("analysis_date"),
        F.col("l_shipdate").alias("analysis_datetime"),
        F.col("l_quantity").alias("x"),
        F.lit(5.0).alias("lsl"),
        F.lit(45.0).alias("usl"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").alias("x_price"),
    )


QUANTITIES_SQL = """meas AS (
  SELECT l_returnflag AS process_id, 'line' AS tank_name, 'qty' AS item_name,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS analysis_date, l_shipdate AS analysis_datetime,
         l_quantity AS x, 5.0::DOUBLE AS lsl, 45.0::DOUBLE AS usl,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x_price
  FROM lineitem)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis records with a judgement, from ``events``."""
    e = table(spark, sf, "events")
    bad = (F.col("event_type") == "error") | (F.col("value") > 120)
    return e.select(
        F.col("event_id").alias("analysis_id"),
        F.concat(F.lit("P"), F.col("user_id") % 4).alias("process_id"),
        F.concat(F.lit("C"), F.col("user_id") % 3).alias("category_id"),
        F.concat(F.lit("L"), F.col("user_id") % 5).alias("line_id"),
        shift(F.col("ts")).alias("shift"),
        F.to_date("ts").alias("analysis_date"),
        F.col("ts").alias("record_timestamp"),
        F.col("value"),
        F.when(bad, "NG").otherwise("OK").alias("overall_judgment"),
    )


RECORDS_SQL = f"""rec AS (
  SELECT event_id AS analysis_id, 'P' || (user_id % 4) AS process_id, 'C' || (user_id % 3) AS category_id,
         'L' || (user_id % 5) AS line_id, {SHIFT_SQL} AS shift, CAST(ts AS DATE) AS analysis_date,
         ts AS record_timestamp, value,
         CASE WHEN event_type = 'error' OR value > 120 THEN 'NG' ELSE 'OK' END AS overall_judgment
  FROM events)"""


def r6(columns: Sequence[str] | str) -> str:
    """``round(c::DOUBLE, 6) AS c`` for each name."""
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in names)


def big(columns: Sequence[str] | str) -> str:
    """``CAST(c AS BIGINT) AS c`` for each name."""
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in names)
