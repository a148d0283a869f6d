"""High-water marks: what has been loaded so far, per table and partition."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.operators.upsert import upsert
from plumbline.scale import observed

STATE_SCHEMA = (
    "table_name string, partition_key string, max_ts timestamp_ntz, processed_records bigint, "
    "last_updated timestamp_ntz, status string"
)
STATE_KEYS = ("table_name", "partition_key")


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def last_success(state: DataFrame, table: str, partition: str = "ALL") -> Any:
    """Newest successful mark, or None, which means a full load."""
    rows = (
        state.filter((F.col("table_name") == table) & (F.col("partition_key") == partition))
        .filter("status = 'SUCCESS'")
        .orderBy(F.col("max_ts").desc())
        .limit(1)
        .collect()
    )
    return rows[0]["max_ts"] if rows else None


def newer_than(df: DataFrame, column: str, mark: Any) -> DataFrame:
    """Rows loaded after the mark. The literal bound is pushed down to the scan."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def mark_of(batch: DataFrame, column: str, table: str, partition: str, now: dt.datetime) -> DataFrame:
    """State row of a processed batch; no row for an empty batch."""
    return (
        batch.agg(F.max(column).cast("timestamp_ntz").alias("max_ts"), F.count("*").alias("processed_records"))
        .filter(F.col("max_ts").isNotNull())
        .select(
            F.lit(table).alias("table_name"),
            F.lit(partition).alias("partition_key"),
            "max_ts",
            "processed_records",
            F.lit(now).cast("timestamp_ntz").alias("last_updated"),
            F.lit("SUCCESS").alias("status"),
        )
    )


def observed_mark(column: str) -> tuple[Observation, list[Column]]:
    """An observation, and what it has to see of a batch for ``mark_seen``."""
    return Observation(), [F.max(column).cast("timestamp_ntz").alias("max_ts"), F.count(F.lit(1)).alias("processed_records")]


def mark_seen(seen: Observation, spark: SparkSession, table: str, partition: str, now: dt.datetime) -> DataFrame:
    """State row of the batch that a write saw; no row for an empty batch."""
    found = observed(seen)
    rows = [(table, partition, found["max_ts"], found["processed_records"], now, "SUCCESS")] if found.get("max_ts") else []
    return spark.createDataFrame(rows, STATE_SCHEMA)


def marks_by(batch: DataFrame, column: str, table: str, partition: str, now: dt.datetime) -> DataFrame:
    """State rows of all partitions found in a batch, in one pass."""
    return (
        batch.groupBy(F.col(partition).cast("string").alias("partition_key"))
        .agg(F.max(column).cast("timestamp_ntz").alias("max_ts"), F.count("*").alias("processed_records"))
        .filter(F.col("max_ts").isNotNull())
        .select(
            F.lit(table).alias("table_name"),
            "partition_key",
            "max_ts",
            "processed_records",
            F.lit(now).cast("timestamp_ntz").alias("last_updated"),
            F.lit("SUCCESS").alias("status"),
        )
    )


def advance(state: DataFrame, marks: DataFrame) -> DataFrame:
    return upsert(state, marks, STATE_KEYS, ["max_ts"], frozen=())


def mark_failed(state: DataFrame, table: str, partition: str, now: dt.datetime) -> DataFrame:
    """After a failure the next run of that key is a full load."""
    hit = (F.col("table_name") == table) & (F.col("partition_key") == partition)
    return state.withColumn("status", F.when(hit, F.lit("FAILED")).otherwise(F.col("status"))).withColumn(
        "last_updated", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_updated"))
    )


def reset(state: DataFrame, where: str | None = None, confirm: bool = False) -> DataFrame:
    """Forget the marks that meet the predicate, or all of them. Needs an explicit confirmation."""
    if not confirm:
        raise SpecError("resetting watermarks forces a full reload; pass confirm=True")
    return state.filter("false") if where is None else state.filter(~F.coalesce(F.expr(where), F.lit(False)))


def month_batches(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """Calendar-month ranges that cover [start, end]; the first and last may be partial."""
    batches = []
    while start <= end:
        following = (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        batches.append((start, min(end, following - dt.timedelta(days=1))))
        start = following
    return batches


def month_batch_frame(df: DataFrame, column: str) -> DataFrame:
    """The same ranges, from the first to the last date found in a table."""
    span = df.agg(F.min(column).cast("date").alias("lo"), F.max(column).cast("date").alias("hi"))
    months = span.select("lo", "hi", F.explode(F.expr("sequence(trunc(lo, 'MM'), hi, interval 1 month)")).alias("m"))
    return months.select(
        F.greatest("m", "lo").alias("batch_start"), F.least(F.last_day("m"), F.col("hi")).alias("batch_end")
    )


def backfill(
    start: dt.date, end: dt.date, run: Callable[[dt.date, dt.date], None]
) -> list[tuple[dt.date, dt.date, str]]:
    """Run a range job month by month. A failed month is recorded and does not stop the others."""
    outcome = []
    for first, last in month_batches(start, end):
        try:
            run(first, last)
            outcome.append((first, last, "SUCCESS"))
        except Exception as error:
            outcome.append((first, last, f"FAILED: {error}"))
    return outcome
