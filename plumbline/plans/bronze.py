"""Raw to bronze: incremental read, cleansing, newest version per key, quality status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cleansing import day_key, first_missing, require, tidy
from plumbline.functions.constants import INVALID_DAY
from plumbline.operators.upsert import newest, upsert
from plumbline.operators.watermark import advance, last_success, mark_of, mark_seen, newer_than, observed_mark
from plumbline.scale import materialise
from plumbline.sources.versions import VersionedTable

INGESTED = "raw_ingestion_timestamp"
MONEY = "decimal(10,4)"


def _stamped(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("bronze_processing_timestamp", now)


def _newest(df: DataFrame, key: str) -> DataFrame:
    return newest(df, [key], [INGESTED, *(["offset"] if "offset" in df.columns else [])])


def dimension(raw: DataFrame, now: Column) -> DataFrame:
    """Named members, one row per id."""
    named = require(tidy(require(raw, ["id"]), ["name"]), non_empty=["name"])
    return _stamped(_newest(named, "id"), now).withColumn("data_quality_status", F.lit("VALID"))


def with_day(df: DataFrame, day: Column) -> DataFrame:
    """Add the day partition; rows without a usable date are left out."""
    keyed = df.withColumn("year_month_day", F.coalesce(day_key(day), F.lit(INVALID_DAY)))
    return keyed.filter(F.col("year_month_day") != INVALID_DAY)


RECORD_CHECKS = (
    ("record_datetime", "MISSING_TIMESTAMP"),
    ("process_id", "MISSING_PROCESS"),
    ("category_id", "MISSING_CATEGORY"),
    ("line_id", "MISSING_LINE"),
)
MEASUREMENT_CHECKS = (
    ("analysis_date", "MISSING_DATE"),
    ("result_value", "MISSING_VALUE"),
    ("tank_name", "MISSING_TANK"),
    ("item_name", "MISSING_ITEM"),
)


def records(raw: DataFrame, now: Column, key: str = "source_filename") -> DataFrame:
    """Analysis records; the submission time becomes a timestamp once, here."""
    kept = with_day(require(raw, ["id", key]), F.col("business_date"))
    clean = tidy(kept, ["analyst", "submitter", "shift"], ["overall_judgment"]).withColumns(
        {
            "record_datetime": F.try_to_timestamp("business_datetime"),
            "submission_datetime": F.timestamp_millis(F.col("submission_datetime").cast("long")),
        }
    )
    tagged = clean.withColumn("data_quality_status", first_missing(RECORD_CHECKS))
    return _stamped(_newest(tagged, key), now)


def measurements(raw: DataFrame, now: Column) -> DataFrame:
    """Measured values as fixed-point numbers."""
    kept = with_day(require(raw, ["id", "analysis_record_id"]), F.col("business_date"))
    numbers = ["process_range_min", "process_range_max", "control_point", "control_range_min", "control_range_max"]
    clean = tidy(kept, ["tank_name", "item_name", "grade"], ["judgment"]).withColumns(
        {c: F.col(c).try_cast(MONEY) for c in [*numbers, "result_value"]}
    )
    tagged = clean.withColumn("data_quality_status", first_missing(MEASUREMENT_CHECKS))
    return _stamped(_newest(tagged, "id"), now)


def load(
    raw: DataFrame,
    stored: DataFrame | None,
    state: DataFrame,
    table: str,
    clean: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    now: dt.datetime,
    partition: str = "ALL",
) -> tuple[DataFrame, DataFrame]:
    """One incremental load: the new table and the new watermark state.

    Rows already stored stay unless a newer version arrives. A deleted row stays as a marked row;
    readers hide it with ``upsert.live``. The batch is written once, so table and mark see the same rows.
    """
    batch = materialise(clean(newer_than(raw, INGESTED, last_success(state, table, partition))), "batch")
    merged = batch if stored is None else upsert(stored, batch, keys, [INGESTED], frozen=())
    return merged, advance(state, mark_of(batch, INGESTED, table, partition, now))


def load_into(
    raw: DataFrame,
    target: VersionedTable,
    state: DataFrame,
    table: str,
    clean: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    now: dt.datetime,
    partition: str = "ALL",
) -> DataFrame:
    """One incremental load into a stored table; returns the new watermark state.

    The mark and the row count are observed on the rows that are written, while they are written: the batch is read once,
    and a source that grows meanwhile can't move the mark past rows that were not merged.
    """
    spark = raw.sparkSession
    seen, wanted = observed_mark(INGESTED)
    batch = clean(newer_than(raw, INGESTED, last_success(state, table, partition))).observe(seen, *wanted)
    merged = upsert(target.read(spark), batch, keys, [INGESTED], frozen=()) if target.exists(spark) else batch
    target.replace_all(merged)
    return advance(state, mark_seen(seen, spark, table, partition, now))
