"""Bronze to silver: star-schema facts and dimensions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.functions.cleansing import as_date, date_and_millis, millis_to_timestamp
from plumbline.operators.scd import close_members, first_load, scd2_apply
from plumbline.operators.star import Lookup, resolve_keys
from plumbline.operators.upsert import live, newest
from plumbline.operators.watermark import advance, last_success, mark_of, newer_than
from plumbline.scale import keyset_join, materialise, null_safe_join
from plumbline.sources.sinks import ParquetTable, dual_write

PROCESSED = "bronze_processing_timestamp"
DELETED = "__deleted"
# Places of the calendar parts in an eight-digit day.
PART_OF_DAY = {"year": (1, 4), "month": (5, 2), "day": (7, 2)}
DAY_PARTS = {"year_month_day", *PART_OF_DAY}
# Years of a plausible analysis date.
FIRST_YEAR, LAST_YEAR = 2020, 2030
MONEY = "decimal(10,4)"

RECORD_LOOKUPS = (
    Lookup("categories", "category_id", "category_id", "category_sk", "category_key"),
    Lookup("processes", "process_id", "process_id", "process_sk", "process_key"),
    Lookup("lines", "line_id", "line_id", "line_sk", "line_key"),
    Lookup("date", "analysis_date", "full_date", "date_key", "date_key"),
)


def calendar_parts(day: Column) -> list[Column]:
    return [F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day")]


def record_fact(bronze: DataFrame, dims: Mapping[str, DataFrame | None], now: Column) -> DataFrame:
    """One row per analysis with surrogate keys."""
    timed = shown(bronze).withColumn("record_timestamp", millis_to_timestamp(F.col("record_timestamp"))).withColumn(
        "analysis_date", F.to_date("record_timestamp")
    )
    keyed = resolve_keys(timed, dims, RECORD_LOOKUPS)
    text = [F.col(c).cast("string") for c in ("process_id", "category_id", "line_id")]
    return keyed.select(
        F.col("id").cast("string").alias("analysis_id"),
        "date_key", "process_key", "category_key", "line_key", *text,
        "analysis_date", "record_timestamp", "report_description", "submitter", "submission_datetime",
        "shift", "analyst", "overall_judgment", "source_filename",
        *calendar_parts(F.col("analysis_date")),
        now.alias("created_at"), now.alias("updated_at"),
    )


def measurement_fact(
    bronze: DataFrame,
    dims: Mapping[str, DataFrame | None],
    now: Column,
    record_keys: DataFrame | None = None,
) -> DataFrame:
    """One row per measurement. With ``record_keys`` (analysis_id, process_key, category_key,
    line_key) the surrogate keys come from the measurement's record; without it they are null."""
    dated = shown(bronze).withColumn("analysis_date", as_date(bronze, "analysis_date")).withColumn(
        "analysis_datetime", date_and_millis(F.col("analysis_date"), F.col("analysis_time"))
    )
    valid = dated.filter(F.year("analysis_date").between(FIRST_YEAR, LAST_YEAR))
    keyed = resolve_keys(valid, dims, [RECORD_LOOKUPS[3]]).withColumn(
        "analysis_id", F.col("analysis_record_id").cast("string")
    )
    surrogates = ["process_key", "category_key", "line_key"]
    if record_keys is None:
        keyed = keyed.withColumns({c: F.lit(None).cast("int") for c in surrogates})
    else:
        # Two facts: both may be large, so this is a shuffle join and adaptive execution splits skew.
        keyed = keyed.join(record_keys.select("analysis_id", *surrogates), "analysis_id", "left")
    numbers = ["process_range_min", "process_range_max", "control_point", "control_range_min", "control_range_max"]
    return keyed.select(
        F.col("id").cast("string").alias("result_id"), "analysis_id", "date_key", *surrogates,
        "tank_name", "item_name", "item_unit", "grade",
        *[F.col(c).cast(MONEY).alias(c) for c in [*numbers, "result_value"]],
        "judgment", "analysis_date", "analysis_datetime",
        *calendar_parts(F.col("analysis_date")),
        now.alias("created_at"), now.alias("updated_at"),
    )


def rejected_dates(bronze: DataFrame) -> DataFrame:
    """Measurements without a date, and with a date outside the valid years."""
    day = as_date(bronze, "analysis_date")
    return bronze.agg(
        F.count_if(day.isNull()).alias("missing_date"),
        F.count_if(day.isNotNull() & ~F.year(day).between(FIRST_YEAR, LAST_YEAR)).alias("invalid_date_range"),
    )


def dimension_load(
    bronze: DataFrame,
    stored: DataFrame | None,
    state: DataFrame,
    table: str,
    keys: Sequence[str],
    tracked: Sequence[str],
    execution_date: str,
    now: dt.datetime,
) -> tuple[DataFrame, DataFrame]:
    """One type-2 load from the bronze rows since the last mark.

    A member whose newest image is a delete is no current member: its version is closed, and a member that is deleted
    before its first load never enters. The batch is written once, so table and mark see the same rows.
    """
    fresh = materialise(newer_than(bronze, PROCESSED, last_success(state, table)), "batch")
    images = newest(fresh, keys, [PROCESSED])
    alive = shown(images).select(*keys, *tracked)
    if stored is None:
        result = first_load(alive, keys, tracked, execution_date)
    else:
        result = scd2_apply(stored, alive, keys, tracked, execution_date)
        if DELETED in images.columns:
            gone = images.filter(F.col(DELETED) == "true").select(*keys)
            result = close_members(result, gone, keys, execution_date)
    return result, advance(state, mark_of(fresh, PROCESSED, table, "ALL", now))


def fact_load(
    bronze: DataFrame,
    state: DataFrame,
    table: str,
    build: Callable[[DataFrame], DataFrame],
    first: ParquetTable,
    second: ParquetTable,
    now: dt.datetime,
    day: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Read the new bronze rows, rebuild what they touch and write both copies; returns the new state.

    A partition of a target is touched if a row that is built from a new bronze row lies in it, or, with ``key``, if the
    stored fact has an older image of such a row there: a row that moved to another day, or was deleted, leaves its old
    place. Touched partitions are found in each target's own partition columns, which are parts of the day, and rebuilt
    from the bronze days that belong there; so a target may be partitioned more coarsely than bronze, and both copies
    stay complete and equal.
    """
    spark = bronze.sparkSession
    for target in (first, second):
        if not target.by or not set(target.by) <= DAY_PARTS:
            raise SpecError(f"a fact is partitioned by the parts of its day, not by {target.by}")
    scope = bronze.filter(F.col("year_month_day") == day) if day else bronze
    fresh = materialise(newer_than(scope, PROCESSED, last_success(state, table, day or "ALL")), "batch")
    state = advance(state, mark_of(fresh, PROCESSED, table, day or "ALL", now))
    new = build(fresh)
    calendar = bronze.select("year_month_day").distinct().select(
        "year_month_day", *[F.substring("year_month_day", *at).cast("int").alias(c) for c, at in PART_OF_DAY.items()]
    )
    jobs = []
    for target in (first, second):
        by = list(target.by)
        touched = new.select(*by)
        if key and target.exists(spark):
            stored = target.typed(new.schema).read(spark)
            ids = fresh.select(F.col("id").cast("string").alias(key)).distinct()
            touched = touched.unionByName(null_safe_join(stored, ids, [key], "left_semi").select(*by))
        touched = materialise(touched.distinct(), "touched")
        days = keyset_join(calendar, touched, by, "left_semi").select("year_month_day")
        whole = build(keyset_join(bronze, days, ["year_month_day"], "left_semi"))
        jobs.append((keyset_join(whole, touched, by, "left_semi"), touched))
    dual_write(jobs[0][0], first, second, touched=(jobs[0][1], jobs[1][1]), second_df=jobs[1][0])
    return state


def shown(images: DataFrame) -> DataFrame:
    """Rows whose newest image is not a delete; all rows where images carry no such mark."""
    return live(images) if DELETED in images.columns else images
