"""Silver to gold: the nine aggregates for a date range."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cleansing import applicable_rules, characteristic_type
from plumbline.operators import daily, spc, watermark
from plumbline.operators.upsert import months_predicate, replace_where
from plumbline.scale import lookup_join, materialise, together
from plumbline.sources.sinks import create_if_absent, replace_range, rewrite
from plumbline.sources.versions import VersionedTable


def chart_input(measures: DataFrame, records: DataFrame, categories: DataFrame) -> DataFrame:
    """Measurements with process, shift, limits and characteristic type.

    Measurements and records are both facts and are joined by shuffle; the categories are a lookup.
    """
    kept = records.select("analysis_id", "process_id", "category_id", "line_id", "shift", "overall_judgment")
    kinds = categories.filter("is_current").select("category_id", F.col("name").alias("_label"))
    wide = lookup_join(measures.join(kept, "analysis_id", "left"), kinds, ["category_id"])
    return wide.withColumn("char_type", characteristic_type(F.col("_label"))).select(
        "analysis_id", "process_id", "category_id", "line_id", "shift", "tank_name", "item_name",
        "analysis_date", "analysis_datetime",
        F.col("result_value").cast("double").alias("x"),
        F.col("process_range_min").cast("double").alias("lsl"),
        F.col("process_range_max").cast("double").alias("usl"),
        F.col("control_point").cast("double").alias("cl"),
        "overall_judgment", "char_type", applicable_rules(F.col("char_type")).alias("rules_applied"),
    )


def individuals_scope(wide: DataFrame) -> DataFrame:
    return wide.filter(F.coalesce(F.col("char_type").isin("chemical", "process"), F.lit(True)))


def product_scope(wide: DataFrame) -> DataFrame:
    return wide.filter(F.col("char_type") == "product")


def within(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("analysis_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def month_range(start: str, end: str) -> tuple[str, str]:
    """Whole calendar months around a range."""
    first, last = dt.date.fromisoformat(start).replace(day=1), dt.date.fromisoformat(end)
    following = (last.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return first.isoformat(), (following - dt.timedelta(days=1)).isoformat()


def gold_run(
    records: DataFrame,
    wide: DataFrame,
    start: str,
    end: str,
    tie: Sequence[str] = (),
    capability_history: DataFrame | None = None,
    subgroup_sizes: tuple[int, int] = (5, 10),
    stage: bool = False,
    baseline: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All gold tables for [start, end], in the order in which they are published.

    Charts are computed with the history found in their inputs and then cut to the range, so a
    narrow run gives the same rows as a wide one; ``goldstate.run_days`` gives the same tables from
    stored day rows without reading history. The alarm rate covers whole months:
    ``capability_history`` adds the published chart rows of those months outside the range.
    ``baseline`` is the range of days of the centre lines, all days by default.

    With ``stage`` the chart input, which joins two facts, and the daily chart are written to the
    shared directory once instead of being computed again for every table that reads them.
    """
    order = {"tie": tie}
    if stage:
        wide = materialise(wide, "chart-input")
    capability = spc.individuals_chart(individuals_scope(wide), **order)
    if stage:
        capability = materialise(capability, "chart")
    first, last = month_range(start, end)
    months = within(capability, first, last)
    if capability_history is not None:
        kept = within(capability_history, first, last).filter(
            ~F.col("analysis_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        )
        months = within(capability, start, end).unionByName(kept.select(*capability.columns))
    r_size, s_size = subgroup_sizes
    judged = within(records, start, end)
    ordered = {"ordered": spc.day_order(product_scope(wide), tie=tie), "baseline": baseline}
    return {
        "agg_qualification_rate_daily": daily.nonconformance_daily(judged),
        "agg_warning_statistics_daily": daily.warning_daily(judged),
        "spc_capability_daily": within(capability, start, end),
        "spc_baseline": spc.frozen_baseline(individuals_scope(wide), **order),
        "spc_trend_ma": within(spc.moving_average_trend(wide), start, end),
        "spc_xbar_r_chart": within(spc.xbar_r_chart(product_scope(wide), r_size, **ordered), start, end),
        "spc_xbar_s_chart": within(spc.xbar_s_chart(product_scope(wide), s_size, **ordered), start, end),
        "spc_p_chart": within(spc.p_chart(records, baseline=baseline), start, end),
        "spc_c_chart": within(spc.c_chart(records, baseline=baseline), start, end),
        "spc_monthly_alarm_rate": spc.monthly_alarm_rate(months),
    }


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows`` of several frames in one job, for the check after a load."""
    out = None
    for name, df in tables.items():
        line = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = line if out is None else out.unionByName(line)
    return out


def published(root: str, name: str) -> VersionedTable:
    """A gold table below ``root``. Daily tables are partitioned by month."""
    whole = name in ("spc_baseline", "spc_monthly_alarm_rate")
    return VersionedTable(f"{root}/{name}", () if whole else ("month_start",))


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, start: str, end: str) -> None:
    """Write the result of a run, one switch per table. Repeating a run, or running ranges in any order, gives the same
    tables.

    Daily tables replace the rows of the range. The alarm rate replaces its months. Finished baselines are kept.
    """
    def write(name: str, df: DataFrame) -> None:
        target = published(root, name)
        if name == "spc_baseline":
            if not create_if_absent(df, target):
                rewrite(target, lambda old: spc.freeze(old, df), spark)
        elif name == "spc_monthly_alarm_rate":
            if not create_if_absent(df, target):
                months = months_predicate(start, end)
                rewrite(target, lambda old: replace_where(old, df, months), spark)
        else:
            replace_range(df.withColumn("month_start", F.trunc(spc.DAY, "MM")), target, spc.DAY, start, end)

    together(*[functools.partial(write, name, df) for name, df in tables.items()])


def backfill_spc(
    state: DataFrame, start: dt.date, end: dt.date, run: Callable[[dt.date, dt.date], None]
) -> tuple[DataFrame, list[tuple[dt.date, dt.date, str]]]:
    """Forget the marks of all control-chart tables and recompute them month by month."""
    cleared = watermark.reset(state, "table_name LIKE 'spc\\_%'", confirm=True)
    return cleared, watermark.backfill(start, end, run)
