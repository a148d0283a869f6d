"""Gold to serving: versioned tables in which the newest row of a key counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.upsert import newest

# The key columns of the published tables. Charts have a row for each limit set of a day.
LIMITS = ("lsl", "usl", "cl")
SERVING_KEYS: Mapping[str, tuple[str, ...]] = {
    "agg_qualification_rate_daily": ("process_name", "shift", "analysis_date"),
    "agg_warning_statistics_daily": ("process_name", "shift", "analysis_date"),
    "spc_capability_daily": ("process_id", "tank_name", "item_name", "shift", "analysis_date", *LIMITS),
    "spc_trend_ma": ("process_id", "tank_name", "item_name", "analysis_date"),
    "spc_xbar_r_chart": ("process_id", "tank_name", "item_name", "analysis_date", *LIMITS),
    "spc_xbar_s_chart": ("process_id", "tank_name", "item_name", "analysis_date", *LIMITS),
    "spc_p_chart": ("process_id", "shift", "analysis_date"),
    "spc_c_chart": ("process_id", "shift", "analysis_date"),
    "spc_monthly_alarm_rate": ("process_id", "tank_name", "item_name", "year", "month"),
}


def key_of(name: str, columns: Sequence[str]) -> list[str]:
    """Key columns of a published table, as far as it has them."""
    return [c for c in SERVING_KEYS[name] if c in columns]


VERSION = "updated_at"


def slice_for(df: DataFrame, day: str) -> DataFrame:
    """Rows to synchronise for a day: that day, or its month in a monthly table."""
    if "analysis_date" in df.columns:
        return df.filter(F.col("analysis_date") == F.lit(day).cast("date"))
    when = dt.date.fromisoformat(day)
    return df.filter((F.col("year") == when.year) & (F.col("month") == when.month))


def fill_defaults(df: DataFrame, keys: Sequence[str], day: str, now: Column, zero_numbers: bool = False) -> DataFrame:
    """Replace nulls that the serving table cannot hold, by column type.

    Dates become the day, timestamps the load time, key texts the empty text. Numbers stay null
    unless ``zero_numbers``, because an unknown index is not a bad one. Rows without the first key
    are dropped.
    """
    changes = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changes[f.name] = F.coalesce(c, now.cast(f.dataType))
        elif isinstance(f.dataType, T.DateType):
            changes[f.name] = F.coalesce(c, F.lit(day).cast("date"))
        elif isinstance(f.dataType, T.StringType) and f.name in keys:
            changes[f.name] = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.NumericType) and zero_numbers:
            changes[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
    return df.filter(F.col(keys[0]).isNotNull()).withColumns(changes)


def sync(
    gold: DataFrame, served: DataFrame, name: str, day: str, now: Column, zero_numbers: bool = False
) -> DataFrame:
    """Serving table after one synchronisation. Columns are matched by name."""
    return sync_all({name: gold}, {name: served}, day, now, zero_numbers)[name]


def final(served: DataFrame, name: str) -> DataFrame:
    """Newest version of every key."""
    return newest(served, key_of(name, served.columns), [VERSION])


def sync_all(
    gold: Mapping[str, DataFrame], served: Mapping[str, DataFrame], day: str, now: Column, zero_numbers: bool = False
) -> dict[str, DataFrame]:
    """Synchronise every published table; a table that is not served yet starts empty."""
    out = {}
    for name in SERVING_KEYS:
        if name not in gold:
            continue
        rows = fill_defaults(slice_for(gold[name], day), SERVING_KEYS[name], day, now, zero_numbers)
        stamped = rows.withColumn(VERSION, now)
        stored = served.get(name)
        out[name] = stamped if stored is None else stored.unionByName(stamped.select(*stored.columns))
    return out
