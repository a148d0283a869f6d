"""Gold from stored day rows: a run of some days reads those days, and of earlier ones only what its charts go on from.

The first run of a table has to cover history (``since``); from then on the measurements of a day are read by the run
of that day alone. Ranges may be run again and in any order: the day rows of a range replace those stored, and the
published charts equal those of one run over everything, if centre lines are given a baseline range. Without one they
go over all stored days, so charts published earlier keep the centre of their time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.operators import daily, spc
from plumbline.operators.daystate import DAY, DayTable, date_lit, month_of, stored_months
from plumbline.plans.gold import individuals_scope, month_range, product_scope, within
from plumbline.scale import keyset_join, materialise, together
from plumbline.sources.sinks import create_if_absent, rewrite
from plumbline.sources.versions import VersionedTable

#: A chart row looks back on 29 rows for its limits, its run rules on the limits of 8 rows before, and the first of all
#: these rows on the value before it.
INDIVIDUALS_DEPTH = 29 + 8 + 1
#: Rule 2 looks back on 8 rows; rule 3 on 5.
RULES_DEPTH = 8
TREND_DEPTH = 14

Range = tuple[str, str]


@dataclass(frozen=True)
class Source:
    """Measurements (as ``gold.chart_input``) and records of a range of days, both ends included.

    The functions push the range down to the partitions of what they read.
    """

    wide: Callable[[str, str], DataFrame]
    records: Callable[[str, str], DataFrame]


@dataclass(frozen=True)
class GoldState:
    """The stored day rows of all charts below one folder."""

    root: str

    def table(self, name: str, keys: Sequence[str], order: Sequence[str], depth: int, sums: Sequence[str] = ()) -> DayTable:
        return DayTable(f"{self.root}/{name}", tuple(keys), tuple(order), depth, tuple(sums))

    @property
    def individuals(self) -> DayTable:
        return self.table("individuals", spc.SHIFT_KEYS, ("place", *spc.LIMITS), INDIVIDUALS_DEPTH)

    @property
    def xbar_r(self) -> DayTable:
        return self.table("xbar_r", spc.CHART_KEYS, ("lsl", "usl"), RULES_DEPTH, ("xbar_grand",))

    @property
    def xbar_s(self) -> DayTable:
        return self.table("xbar_s", spc.CHART_KEYS, ("lsl", "usl"), RULES_DEPTH, ("xbar_grand",))

    @property
    def counts(self) -> DayTable:
        return self.table("counts", spc.COUNT_KEYS, (), RULES_DEPTH, ("p", "np"))

    @property
    def trend(self) -> DayTable:
        return self.table("trend", spc.CHART_KEYS, (), TREND_DEPTH)

    @property
    def baseline_days(self) -> VersionedTable:
        """Day rows of the keys whose baseline is still preliminary, at most as many as a baseline takes."""
        return VersionedTable(f"{self.root}/baseline_days")

    @property
    def baselines(self) -> VersionedTable:
        return VersionedTable(f"{self.root}/baselines")


def run_days(
    spark: SparkSession,
    state: GoldState,
    source: Source,
    start: str,
    end: str,
    tie: Sequence[str] = (),
    baseline: Range | None = None,
    subgroup_sizes: tuple[int, int] = (5, 10),
    since: str | None = None,
) -> dict[str, DataFrame]:
    """All gold tables for [start, end] as ``gold.gold_run``, and the state brought up to date.

    ``since`` is the first day of history, which is read once, while there is no state.
    """
    begin = min(start, since) if since and not state.individuals.exists(spark) else start
    wide, judged = together(
        lambda: materialise(source.wide(begin, end), "chart-input"), lambda: materialise(source.records(begin, end), "judged")
    )
    single, product = individuals_scope(wide), product_scope(wide)
    r_size, s_size = subgroup_sizes

    def put_subgroups() -> None:
        ordered = spc.day_order(product, tie=tie)
        state.xbar_r.put(spc.days_of_xbar_r(None, r_size, ordered=ordered), begin, end)
        state.xbar_s.put(spc.days_of_xbar_s(None, s_size, ordered=ordered), begin, end)

    together(
        lambda: state.individuals.put(spc.day_pieces(single, spc.SHIFT_KEYS, spc.LIMITS, tie), begin, end),
        put_subgroups,
        lambda: state.counts.put(spc.days_of_counts(judged), begin, end),
        lambda: _put_trend(spark, state.trend, spc.days_of_trend(wide), begin, end),
        lambda: _put_baselines(spark, state, single, tie, begin, end),
    )
    return tables(spark, state, within(judged, start, end), start, end, baseline)


def tables(
    spark: SparkSession, state: GoldState, judged: DataFrame, start: str, end: str, baseline: Range | None = None
) -> dict[str, DataFrame]:
    """The gold tables of [start, end] from the stored day rows. ``judged`` are the records of these days."""
    first, last = month_range(start, end)
    pieces = state.individuals.window(spark, first, last)
    chart = spc.chart_of_days(spc.statistics_of_days(pieces, spc.SHIFT_KEYS))
    chart = materialise(within(chart, first, last), "chart")

    def centres(table: DayTable, value: str) -> DataFrame:
        low, high = baseline or ("0001-01-02", "9998-12-31")
        return table.centres(spark, low, high, value)

    def subgroup_chart(table: DayTable, show: Callable[[DataFrame], DataFrame]) -> DataFrame:
        ruled = spc.ruled_days(table.window(spark, start, end), centres=centres(table, "xbar_grand"))
        return within(show(ruled), start, end)

    def count_chart(value: str, show: Callable[[DataFrame], DataFrame]) -> DataFrame:
        lined = spc.centred(state.counts.window(spark, start, end), value, spc.COUNT_KEYS, centres=centres(state.counts, value))
        return within(show(lined), start, end)

    return {
        "agg_qualification_rate_daily": daily.nonconformance_daily(judged),
        "agg_warning_statistics_daily": daily.warning_daily(judged),
        "spc_capability_daily": within(chart, start, end),
        "spc_baseline": state.baselines.read(spark),
        "spc_trend_ma": within(spc.with_simple_averages(state.trend.window(spark, start, end)), start, end),
        "spc_xbar_r_chart": subgroup_chart(state.xbar_r, spc.shown_xbar_r),
        "spc_xbar_s_chart": subgroup_chart(state.xbar_s, spc.shown_xbar_s),
        "spc_p_chart": count_chart("p", spc.p_chart_of_days),
        "spc_c_chart": count_chart("np", spc.c_chart_of_days),
        "spc_monthly_alarm_rate": spc.monthly_alarm_rate(chart),
    }


def _put_trend(spark: SparkSession, table: DayTable, days: DataFrame, start: str, end: str) -> None:
    """Store daily means with their exponential averages. Those of later days follow from them, so they are made anew."""
    spans = ("ema_7", "ema_14")
    fresh = days.withColumns({n: F.lit(None).cast("double") for n in spans})
    if not table.exists(spark):
        table.put(spc.smooth_exponentially(fresh, table.keys, "x", DAY, (7, 14)), start, end)
        return
    latest = max(stored_months(spark, table.rows))
    far = max(dt.date.fromisoformat(end), (latest + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)).isoformat()
    first = month_of(start).isoformat()
    held = table.window(spark, first, far)
    before = held.where(F.col(DAY) < date_lit(first))
    kept = held.where((F.col(DAY) >= date_lit(first)) & ~F.col(DAY).between(date_lit(start), date_lit(end)))
    unsure = kept.withColumns({n: F.lit(None).cast("double") for n in spans})
    rows = before.unionByName(unsure).unionByName(fresh.select(*before.columns))
    smoothed = spc.smooth_exponentially(rows, table.keys, "x", DAY, (7, 14))
    table.put(smoothed.where(F.col(DAY) >= date_lit(first)), first, far)


def _put_baselines(
    spark: SparkSession, state: GoldState, single: DataFrame, tie: Sequence[str], start: str, end: str
) -> None:
    """Bring preliminary baselines up to date. Rows of keys whose baseline is finished are not looked at."""
    keys = list(spc.CHART_KEYS)
    if state.baselines.exists(spark):
        done = state.baselines.read(spark).where("NOT is_preliminary")
        single = keyset_join(single, done, keys, "left_anti")
    days = spc.day_pieces(single, keys, (), tie)
    if state.baseline_days.exists(spark):
        held = state.baseline_days.read(spark)
        days = held.where(~F.col(DAY).between(date_lit(start), date_lit(end))).unionByName(days.select(*held.columns))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(DAY))
    early = materialise(days.withColumn("_place", place).where(F.col("_place") <= K.MIN_GROUPS).drop("_place"), "baseline-days")
    made = materialise(spc.baseline_of_days(spc.statistics_of_days(early, keys, ())), "baselines")
    if not create_if_absent(made, state.baselines):
        rewrite(state.baselines, lambda old: spc.freeze(old, made), spark)
    open_days = keyset_join(early, made.where("is_preliminary"), keys, "left_semi")
    if not create_if_absent(open_days, state.baseline_days):
        rewrite(state.baseline_days, lambda old: open_days, spark)
