"""Day rows that a later run goes on from, with what it needs of the days before its range.

A chart's day rows are small next to the measurements, but they too grow with history. Each is stored in the partition
of its month, and for every month there are two openings: the last ``depth`` rows of each series before it, and, for
centre lines, running totals of each series up to it. So a run of some days reads the months of its range and the
openings of the first one, whatever history there is; and the totals of any range of days are a difference of two
openings, each moved on by the rows of a part of a month.

When rows of a month change, the openings of all later months are made anew, in one job from the month's own opening.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.scale import null_safe_join
from plumbline.sources.sinks import create_if_absent
from plumbline.sources.versions import VersionedTable

DAY = "analysis_date"
MONTH = "month_start"


def month_of(day: str) -> dt.date:
    return dt.date.fromisoformat(day).replace(day=1)


def following(month: dt.date) -> dt.date:
    return (month + dt.timedelta(days=32)).replace(day=1)


def date_lit(day: str | dt.date) -> Column:
    return F.lit(str(day)).cast("date")


def stored_months(spark: SparkSession, table: VersionedTable) -> list[dt.date]:
    """Months that a table has partitions of, by its manifest."""
    now = table.current(spark)
    return [dt.date.fromisoformat(k.removeprefix(f"{MONTH}=")) for k in now.entries] if now else []


def month_frame(spark: SparkSession, months: Sequence[dt.date]) -> DataFrame:
    return spark.createDataFrame([(m,) for m in months], f"{MONTH} date")


@dataclass(frozen=True)
class DayTable:
    """Stored day rows of one chart: ``keys`` name a series, ``order`` its rows beside the day.

    ``sums`` are the columns of which running totals are kept, along with the number of rows.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    depth: int
    sums: tuple[str, ...] = ()

    @property
    def rows(self) -> VersionedTable:
        return VersionedTable(f"{self.path}/rows", (MONTH,))

    @property
    def tails(self) -> VersionedTable:
        return VersionedTable(f"{self.path}/tails", (MONTH,))

    @property
    def totals(self) -> VersionedTable:
        return VersionedTable(f"{self.path}/totals", (MONTH,))

    def exists(self, spark: SparkSession) -> bool:
        return self.shape.exists(spark)

    @property
    def shape(self) -> VersionedTable:
        """No rows, but the types of all columns, which a table without months can't tell."""
        return VersionedTable(f"{self.path}/shape")

    def stored(self, spark: SparkSession) -> DataFrame:
        return self.rows.typed(self.shape.read(spark).schema).read(spark)

    def put(self, days: DataFrame, start: str, end: str) -> None:
        """Replace the rows of [start, end] and bring the openings of all later months up to date."""
        spark = days.sparkSession
        monthly = days.withColumn(MONTH, F.trunc(DAY, "MM"))
        first, last = month_of(start), month_of(end)
        months, month = [], first
        while month <= last:
            months.append(month)
            month = following(month)
        if not create_if_absent(monthly.limit(0).coalesce(1), self.shape) and self.rows.exists(spark):
            # only the months of the range are read
            inside = F.col(DAY).between(date_lit(start), date_lit(end))
            held = self.stored(spark).where(F.col(MONTH).between(date_lit(first), date_lit(last)))
            monthly = held.where(~inside).select(*monthly.columns).unionByName(monthly)
        # a month that is left without rows ends
        self.rows.replace_partitions(monthly, month_frame(spark, months))
        self.refresh(spark, first)

    def refresh(self, spark: SparkSession, first: dt.date) -> None:
        """Openings of all months after ``first``, up to the one behind the last stored month."""
        latest = max(stored_months(spark, self.rows), default=None)
        if latest is None:
            return
        stored = self.stored(spark).where(F.col(MONTH) >= date_lit(first))
        behind = following(max(latest, first))
        names = [c for c in stored.columns if c != MONTH]
        until = lambda month: F.least(F.coalesce(month, date_lit(behind)), date_lit(behind))

        def months(begin: Column, end: Column) -> Column:
            """Months from the one after ``begin`` to ``end``; none if that is before."""
            after = F.add_months(begin, 1)
            return F.when(after <= end, F.sequence(after, end, F.expr("interval 1 month")))

        # the rows before the month take part as if they lay in the month before it
        earlier = F.add_months(date_lit(first), -1)
        before = self._opening(spark, self.tails, first, names, stored)
        rows = stored.select(*names, MONTH).unionByName(before.select(*names, earlier.alias(MONTH)))
        series = W.partitionBy(*self.keys).orderBy(DAY, *self.order)
        pushed_out = F.lead(MONTH, self.depth).over(series)
        known = rows.withColumn("_until", until(pushed_out))
        tails = known.withColumn("_month", F.explode(months(F.greatest(F.col(MONTH), earlier), F.col("_until"))))
        tails = tails.where(F.col("_month") > date_lit(first)).select(*names, F.col("_month").alias(MONTH))
        self._replace_after(tails, self.tails, first, behind)
        if self.sums:
            own = stored.groupBy(*self.keys, MONTH).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(c) for c in self.sums])
            counted = ["_rows", *self.sums]
            old = self._opening(spark, self.totals, first, [*self.keys, *counted], own)
            parts = own.unionByName(old.withColumn(MONTH, earlier).select(*own.columns))
            series = W.partitionBy(*self.keys).orderBy(MONTH)
            through = series.rowsBetween(W.unboundedPreceding, 0)
            run = parts.select(
                *self.keys, MONTH, *[F.sum(c).over(through).alias(c) for c in counted], until(F.lead(MONTH).over(series)).alias("_until")
            )
            spread = run.withColumn("_month", F.explode(months(F.col(MONTH), F.col("_until"))))
            spread = spread.where(F.col("_month") > date_lit(first)).select(*self.keys, *counted, F.col("_month").alias(MONTH))
            self._replace_after(spread, self.totals, first, behind)

    def _opening(
        self, spark: SparkSession, table: VersionedTable, month: dt.date, names: Sequence[str], like: DataFrame
    ) -> DataFrame:
        """Rows of the opening of a month: of its partition, or of the last one stored, if that is earlier."""
        if not stored_months(spark, table):
            return like.select(*names).limit(0)
        at = min(month, max(stored_months(spark, table), default=month))
        return table.read(spark).where(F.col(MONTH) == date_lit(at)).select(*names)

    def _replace_after(self, made: DataFrame, table: VersionedTable, first: dt.date, behind: dt.date) -> None:
        months, month = [], following(first)
        while month <= behind:
            months.append(month)
            month = following(month)
        table.replace_partitions(made, month_frame(made.sparkSession, months))

    def window(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        """The rows of the months from ``start`` to ``end``, up to ``end``, and the opening of the first one."""
        first = month_of(start)
        stored = self.stored(spark)
        names = [c for c in stored.columns if c != MONTH]
        inside = stored.where(F.col(MONTH).between(date_lit(first), date_lit(month_of(end))) & (F.col(DAY) <= date_lit(end)))
        return inside.select(*names).unionByName(self._opening(spark, self.tails, first, names, stored))

    def before(self, spark: SparkSession, day: str) -> DataFrame:
        """Totals of each series over all days before ``day``: ``keys``, ``_rows`` and the sums."""
        month = month_of(day)
        counted = ["_rows", *self.sums]
        stored = self.stored(spark)
        part = stored.where((F.col(MONTH) == date_lit(month)) & (F.col(DAY) < date_lit(day)))
        part = part.groupBy(*self.keys).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(c) for c in self.sums])
        opening = self._opening(spark, self.totals, month, [*self.keys, *counted], part)
        both = opening.unionByName(part.select(*opening.columns))
        return both.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in counted])

    def centres(self, spark: SparkSession, start: str, end: str, value: str) -> DataFrame:
        """Mean of a summed column over the rows of each series in [start, end], as ``_centre``."""
        after = (dt.date.fromisoformat(end) + dt.timedelta(days=1)).isoformat()
        low = self.before(spark, start).select(*self.keys, F.col("_rows").alias("_less"), F.col(value).alias("_low"))
        both = null_safe_join(self.before(spark, after), low, self.keys, "left")
        rows = F.col("_rows") - F.coalesce("_less", F.lit(0))
        total = F.col(value) - F.coalesce("_low", F.lit(0))
        return both.select(*self.keys, F.when(rows > 0, total / rows).alias("_centre"))
