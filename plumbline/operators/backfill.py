"""Backfills month by month, with a ledger that outlives the session.

The ledger is a versioned table with one partition per job and month. A month is planned, then claimed by a runner, run,
and done or failed. A claim is a change of the month's partition, so of two runners only one gets it. A runner that is
lost leaves its month running; once its lease is over the month is claimed anew. What a month's job publishes has to be
safe to repeat, as a job may be lost between its last write and the ledger's.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import ConflictError
from plumbline.operators.watermark import month_batches
from plumbline.sources.versions import VersionedTable

LEDGER = (
    "job string, month_start date, batch_start date, batch_end date, status string, attempts int, owner string, "
    "changed_at double, error string"
)
BY = ("job", "month_start")
PLANNED, RUNNING, DONE, FAILED = "planned", "running", "done", "failed"


def ledger_at(path: str) -> VersionedTable:
    return VersionedTable(path, BY)


def entries(spark: SparkSession, ledger: VersionedTable, job: str) -> DataFrame:
    return ledger.read(spark).where(F.col("job") == job)


def plan(spark: SparkSession, ledger: VersionedTable, job: str, start: dt.date, end: dt.date, again: bool = False) -> None:
    """Enter the months of [start, end]. Months that were entered before keep their state, unless ``again``."""
    known = set()
    if ledger.exists(spark) and not again:
        known = {r.month_start for r in entries(spark, ledger, job).select("month_start").collect()}
    new = [
        (job, a.replace(day=1), a, b, PLANNED, 0, None, time.time(), None)
        for a, b in month_batches(start, end)
        if a.replace(day=1) not in known
    ]
    if new:
        ledger.replace_partitions(spark.createDataFrame(new, LEDGER).coalesce(1))


def _put(spark: SparkSession, ledger: VersionedTable, row: dict) -> None:
    ledger.replace_partitions(spark.createDataFrame([tuple(row[c.split()[0]] for c in LEDGER.split(", "))], LEDGER).coalesce(1))


def claim(
    spark: SparkSession,
    ledger: VersionedTable,
    job: str,
    owner: str,
    lease_seconds: float,
    skip: Sequence[dt.date] = (),
    in_order: bool = False,
) -> dict | None:
    """The earliest month that waits for a runner, now this one's; None if there is none.

    Months wait that are planned, that failed, or whose runner was not heard of for ``lease_seconds``. With ``in_order`` a
    month also waits for all earlier ones to be done.
    """
    while True:
        over = (F.col("status") == RUNNING) & (F.col("changed_at") <= time.time() - lease_seconds)
        waits = F.col("status").isin(PLANNED, FAILED) | over
        if skip:
            waits = waits & ~F.col("month_start").isin(list(skip))
        open_months = entries(spark, ledger, job).where(F.col("status") != DONE).withColumn("_waits", waits)
        first = (open_months if in_order else open_months.where("_waits")).orderBy("month_start").limit(1).collect()
        if not first or not first[0]["_waits"]:
            return None
        row = first[0].asDict() | {"status": RUNNING, "owner": owner, "changed_at": time.time(), "error": None}
        row["attempts"] += 1
        try:
            _put(spark, ledger, row)
        except ConflictError:
            continue
        return row


def run_backfill(
    spark: SparkSession,
    ledger: VersionedTable,
    job: str,
    run: Callable[[dt.date, dt.date], None],
    owner: str,
    lease_seconds: float = 3600.0,
    in_order: bool = False,
) -> DataFrame:
    """Run the months that wait, one after the other; returns the ledger.

    A month that fails is noted, and a later call, of whatever session, tries it again. It doesn't stop the others, unless
    ``in_order``: a job that goes on from earlier months must not run before them.
    """
    tried: list[dt.date] = []
    while (row := claim(spark, ledger, job, owner, lease_seconds, tried, in_order)) is not None:
        tried.append(row["month_start"])
        try:
            run(row["batch_start"], row["batch_end"])
            row |= {"status": DONE}
        except Exception as error:
            row |= {"status": FAILED, "error": f"{type(error).__name__}: {error}"[:500]}
        _put(spark, ledger, row | {"changed_at": time.time()})
    return entries(spark, ledger, job)
