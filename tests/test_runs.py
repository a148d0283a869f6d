"""Loads and audits that run their input once, and backfills that survive a lost runner."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.operators import backfill, policy, spec, watermark
from plumbline.plans import bronze
from plumbline.scale import materialise
from plumbline.sources.versions import VersionedTable

NOW = dt.datetime(2024, 2, 1)
RAW = f"id string, name string, __deleted string, {bronze.INGESTED} timestamp_ntz"


def counted(df):
    """The frame, and a counter of the rows that pass it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def feed(spark, *rows_):
    return spark.createDataFrame([(i, n, "false", dt.datetime(2024, 1, d)) for i, n, d in rows_], RAW)


def clean(df):
    return bronze.dimension(df, F.lit(NOW).cast("timestamp"))


def test_a_load_reads_its_batch_once(spark, tmp_path):
    target, state = VersionedTable(str(tmp_path / "t")), watermark.empty_state(spark)
    for batch, days in ((feed(spark, ("1", "a", 1), ("2", "b", 2)), 2), (feed(spark, ("1", "a", 1), ("2", "b", 2), ("2", "c", 3), ("3", "d", 4)), 4)):
        source, seen = counted(batch)
        state = materialise(bronze.load_into(source, target, state, "t", clean, ["id"], NOW))
        assert seen.value == batch.count()
        assert state.first().max_ts == dt.datetime(2024, 1, days)
    assert rows(target.read(spark), "id", "name") == [("1", "a"), ("2", "c"), ("3", "d")]
    before = rows(state)
    again = bronze.load_into(feed(spark, ("3", "d", 4)), target, state, "t", clean, ["id"], NOW)
    assert rows(again) == before and target.read(spark).count() == 3


@pytest.mark.parametrize("into", [True, False])
def test_a_source_that_grows_meanwhile_loses_nothing(spark, tmp_path, monkeypatch, into):
    """Rows that arrive between the merge and the mark are read by the next load."""
    path = str(tmp_path / "raw")
    feed(spark, ("1", "a", 1)).write.parquet(path)
    target, state = VersionedTable(str(tmp_path / "t")), watermark.empty_state(spark)
    stored = None

    def load():
        nonlocal stored, state
        raw = spark.read.schema(RAW).parquet(path)
        if into:
            state = materialise(bronze.load_into(raw, target, state, "t", clean, ["id"], NOW))
            stored = target.read(spark)
        else:
            merged, marks = bronze.load(raw, stored, state, "t", clean, ["id"], NOW)
            stored = materialise(merged)
            late()
            state = materialise(marks)

    def late():
        if spark.read.parquet(path).count() == 1:
            feed(spark, ("2", "b", 2)).write.mode("append").parquet(path)

    publish = VersionedTable.publish

    def grow(self, *args):
        late()
        return publish(self, *args)

    monkeypatch.setattr(VersionedTable, "publish", grow)
    load()
    assert rows(stored, "id") == [("1",)]
    load()
    assert rows(stored, "id") == [("1",), ("2",)]


def test_an_audit_counts_the_rows_that_were_answered(spark, tmp_path):
    path = str(tmp_path / "audit")
    df, seen = counted(spark.range(50).withColumn("v", F.col("id") % 5))
    govern = policy.govern(df, policy.Decision(row_filters=["v < 2"]))
    got = policy.append_audit(govern, path, "ann", "few", lambda d: d.collect())
    assert len(got) == 20 and seen.value == 50
    empty = policy.append_audit(govern.where("false"), path, "bob", "none", lambda d: d.collect())
    assert empty == []
    assert rows(spark.read.parquet(path), "subject_ref", "answered_rows") == [("ann", 20), ("bob", 0)]


def test_limits_of_a_contract_are_errors(spark):
    df = spark.range(500).withColumnRenamed("id", "a")
    contract = spec.DataContract({"a": "a"}, max_size=100)
    assert spec.serve_contract(df, contract, {}).count() == 100
    assert spec.serve_contract(df, contract, {"_limit": "7"}).count() == 7
    for asked in ("400", "0", "many", "-3"):
        with pytest.raises(SpecError):
            spec.serve_contract(df, contract, {"_limit": asked})


# --- backfills


@pytest.fixture
def ledger(tmp_path):
    return backfill.ledger_at(str(tmp_path / "ledger"))


def states(spark, ledger):
    return rows(backfill.entries(spark, ledger, "j"), "month_start", "status", "attempts")


MONTHS = [dt.date(2024, m, 1) for m in (1, 2, 3)]


def test_failed_months_are_tried_again(spark, ledger):
    backfill.plan(spark, ledger, "j", dt.date(2024, 1, 10), dt.date(2024, 3, 20))
    ran, broken = [], {MONTHS[1]}

    def run(start, end):
        if start in broken:
            raise RuntimeError("no space")
        ran.append((start, end))

    left = backfill.run_backfill(spark, ledger, "j", run, "one")
    assert states(spark, ledger) == [(MONTHS[0], "done", 1), (MONTHS[1], "failed", 1), (MONTHS[2], "done", 1)]
    assert left.where("status = 'failed'").first().error == "RuntimeError: no space"
    broken.clear()
    backfill.run_backfill(spark, ledger, "j", run, "one")
    assert states(spark, ledger) == [(MONTHS[0], "done", 1), (MONTHS[1], "done", 2), (MONTHS[2], "done", 1)]
    assert ran == [(dt.date(2024, 1, 10), dt.date(2024, 1, 31)), (MONTHS[2], dt.date(2024, 3, 20)), (MONTHS[1], dt.date(2024, 2, 29))]
    backfill.plan(spark, ledger, "j", dt.date(2024, 1, 10), dt.date(2024, 4, 20))
    assert states(spark, ledger)[3] == (dt.date(2024, 4, 1), "planned", 0) and len(states(spark, ledger)) == 4


def test_a_lost_runner_is_replaced_after_its_lease(spark, ledger):
    class Lost(BaseException):
        pass

    backfill.plan(spark, ledger, "j", MONTHS[0], dt.date(2024, 3, 31))
    ran = []

    def lose(start, end):
        if start == MONTHS[1]:
            raise Lost
        ran.append(start)

    with pytest.raises(Lost):
        backfill.run_backfill(spark, ledger, "j", lose, "one")
    assert states(spark, ledger) == [(MONTHS[0], "done", 1), (MONTHS[1], "running", 1), (MONTHS[2], "planned", 0)]
    note = lambda a, b: ran.append(a)
    backfill.run_backfill(spark, ledger, "j", note, "two", lease_seconds=3600)
    assert ran == [MONTHS[0], MONTHS[2]]
    backfill.run_backfill(spark, ledger, "j", note, "two", lease_seconds=0)
    assert ran == [MONTHS[0], MONTHS[2], MONTHS[1]] and {s for _, s, _ in states(spark, ledger)} == {"done"}


def test_months_in_order_wait_for_a_failed_one(spark, ledger):
    backfill.plan(spark, ledger, "j", MONTHS[0], dt.date(2024, 3, 31))
    ran, broken = [], [MONTHS[1]]

    def run(start, end):
        ran.append(start)
        if start in broken:
            broken.remove(start)
            raise RuntimeError("down")

    backfill.run_backfill(spark, ledger, "j", run, "one", in_order=True)
    assert ran == MONTHS[:2] and states(spark, ledger)[2] == (MONTHS[2], "planned", 0)
    backfill.run_backfill(spark, ledger, "j", run, "one", in_order=True)
    assert ran == [*MONTHS[:2], *MONTHS[1:]] and {s for _, s, _ in states(spark, ledger)} == {"done"}


def test_two_runners_share_the_months(spark, ledger):
    """A claim that another runner was faster with is given up, and the next month is taken."""
    backfill.plan(spark, ledger, "j", MONTHS[0], dt.date(2024, 3, 31))
    publish, raced = VersionedTable.publish, []

    def race(self, spark_, change, note=""):
        if not raced:
            raced.append(1)
            other = backfill.claim(spark, ledger, "j", "two", 3600)
            assert other["month_start"] == MONTHS[0]
        return publish(self, spark_, change, note)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(VersionedTable, "publish", race)
        mine = backfill.claim(spark, ledger, "j", "one", 3600)
    assert mine["month_start"] == MONTHS[1]
    assert rows(backfill.entries(spark, ledger, "j"), "month_start", "owner") == [(MONTHS[0], "two"), (MONTHS[1], "one"), (MONTHS[2], None)]
