"""Gold runs on stored day rows: equal to one run over everything, whatever the order, and reading only their range."""

import datetime as dt
import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from plumbline.operators import daystate, spc
from plumbline.plans import gold, goldstate

WIDE = (
    "analysis_id bigint, process_id string, tank_name string, item_name string, shift string, analysis_date date, "
    "analysis_datetime timestamp, x double, lsl double, usl double, cl double, overall_judgment string, char_type string"
)
BASELINE = ("2024-01-10", "2024-02-20")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Five months: a series with a few hundred days, one that reports rarely, one that begins late and has no name."""
    rnd, data = random.Random(5), []
    for key, every, first in (("a", 1, 0), ("b", 11, 0), (None, 2, 70)):
        for day in range(first, 150, every):
            for _ in range(rnd.randrange(4, 16)):
                at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=rnd.randrange(86_400))
                limits = (0.0, 20.0, 10.0) if rnd.random() < 0.8 else (1.0, 15.0, None)
                x = None if rnd.random() < 0.03 else round(rnd.gauss(9 + day / 60, 3), 3)
                kind = rnd.choice(["chemical", "product", "product"])
                bad = "NG" if rnd.random() < 0.2 else "OK"
                data.append((len(data), key, "t", "i", rnd.choice("AB"), at.date(), at, x, *limits, bad, kind))
    path = str(tmp_path_factory.mktemp("raw") / "wide")
    spark.createDataFrame(data, WIDE).write.partitionBy("analysis_date").parquet(path)
    return path


def source(spark, path):
    def cut(start, end):
        return gold.within(spark.read.schema(WIDE).parquet(path), start, end)

    return goldstate.Source(cut, cut)


def values(df):
    """All rows, with doubles rounded."""
    return rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in sorted(df.dtypes)]))


def test_runs_in_any_order_equal_one_run(spark, raw, tmp_path):
    """Months out of order, a range across a border, a single day, and one range twice; all ten tables by value."""
    everything = spark.read.schema(WIDE).parquet(raw)
    whole = gold.gold_run(everything, everything, "2024-01-01", "2024-05-31", tie=["analysis_id"], baseline=BASELINE, stage=True)
    state, src, root = goldstate.GoldState(str(tmp_path / "state")), source(spark, raw), str(tmp_path / "gold")
    ranges = [("2024-03-05", "2024-03-31"), ("2024-01-01", "2024-03-04"), ("2024-04-01", "2024-05-31"), ("2024-04-09", "2024-04-09")]
    for start, end in ranges:
        made = goldstate.run_days(spark, state, src, start, end, ["analysis_id"], BASELINE, since="2024-01-01")
        gold.publish(spark, made, root, start, end)
    assert len(whole) == 10
    for name, want in whole.items():
        got = gold.published(root, name).read(spark).select(*want.columns)
        assert values(got) == values(want), name
        assert got.count() > 0


def test_one_day_has_the_limits_of_the_full_run(spark, raw, tmp_path):
    """Centre lines of a baseline range do not depend on what is run; without one they go over the stored days."""
    everything = spark.read.schema(WIDE).parquet(raw)
    state, src = goldstate.GoldState(str(tmp_path / "state")), source(spark, raw)
    goldstate.run_days(spark, state, src, "2024-01-01", "2024-04-30", ["analysis_id"], BASELINE)
    made = goldstate.run_days(spark, state, src, "2024-05-02", "2024-05-02", ["analysis_id"], BASELINE)
    for name, chart in (("spc_p_chart", spc.p_chart), ("spc_c_chart", spc.c_chart)):
        want = gold.within(chart(everything, baseline=BASELINE), "2024-05-02", "2024-05-02")
        assert values(made[name]) == values(want) and made[name].count() > 0
        until = gold.within(everything, "2024-01-01", "2024-04-30").unionByName(gold.within(everything, "2024-05-02", "2024-05-02"))
        bare = goldstate.tables(spark, state, everything, "2024-05-02", "2024-05-02")[name]
        assert values(bare) == values(gold.within(chart(until), "2024-05-02", "2024-05-02"))


def test_a_run_reads_only_its_range_and_the_openings(spark, raw, tmp_path):
    state = goldstate.GoldState(str(tmp_path / "state"))
    seen = []

    def cut(start, end):
        df = source(spark, raw).wide(start, end)
        seen.append(plan(df))
        assert len(df.inputFiles()) <= 8 * 31
        return df

    src = goldstate.Source(cut, cut)
    goldstate.run_days(spark, state, src, "2024-01-01", "2024-04-30", ["analysis_id"])
    seen.clear()
    goldstate.run_days(spark, state, src, "2024-05-06", "2024-05-06", ["analysis_id"])
    assert seen and all("PartitionFilters: [isnotnull(analysis_date" in t and "2024-05-06" in t for t in seen)
    window = state.individuals.window(spark, "2024-05-06", "2024-05-06")
    text = plan(window)
    assert text.count("PartitionFilters: [isnotnull(month_start") == 2
    months = {f.split("month_start=")[1][:10] for f in window.inputFiles() if "/rows/" in f}
    assert months <= {"2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01"}
    assert window.where("analysis_date < '2024-05-01'").groupBy(*spc.SHIFT_KEYS).count().agg(F.max("count")).first()[0] <= 2 * goldstate.INDIVIDUALS_DEPTH


def test_openings_are_the_last_rows_and_the_running_totals(spark, tmp_path):
    """After puts in any order, each month's openings are what a plain computation gives."""
    rnd = random.Random(2)
    days = {(k, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(300))): rnd.randrange(100) for k in "xyz" for _ in range(25)}
    days |= {(None, dt.date(2024, 2, 10)): 7}
    table = daystate.DayTable(str(tmp_path / "t"), ("k",), (), 4, ("v",))
    frame = lambda lo, hi: spark.createDataFrame(
        [(k, d, float(v)) for (k, d), v in days.items() if lo <= d.isoformat() <= hi], "k string, analysis_date date, v double"
    )
    for lo, hi in (("2024-05-10", "2024-06-20"), ("2024-01-01", "2024-05-09"), ("2024-09-01", "2024-10-31"), ("2024-06-21", "2024-08-31")):
        table.put(frame(lo, hi), lo, hi)
    gone = ("2024-07-01", "2024-07-31")
    table.put(frame("2030-01-01", "2030-01-02"), *gone)
    days = {k: v for k, v in days.items() if not gone[0] <= k[1].isoformat() <= gone[1]}
    for month in range(2, 11):
        border = dt.date(2024, month, 1)
        want, totals = [], {}
        for k in "xyz":
            own = sorted((d, v) for (q, d), v in days.items() if q == k and d < border)
            want += [(k, d, float(v)) for d, v in own[-4:]]
            if own:
                totals[k] = (len(own), float(sum(v for _, v in own)))
        if border > dt.date(2024, 2, 10):
            want.append((None, dt.date(2024, 2, 10), 7.0))
            totals[None] = (1, 7.0)
        opened = table.window(spark, border.isoformat(), border.isoformat()).where(F.col("analysis_date") < border)
        assert rows(opened, "k", "analysis_date", "v") == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t)), month
        assert {r.k: (r._rows, r.v) for r in table.before(spark, border.isoformat()).collect()} == totals
    mean = {r.k: r._centre for r in table.centres(spark, "2024-03-07", "2024-06-19", "v").collect()}
    for k in "xyz":
        own = [v for (q, d), v in days.items() if q == k and dt.date(2024, 3, 7) <= d <= dt.date(2024, 6, 19)]
        assert mean[k] == pytest.approx(sum(own) / len(own))
    assert mean[None] is None
