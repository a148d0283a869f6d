"""Hand-computed cases and brute-force comparison of the control charts."""

import datetime as dt
import random
import statistics

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.operators import daily, series, spc

DAY0 = dt.date(2024, 1, 1)
CHART = "process_id string, d int, v double, c double"
MEASURE = (
    "analysis_id bigint, process_id string, tank_name string, item_name string, shift string, analysis_date date, "
    "analysis_datetime timestamp, x double, lsl double, usl double, cl double"
)


def ruled(spark, values, centre=10.0):
    data = [("p", i, float(v), centre) for i, v in enumerate(values)]
    out = spc.run_rules(spark.createDataFrame(data, CHART), "v", "c", ["process_id"], ["d"]).orderBy("d").collect()
    return [r.r2_flag for r in out], [r.r3_flag for r in out], [r.r3_direction for r in out]


def test_nine_on_one_side(spark):
    assert ruled(spark, [11] * 9)[0] == [0] * 8 + [1]
    assert ruled(spark, [9] * 10)[0] == [0] * 8 + [1, 1]
    assert ruled(spark, [11] * 8 + [10] + [11])[0] == [0] * 10


def test_six_in_a_row(spark):
    _, trend, way = ruled(spark, [1, 2, 3, 4, 5, 6])
    assert trend == [0] * 5 + [1] and way[-1] == 1
    assert ruled(spark, [6, 5, 4, 3, 2, 1])[2][-1] == -1
    assert ruled(spark, [1, 2, 3, 3, 4, 5, 6])[1] == [0] * 7


def measured(spark, data):
    """data: (key, day offset, second of day, value[, lsl, usl, cl])"""
    made = []
    for i, (key, day, second, x, *limits) in enumerate(data):
        lsl, usl, cl = limits or (0.0, 20.0, 10.0)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=second)
        made.append((i, key, "t", "i", "A", at.date(), at, x, lsl, usl, cl))
    return spark.createDataFrame(made, MEASURE)


def test_moving_range_crosses_slices_and_days(spark):
    df = measured(spark, [("p", 0, 0, 1.0), ("p", 0, 5000, 4.0), ("p", 1, 10, 2.0)])
    out = spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"])
    assert rows(out, "analysis_date", "mr_bar_d", "xbar_d") == [(DAY0, 3.0, 2.5), (dt.date(2024, 1, 2), 2.0, 2.0)]


def burst(spark, n, at_once):
    """One key: a share of all rows at one instant, some without an instant, the rest spread over two days."""
    k = F.col("id")
    instant = (
        F.when(k % 3 == 0, F.lit(1704067200000 + 40_000_000)).when(k % 11 == 0, None).otherwise(1704067200000 + (k * 7919) % 172_800_000)
    )
    at = F.timestamp_millis(instant if at_once else F.lit(1704067200000) + (k * 7919) % 172_800_000)
    return spark.range(n).select(
        F.col("id").alias("analysis_id"), F.lit("p").alias("process_id"), F.lit("t").alias("tank_name"),
        F.lit("i").alias("item_name"), F.lit("A").alias("shift"), F.coalesce(F.to_date(at), F.lit(DAY0)).alias("analysis_date"),
        at.alias("analysis_datetime"), F.round(F.sin(k), 6).alias("x"), F.lit(-0.9).alias("lsl"), F.lit(0.9).alias("usl"), F.lit(0.0).alias("cl"),
    )


def loop_statistics(members):
    """Plain daily statistics of one key: (day, limits) -> (n, mean, mean range, deviation)."""
    order = sorted(members, key=lambda r: (r.analysis_date, r.analysis_datetime or dt.datetime.min, r.analysis_id))
    out = {}
    for i, r in enumerate(order):
        mr = abs(r.x - order[i - 1].x) if i else None
        out.setdefault(r.analysis_date, []).append((r.x, mr))
    return {
        d: (len(v), statistics.fmean(x for x, _ in v), statistics.fmean(m for _, m in v if m is not None), statistics.stdev(x for x, _ in v))
        for d, v in out.items()
    }, order


def test_a_third_of_the_rows_at_one_instant(spark):
    """Neither an instant nor rows without one gather in a task, and the results are those of a plain loop."""
    df = burst(spark, 30_000, True)
    dealt = series.walked(df, [*spc.SHIFT_KEYS, "analysis_date"], "x", ["analysis_datetime", "analysis_id"])
    # adaptive execution would put so few rows into one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in dealt.groupBy(series.task_of()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
        want, order = loop_statistics(df.collect())
        got = {r.analysis_date: r for r in spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"]).collect()}
        groups = {(r.analysis_date, r._subgroup): r.xbar_i for r in spc.subgroups(df, 7, tie=["analysis_id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.keys() == want.keys()
    for d, (n, mean, mr, dev) in want.items():
        r = got[d]
        assert (r.n_samples, r.xbar_d, r.mr_bar_d, r.sigma_overall_d) == (n, *map(pytest.approx, (mean, mr, dev)))
        xs = [r.x for r in order if r.analysis_date == d]
        own = {k: statistics.fmean(xs[7 * k : 7 * k + 7]) for k in range(len(xs) // 7)}
        assert {k for day, k in groups if day == d} == set(own)
        assert all(groups[d, k] == pytest.approx(m) for k, m in own.items())


def test_equal_rows_are_dealt_over_tasks(spark):
    df = burst(spark, 8_000, False).withColumns({"analysis_id": F.lit(1), "x": F.lit(2.0), "analysis_datetime": F.lit(None).cast("timestamp"),
                                                 "analysis_date": F.lit(DAY0)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = series.walked(df, ["process_id"], "x", ["analysis_datetime", "analysis_id"])
        assert max(r["count"] for r in dealt.groupBy(series.task_of()).count().collect()) < 2_000
        (r,) = spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (r.n_samples, r.xbar_d, r.mr_bar_d, r.sigma_overall_d) == (8_000, 2.0, 0.0, 0.0)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_daily_statistics_equal_a_plain_loop(spark, tasks):
    """One key holds most rows, instants repeat, limits change inside a day, some values are missing; few and many tasks."""
    rnd = random.Random(7)
    data = []
    for _ in range(600):
        key = "hot" if rnd.random() < 0.6 else rnd.choice([None, "b", "c"])
        limits = (0.0, 20.0, 10.0) if rnd.random() < 0.7 else (1.0, 15.0, None)
        x = None if rnd.random() < 0.05 else round(rnd.gauss(9, 4), 3)
        data.append((key, rnd.randrange(4), rnd.randrange(0, 86_400, 400), x, *limits))
    df = measured(spark, data)
    settings = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.process_id, r.analysis_date, r.lsl): r for r in found}
    assert len(got) == len(found)
    of_key, groups = {}, {}
    ordered = sorted(df.collect(), key=lambda r: (r.analysis_date, r.analysis_datetime, r.analysis_id))
    for r in ordered:
        before = of_key.get(r.process_id, [])
        mr = abs(r.x - before[-1]) if before and r.x is not None and before[-1] is not None else None
        of_key.setdefault(r.process_id, []).append(r.x)
        groups.setdefault((r.process_id, r.analysis_date, r.lsl), []).append((r.x, mr, r.lsl, r.usl))
    assert got.keys() == groups.keys()
    for key, members in groups.items():
        xs = [m[0] for m in members if m[0] is not None]
        mrs = [m[1] for m in members if m[1] is not None]
        row = got[key]
        assert row.n_samples == len(members)
        assert row.oospec_points == sum(1 for m in members if m[0] is not None and not m[2] <= m[0] <= m[3])
        assert row.xbar_d == (pytest.approx(statistics.fmean(xs)) if xs else None)
        assert row.mr_bar_d == (pytest.approx(statistics.fmean(mrs)) if mrs else None)
        assert row.sigma_overall_d == (pytest.approx(statistics.stdev(xs)) if len(xs) > 1 else None)


def test_pieces_of_days_go_on_from_each_other(spark):
    """Statistics of pieces that were computed apart, in any order, equal those of all rows."""
    rnd = random.Random(11)
    data = [(rnd.choice("ab"), rnd.randrange(6), rnd.randrange(86_400), rnd.random(), 0.0, rnd.choice([0.8, 0.9]), 0.5) for _ in range(500)]
    df = measured(spark, data)
    parts = [df.where(F.dayofmonth("analysis_date").isin(*d)) for d in ([4, 6], [1], [2, 3, 5])]
    pieces = [spc.day_pieces(p, spc.SHIFT_KEYS, tie=["analysis_id"]) for p in parts]
    merged = spc.statistics_of_days(pieces[0].unionByName(pieces[1]).unionByName(pieces[2]), spc.SHIFT_KEYS)
    whole = spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"])
    shown = lambda d: rows(d, *[F.round(c, 9).alias(c) if t == "double" else c for c, t in whole.dtypes])
    assert shown(merged) == shown(whole)


def test_deviation_is_stable_for_large_values(spark):
    df = measured(spark, [("p", 0, i * 700, 1e9 + i % 2) for i in range(100)])
    out = spc.daily_statistics(df, spc.SHIFT_KEYS, tie=["analysis_id"]).first()
    assert out.sigma_overall_d == pytest.approx(statistics.stdev([i % 2 for i in range(100)]), rel=1e-9)


@pytest.mark.parametrize("size", [2, 5])
def test_subgroups_equal_a_plain_loop(spark, size):
    rnd = random.Random(3)
    data = [
        ("hot" if rnd.random() < 0.7 else rnd.choice(["a", None]), rnd.randrange(2), rnd.randrange(0, 86_400, 900), rnd.random())
        for _ in range(400)
    ]
    df = measured(spark, data)
    expected = []
    days = {}
    for r in sorted(df.collect(), key=lambda r: (r.analysis_datetime, r.analysis_id)):
        days.setdefault((r.process_id, r.analysis_date), []).append(r.x)
    for (key, day), xs in days.items():
        for g in range(len(xs) // size):
            part = xs[g * size : (g + 1) * size]
            expected.append((key, day, g, round(statistics.fmean(part), 9), round(max(part) - min(part), 9)))
    out = spc.subgroups(df, size, tie=["analysis_id"]).select(
        "process_id", "analysis_date", "_subgroup", F.round("xbar_i", 9), F.round("r_i", 9)
    )
    assert rows(out) == sorted(expected, key=lambda t: tuple((v is None, str(v)) for v in t))


def limits_of(spark, n_days, usl, lsl, cl):
    data = [("p", "t", "i", "A", DAY0 + dt.timedelta(days=i), 5, 0, 10.0, 2.0, 1.5, lsl, usl, cl) for i in range(n_days)]
    schema = (
        "process_id string, tank_name string, item_name string, shift string, analysis_date date, n_samples bigint, "
        "oospec_points bigint, xbar_d double, mr_bar_d double, sigma_overall_d double, lsl double, usl double, cl double"
    )
    out = spc.rolling_limits(spark.createDataFrame(data, schema), spc.SHIFT_KEYS)
    return out.orderBy(F.col("analysis_date").desc()).first()


def test_individuals_limits(spark):
    row = limits_of(spark, 25, 20.0, 0.0, 10.0)
    assert row.data_sufficient and row.limit_source == "CALCULATED"
    assert row.sigma_within == pytest.approx(1.7730496, abs=1e-6)
    assert (row.ucl_x, row.lcl_x) == (pytest.approx(15.32), pytest.approx(4.68))


def test_provisional_limits(spark):
    row = limits_of(spark, 3, 20.0, 0.0, 10.0)
    assert (row.ucl_x, row.lcl_x, row.limit_source) == (pytest.approx(19), pytest.approx(1), "SPEC_90PCT")
    row = limits_of(spark, 3, 20.0, 0.0, None)
    assert (row.ucl_x, row.lcl_x) == (pytest.approx(18), pytest.approx(0))
    row = limits_of(spark, 25, 12.0, 0.0, 10.0)
    assert (row.ucl_x, row.lcl_x, row.limit_source) == (pytest.approx(11.8), pytest.approx(4.68), "SPEC_90PCT")


def test_capability_of_chart(spark):
    data = [("p", d, 100 * i, 10.0 + (1 if i % 2 else -1)) for d in range(25) for i in range(4)]
    last = spc.individuals_chart(measured(spark, data), tie=["analysis_id"]).orderBy(F.col("analysis_date").desc()).first()
    assert last.mr_bar == pytest.approx(2.0, abs=0.01)
    assert last.cp == pytest.approx(20 / (6 * last.sigma_within))
    assert last.cpk == pytest.approx(min(20 - last.xbar, last.xbar) / (3 * last.sigma_within))
    assert last.ucl_mr == pytest.approx(3.267 * last.mr_bar)


def test_no_capability_without_a_limit(spark):
    data = [("p", 0, 100 * i, float(i % 3), 0.0, None, None) for i in range(9)]
    row = spc.individuals_chart(measured(spark, data), tie=["analysis_id"]).first()
    assert (row.cp, row.cpk, row.pp, row.ppk, row.ucl_x) == (None,) * 5


def test_xbar_r_limits(spark):
    first, second = [8, 9, 10, 11, 12], [9, 10.5, 12, 13.5, 15]
    data = [("p", 0, 10 * i, float(x)) for i, x in enumerate(first + second)]
    groups = spc.subgroups(measured(spark, data), 5, tie=["analysis_id"])
    raw = spc._subgroup_chart(groups, 5, spc.CHART_KEYS, "r", K.RANGE_FACTORS[5]).first()
    assert (raw.xbar_grand, raw.r_bar) == (11.0, 5.0)
    assert (raw.xbar_ucl, raw.xbar_lcl) == (pytest.approx(13.885), pytest.approx(8.115))
    assert (raw.r_ucl, raw.r_lcl) == (pytest.approx(10.57), 0.0)
    chart = spc.xbar_r_chart(measured(spark, data), tie=["analysis_id"]).first()
    assert chart.limit_source == "SPEC_90PCT" and chart.xbar_ucl == pytest.approx(11 + 9 * 0.9)


def test_literal_centre_never_fires_rule_two(spark):
    data = [("p", d, 10 * i, float(d)) for d in range(12) for i in range(5)]
    df = measured(spark, data)
    own = spc.xbar_r_chart(df, tie=["analysis_id"], literal_centre=True)
    assert own.agg(F.sum("r2_flag")).first()[0] == 0
    assert own.agg(F.sum("r3_flag")).first()[0] == 7


def judged(spark, data):
    schema = "process_id string, shift string, analysis_date date, overall_judgment string"
    return spark.createDataFrame([("p", "A", DAY0 + dt.timedelta(days=d), j) for d, j in data], schema)


def test_p_chart(spark):
    data = [(0, "NG" if i < 10 else "OK") for i in range(100)] + [(1, "NG" if i < 2.5 else "OK") for i in range(25)]
    first, second = spc.p_chart(judged(spark, data)).orderBy("analysis_date").collect()
    assert (first.n, first.np) == (100, 10)
    bar = (0.1 + 3 / 25) / 2
    assert first.p_bar == pytest.approx(bar)
    assert first.ucl == pytest.approx(bar + 3 * (bar * (1 - bar) / 100) ** 0.5)
    assert second.lcl == 0.0


def test_c_chart(spark):
    data = [(d, "NG") for d in range(3) for _ in range(4)] + [(0, "OK")]
    row = spc.c_chart(judged(spark, data)).first()
    assert (row.c_bar, row.ucl, row.lcl) == (4.0, 10.0, 0.0)


def test_exponential_average(spark):
    data = [("p", "t", "i", DAY0 + dt.timedelta(days=i), float(i + 1)) for i in range(3)]
    df = spark.createDataFrame(data, "process_id string, tank_name string, item_name string, analysis_date date, x double")
    out = spc.smooth_exponentially(df, spc.CHART_KEYS, "x", "analysis_date", (7,)).orderBy("analysis_date")
    assert [r.ema_7 for r in out.collect()] == [1.0, 1.25, 1.6875]


def test_grades(spark):
    data = [(v,) for v in (1.67, 1.33, 1.0, 0.67, 0.66, None)]
    graded = spark.createDataFrame(data, "v double").select(spc.capability_grade(F.col("v")).alias("g"))
    assert [r.g for r in graded.collect()] == ["A+", "A", "B", "C", "D", None]


def test_baseline_is_frozen_once_complete(spark):
    schema = "process_id string, tank_name string, item_name string, chart_type string, cl_x double, is_preliminary boolean"
    stored = spark.createDataFrame([("a", "t", "i", "I-MR", 1.0, False), ("b", "t", "i", "I-MR", 1.0, True)], schema)
    new = spark.createDataFrame([(k, "t", "i", "I-MR", 2.0, False) for k in "abc"], schema)
    assert rows(spc.freeze(stored, new), "process_id", "cl_x") == [("a", 1.0), ("b", 2.0), ("c", 2.0)]


def test_anomaly_text(spark):
    cols = "process_id string, tank_name string, item_name string, shift string, analysis_date date, xbar double, cl_x double"
    cols += ", r2_flag int, r3_flag int, r3_direction int, ooc_points int, oospec_points int, ooc_total int"
    df = spark.createDataFrame([("p", "t", "i", "A", DAY0, 5.0, 6.0, 0, 1, 1, 0, 0, 1), ("p", "t", "i", "A", DAY0, 5.0, 6.0, 0, 0, 0, 0, 0, 0)], cols)
    row = spc.anomaly_view(df).collect()
    assert len(row) == 1 and row[0].trend_up and not row[0].trend_down
    literal = spc.anomaly_view(df, by_run=False).first()
    assert literal.trend_down and not literal.trend_up


def test_threshold_gates(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 2.0)], "id int, cpk double")
    out = daily.threshold_alerts(df, [("cpk", "<", 1.0, "low"), ("cpk", "!=", 2.0, "other")], ["id"])
    assert rows(out) == [(1, "low", 0.4), (1, "other", 0.4)]


def test_judgement_limits_are_inclusive(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (None,)], "v double")
    got = df.select(daily.judgement(F.col("v"), F.lit(1.0), F.lit(2.0))).collect()
    assert [r[0] for r in got] == ["OK", "OK", "NG", "NG"]


# --- plans -----------------------------------------------------------------------------------


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_raw_rows_of_the_individuals_chart_are_exchanged_once(spark, sf, static_plans):
    """By range; what is exchanged by key afterwards is one row per day, limit set and task."""
    from queries.roles import TIE, measurements

    text = plan(spc.individuals_chart(measurements(spark, sf), tie=TIE))
    assert text.count("Exchange rangepartitioning") == 1
    below = text[text.rindex("HashAggregate", 0, text.index("MapInArrow")) :]
    assert "Exchange hashpartitioning" not in below and "SortAggregate" not in below


def test_subgroup_chart_computes_subgroups_once(spark, sf, static_plans):
    from queries.roles import QTY_TIE, quantities

    assert "ReusedExchange" in plan(spc.xbar_r_chart(quantities(spark, sf), tie=QTY_TIE))


def test_count_charts_read_only_needed_columns(spark, sf, static_plans):
    from queries.roles import records

    text = plan(spc.p_chart(records(spark, sf)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_raw_rows_of_subgroups_are_exchanged_once(spark, sf, static_plans):
    """The order is computed once and written; numbering its rows and forming subgroups exchanges no raw row again."""
    from queries.roles import QTY_TIE, quantities

    day = [*spc.CHART_KEYS, "analysis_date"]
    walk = plan(series.walked(quantities(spark, sf), day, "x", [spc.INSTANT, *QTY_TIE], ["lsl", "usl"]))
    assert walk.count("Exchange") == 1
    text = plan(series.numbered(spc.day_order(quantities(spark, sf), tie=QTY_TIE), day))
    left = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in left and "BroadcastHashJoin" in left
