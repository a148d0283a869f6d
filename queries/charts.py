"""Control charts and daily quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import daily, spc
from plumbline.operators.upsert import months_predicate

from queries.roles import (
    MEASUREMENTS_SQL,
    QTY_TIE,
    QUANTITIES_SQL,
    RECORDS_SQL,
    TIE,
    Registry,
    big,
    measurements,
    quantities,
    r6,
    records,
    rounded,
)

R = Registry()


@R.add(f"""WITH {RECORDS_SQL}
SELECT process_id AS process_name, shift, analysis_date, count(*) AS total_analyses,
       count(*) FILTER (overall_judgment = 'NG') AS unqualified_count,
       round(count(*) FILTER (overall_judgment = 'NG') * 100.0::DOUBLE / count(*), 6) AS unqualified_rate
FROM rec GROUP BY ALL""")
def nonconformance_daily(spark, sf):
    return rounded(daily.nonconformance_daily(records(spark, sf)))


@R.add(f"""WITH {RECORDS_SQL}
SELECT process_id AS process_name, shift, analysis_date, count(*) AS total_analyses,
       count(*) FILTER (value > 100 AND overall_judgment = 'OK') AS warning_count,
       round(count(*) FILTER (value > 100 AND overall_judgment = 'OK') * 100.0::DOUBLE / count(*), 6) AS warning_rate
FROM rec GROUP BY ALL""")
def warning_daily(spark, sf):
    near = (F.col("value") > 100) & (F.col("overall_judgment") == "OK")
    return rounded(daily.warning_daily(records(spark, sf), near))


@R.add(f"""WITH {MEASUREMENTS_SQL}
SELECT analysis_date, count(*) AS total_analyses,
       count(*) FILTER (x BETWEEN lsl AND usl) AS qualified_count,
       round(count(*) FILTER (x BETWEEN lsl AND usl) * 100.0::DOUBLE / count(*), 6) AS qualified_rate
FROM meas GROUP BY ALL""")
def daily_summary(spark, sf):
    m = measurements(spark, sf)
    judged = m.withColumn("overall_judgment", daily.judgement(F.col("x"), F.col("lsl"), F.col("usl")))
    return rounded(daily.daily_summary(judged))


def run_rules_sql(source, value, centre, keys, order, name):
    return f"""{name}_signs AS (
  SELECT *, CASE WHEN {value} > {centre} THEN 1 WHEN {value} < {centre} THEN -1 ELSE 0 END AS side,
         CASE WHEN {value} > lag({value}) OVER w THEN 1 WHEN {value} < lag({value}) OVER w THEN -1 ELSE 0 END AS step
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{name} AS (
  SELECT *,
    CASE WHEN count(*) OVER u >= 9 AND abs(sum(side) OVER n) = 9 THEN 1 ELSE 0 END AS r2_flag,
    CASE WHEN count(*) OVER u >= 6 AND abs(sum(step) OVER s) = 5 THEN 1 ELSE 0 END AS r3_flag,
    CASE WHEN count(*) OVER u >= 6 AND abs(sum(step) OVER s) = 5 THEN sign(sum(step) OVER s) ELSE 0 END AS r3_direction
  FROM {name}_signs
  WINDOW n AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
         s AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         u AS (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING))"""


@R.add(f"""WITH {MEASUREMENTS_SQL},
daily AS (SELECT process_id, tank_name, analysis_date, avg(x) AS xbar_d FROM meas GROUP BY ALL),
centred AS (SELECT *, avg(xbar_d) OVER (PARTITION BY process_id, tank_name) AS centre FROM daily),
{run_rules_sql("centred", "xbar_d", "centre", "process_id, tank_name", "analysis_date", "ruled")}
SELECT process_id, tank_name, analysis_date, {r6("xbar_d")}, {big("r2_flag r3_flag r3_direction")} FROM ruled""")
def run_rules(spark, sf):
    m = measurements(spark, sf).groupBy("process_id", "tank_name", "analysis_date").agg(F.avg("x").alias("xbar_d"))
    keys = ["process_id", "tank_name"]
    centred = m.withColumn("centre", F.avg("xbar_d").over(spc.W.partitionBy(*keys)))
    out = spc.run_rules(centred, "xbar_d", "centre", keys)
    return rounded(out.select(*keys, "analysis_date", "xbar_d", "r2_flag", "r3_flag", "r3_direction"))


K4 = "process_id, tank_name, item_name, shift"
CAPABILITY_SQL = f"""ranges AS (
  SELECT *, abs(x - lag(x) OVER (PARTITION BY {K4} ORDER BY analysis_date, analysis_datetime, analysis_id)) AS mr
  FROM meas),
daily AS (
  SELECT {K4}, analysis_date, lsl, usl, cl, count(*) AS n_samples,
         sum(CASE WHEN x < lsl OR x > usl THEN 1 ELSE 0 END) AS oospec_points,
         avg(x) AS xbar_d, avg(mr) AS mr_bar_d, stddev_samp(x) AS sigma_d
  FROM ranges GROUP BY ALL),
roll AS (
  SELECT *, avg(xbar_d) OVER w AS xbar, avg(mr_bar_d) OVER w AS mr_bar, avg(sigma_d) OVER w AS sigma_overall,
         count(*) OVER (PARTITION BY {K4} ORDER BY analysis_date, lsl, usl, cl ROWS UNBOUNDED PRECEDING) >= 25
           AS data_sufficient
  FROM daily
  WINDOW w AS (PARTITION BY {K4} ORDER BY analysis_date, lsl, usl, cl ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
calc AS (
  SELECT *, mr_bar / 1.128 AS sigma_within, xbar + 2.660 * mr_bar AS u, xbar - 2.660 * mr_bar AS l FROM roll),
limits AS (
  SELECT *, CASE WHEN NOT data_sufficient OR u > usl THEN cl + (usl - cl) * 0.9 ELSE u END AS ucl_x,
         CASE WHEN NOT data_sufficient OR l < lsl THEN cl - (cl - lsl) * 0.9 ELSE l END AS lcl_x,
         CASE WHEN NOT data_sufficient OR u > usl OR l < lsl THEN 'SPEC_90PCT' ELSE 'CALCULATED' END AS limit_source,
         xbar AS cl_x, 3.267 * mr_bar AS ucl_mr, mr_bar AS cl_mr, 0.0 AS lcl_mr
  FROM calc),
pointed AS (
  SELECT *, CASE WHEN xbar_d < lcl_x OR xbar_d > ucl_x THEN 1 ELSE 0 END AS ooc_points,
         CASE WHEN sigma_within > 0 THEN (usl - lsl) / (6 * sigma_within) END AS cp,
         CASE WHEN sigma_within > 0 THEN least(usl - xbar, xbar - lsl) / (3 * sigma_within) END AS cpk,
         CASE WHEN sigma_overall > 0 THEN (usl - lsl) / (6 * sigma_overall) END AS pp,
         CASE WHEN sigma_overall > 0 THEN least(usl - xbar, xbar - lsl) / (3 * sigma_overall) END AS ppk,
         (n_samples - oospec_points) * 100.0::DOUBLE / n_samples AS within_spec_rate
  FROM limits),
{run_rules_sql("pointed", "xbar_d", "cl_x", K4, "analysis_date, lsl, usl, cl", "ruled")},
capability AS (SELECT *, ooc_points + r2_flag + r3_flag AS ooc_total FROM ruled)"""
CAPABILITY_COLUMNS = f"""{K4}, analysis_date,
  {big("n_samples ooc_points oospec_points r2_flag r3_flag r3_direction ooc_total")},
  {r6("xbar mr_bar sigma_within ucl_x cl_x lcl_x ucl_mr cl_mr lcl_mr lsl usl cl cp cpk pp ppk within_spec_rate")},
  data_sufficient, limit_source"""


@R.add(f"WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL} SELECT {CAPABILITY_COLUMNS} FROM capability")
def spc_capability(spark, sf):
    return rounded(spc.individuals_chart(measurements(spark, sf), tie=TIE))


@R.add(f"""WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL}
SELECT process_id, limit_source, data_sufficient, count(*) AS chart_rows,
       round(min(ucl_x), 6) AS min_ucl, round(max(lcl_x), 6) AS max_lcl
FROM capability GROUP BY process_id, limit_source, data_sufficient""")
def spc_limits_source(spark, sf):
    m = measurements(spark, sf)
    chart = spc.rolling_limits(spc.daily_statistics(m, spc.SHIFT_KEYS, tie=TIE), spc.SHIFT_KEYS)
    return rounded(
        chart.groupBy("process_id", "limit_source", "data_sufficient").agg(
            F.count("*").alias("chart_rows"), F.min("ucl_x").alias("min_ucl"), F.max("lcl_x").alias("max_lcl")
        )
    )


K3 = "process_id, tank_name, item_name"


@R.add(f"""WITH {MEASUREMENTS_SQL},
ranges AS (
  SELECT *, abs(x - lag(x) OVER (PARTITION BY {K3} ORDER BY analysis_date, analysis_datetime, analysis_id)) AS mr
  FROM meas),
daily AS (SELECT {K3}, analysis_date, avg(x) AS xbar_d, avg(mr) AS mr_d FROM ranges GROUP BY ALL),
early AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY {K3} ORDER BY analysis_date) <= 25),
base AS (SELECT {K3}, count(*) AS baseline_n, min(analysis_date) AS baseline_start_date,
         max(analysis_date) AS baseline_end_date, avg(xbar_d) AS x_double_bar, avg(mr_d) AS mr_bar_baseline
         FROM early GROUP BY ALL),
lim AS (SELECT *, x_double_bar AS cl_x, x_double_bar + 2.660 * mr_bar_baseline AS ucl_x,
         x_double_bar - 2.660 * mr_bar_baseline AS lcl_x, mr_bar_baseline AS cl_mr,
         3.267 * mr_bar_baseline AS ucl_mr, 0.0 AS lcl_mr FROM base)
SELECT {K3}, 'I-MR' AS chart_type, baseline_n, baseline_start_date, baseline_end_date,
       {r6("x_double_bar mr_bar_baseline cl_x ucl_x lcl_x cl_mr ucl_mr lcl_mr")}, baseline_n < 25 AS is_preliminary
FROM lim""")
def spc_baseline(spark, sf):
    return rounded(spc.frozen_baseline(measurements(spark, sf), tie=TIE))


def subgroup_sql(size, spread, expr, mean_f, low_f, high_f, sigma_f, order, tighten, baseline=None):
    columns = (
        f"xbar_grand xbar_ucl xbar_cl xbar_lcl {spread}_bar {spread}_ucl {spread}_cl {spread}_lcl lsl usl cp cpk"
    )
    limit = (
        """CASE WHEN NOT data_sufficient OR u > usl THEN xbar_cl + (usl - xbar_cl) * 0.9 ELSE u END AS xbar_ucl,
         CASE WHEN NOT data_sufficient OR l < lsl THEN xbar_cl - (xbar_cl - lsl) * 0.9 ELSE l END AS xbar_lcl,
         CASE WHEN NOT data_sufficient OR u > usl OR l < lsl THEN 'SPEC_90PCT' ELSE 'CALCULATED' END AS limit_source"""
        if tighten
        else "u AS xbar_ucl, l AS xbar_lcl"
    )
    extra = ", data_sufficient, limit_source" if tighten else ""
    return f"""numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY {K3}, analysis_date ORDER BY analysis_datetime, {order}) - 1) // {size} AS g
  FROM meas),
groups AS (
  SELECT {K3}, analysis_date, g, lsl, usl, avg(x) AS xbar_i, {expr} AS sp_i
  FROM numbered GROUP BY ALL HAVING count(*) = {size}),
days AS (
  SELECT {K3}, analysis_date, count(*) AS subgroup_count, avg(xbar_i) AS xbar_grand, avg(sp_i) AS {spread}_bar
  FROM groups GROUP BY ALL),
lims AS (
  SELECT *, xbar_grand AS xbar_cl, xbar_grand + {mean_f} * {spread}_bar AS u, xbar_grand - {mean_f} * {spread}_bar AS l,
         {high_f} * {spread}_bar AS {spread}_ucl, {spread}_bar AS {spread}_cl, {low_f} * {spread}_bar AS {spread}_lcl,
         {spread}_bar / {sigma_f} AS sig, subgroup_count * {size} >= 100 AS data_sufficient
  FROM days),
pts AS (
  SELECT g.lsl, g.usl, d.*,
         CASE WHEN xbar_i > u OR xbar_i < l THEN 1 ELSE 0 END AS xo,
         CASE WHEN sp_i > {spread}_ucl OR sp_i < {spread}_lcl THEN 1 ELSE 0 END AS so
  FROM groups g JOIN lims d USING ({K3}, analysis_date)),
chart AS (
  SELECT * EXCLUDE (xo, so), sum(xo) AS xbar_ooc_points, sum(so) AS {spread}_ooc_points FROM pts GROUP BY ALL),
tight AS (
  SELECT *, {limit},
         CASE WHEN sig > 0 THEN (usl - lsl) / (6 * sig) END AS cp,
         CASE WHEN sig > 0 THEN least(usl - xbar_grand, xbar_grand - lsl) / (3 * sig) END AS cpk,
         avg(xbar_grand){f" FILTER ({baseline})" if baseline else ""} OVER (PARTITION BY {K3}) AS centre
  FROM chart),
{run_rules_sql("tight", "xbar_grand", "centre", K3, "analysis_date, lsl, usl", "ruled")}
SELECT {K3}, analysis_date, CAST({size} AS BIGINT) AS subgroup_size, {r6(columns)},
       {big(f"subgroup_count xbar_ooc_points {spread}_ooc_points r2_flag r3_flag")},
       CAST(xbar_ooc_points + r2_flag + r3_flag AS BIGINT) AS ooc_total{extra}
FROM ruled"""


QTY_ORDER = ", ".join(QTY_TIE)


@R.add(
    f"WITH {QUANTITIES_SQL}, "
    + subgroup_sql(5, "r", "max(x) - min(x)", 0.577, 0.0, 2.114, 2.326, QTY_ORDER, True)
)
def spc_xbar_r(spark, sf):
    return rounded(spc.xbar_r_chart(quantities(spark, sf), 5, tie=QTY_TIE))


@R.add(
    f"WITH {QUANTITIES_SQL}, "
    + subgroup_sql(10, "s", "stddev_samp(x)", 0.975, 0.284, 1.716, 0.9727, QTY_ORDER, False)
)
def spc_xbar_s(spark, sf):
    return rounded(spc.xbar_s_chart(quantities(spark, sf), 10, tie=QTY_TIE))


@R.add(
    f"WITH {MEASUREMENTS_SQL}, "
    + subgroup_sql(5, "r", "max(x) - min(x)", 0.577, 0.0, 2.114, 2.326, "analysis_id", True)
)
def spc_xbar_r_daily(spark, sf):
    """Daily subgroups with little data per day, so that the provisional limits apply."""
    return rounded(spc.xbar_r_chart(measurements(spark, sf), 5, tie=TIE))


def count_chart_sql(p, baseline=None):
    """SQL of a count chart; with ``baseline``, a condition on days, the centre line is the mean over these."""
    value, centre, margin = (
        ("p", "p_bar", "3 * sqrt(p_bar * (1 - p_bar) / n)") if p else ("c", "c_bar", "3 * sqrt(c_bar)")
    )
    columns = "n, np, round(p, 6) AS p," if p else "np AS c,"
    return f"""WITH {RECORDS_SQL},
daily AS (
  SELECT process_id, shift, analysis_date, count(*) AS n, count(*) FILTER (overall_judgment = 'NG') AS np
  FROM rec GROUP BY ALL),
vals AS (SELECT *, np::DOUBLE / n AS p, np::DOUBLE AS c FROM daily),
centred AS (SELECT *, avg({value}){f" FILTER ({baseline})" if baseline else ""} OVER (PARTITION BY process_id, shift) AS {centre} FROM vals),
lims AS (SELECT *, {centre} AS cl, {centre} + {margin} AS ucl, greatest({centre} - {margin}, 0.0) AS lcl FROM centred),
pointed AS (SELECT *, CASE WHEN {value} > ucl OR {value} < lcl THEN 1 ELSE 0 END AS ooc_points FROM lims),
{run_rules_sql("pointed", value, "cl", "process_id, shift", "analysis_date", "ruled")}
SELECT process_id, shift, analysis_date, {columns} {r6(f"{centre} ucl cl lcl")},
       {big("ooc_points r2_flag r3_flag")}, CAST(ooc_points + r2_flag + r3_flag AS BIGINT) AS ooc_total
FROM ruled"""


@R.add(count_chart_sql(True))
def spc_p_chart(spark, sf):
    return rounded(spc.p_chart(records(spark, sf)))


@R.add(count_chart_sql(False))
def spc_c_chart(spark, sf):
    return rounded(spc.c_chart(records(spark, sf)))


RANGE = ("2024-01-03", "2024-01-12")
IN_RANGE = "analysis_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'"


@R.add(count_chart_sql(True, IN_RANGE))
def spc_p_chart_range(spark, sf):
    """Centre line over a stated range of days, which holds for all days."""
    return rounded(spc.p_chart(records(spark, sf), baseline=RANGE))


@R.add(count_chart_sql(False, IN_RANGE))
def spc_c_chart_range(spark, sf):
    return rounded(spc.c_chart(records(spark, sf), baseline=RANGE))


@R.add(f"""WITH RECURSIVE {MEASUREMENTS_SQL},
daily AS (SELECT {K3}, analysis_date, avg(x) AS x FROM meas GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY analysis_date) AS rn,
  avg(x) OVER (PARTITION BY {K3} ORDER BY analysis_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma_5,
  avg(x) OVER (PARTITION BY {K3} ORDER BY analysis_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sma_7,
  avg(x) OVER (PARTITION BY {K3} ORDER BY analysis_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS sma_14
  FROM daily),
ema AS (
  SELECT {K3}, rn, x AS ema_7, x AS ema_14 FROM numbered WHERE rn = 1
  UNION ALL
  SELECT {", ".join("n." + k.strip() for k in K3.split(","))}, n.rn, n.x * (2.0 / 8) + e.ema_7 * (1 - 2.0 / 8),
         n.x * (2.0::DOUBLE / 15) + e.ema_14 * (1 - 2.0::DOUBLE / 15)
  FROM ema e JOIN numbered n ON n.process_id = e.process_id AND n.tank_name = e.tank_name
    AND n.item_name = e.item_name AND n.rn = e.rn + 1)
SELECT {K3}, analysis_date, {r6("x sma_5 sma_7 sma_14 ema_7 ema_14")} FROM numbered JOIN ema USING ({K3}, rn)""")
def spc_moving_average(spark, sf):
    return rounded(spc.moving_average_trend(measurements(spark, sf)))


@R.add(f"""WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL}
SELECT {K3}, year(analysis_date) AS year, month(analysis_date) AS month, count(*) AS total_points,
       CAST(sum(oospec_points) AS BIGINT) AS r0_count, CAST(sum(ooc_points) AS BIGINT) AS r1_count,
       CAST(sum(r2_flag) AS BIGINT) AS r2_count, CAST(sum(r3_flag) AS BIGINT) AS r3_count,
       CAST(sum(ooc_total) AS BIGINT) AS total_alarm_count,
       round(sum(ooc_total) * 100.0::DOUBLE / count(*), 6) AS alarm_rate,
       round(avg(cp), 6) AS avg_cp, round(avg(cpk), 6) AS avg_cpk
FROM capability WHERE data_sufficient AND year(analysis_date) * 12 + month(analysis_date) BETWEEN 24288 AND 24289
GROUP BY ALL""")
def spc_monthly_alarm(spark, sf):
    months = spc.monthly_alarm_rate(spc.individuals_chart(measurements(spark, sf), tie=TIE))
    return rounded(months.filter(months_predicate("2023-12-31", "2024-01-30")))


@R.add(f"""WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL}
SELECT process_id, tank_name AS process_name, item_name, shift, analysis_date, round(xbar, 6) AS mean_value,
       round(sigma_within, 6) AS std_dev, {r6("cp cpk usl lsl")}, round(ucl_x, 6) AS ucl, round(lcl_x, 6) AS lcl,
       n_samples AS sample_count, CAST(ooc_total AS BIGINT) AS out_of_control_count, {big("r2_flag r3_flag")},
       data_sufficient, limit_source,
       CASE WHEN cpk IS NULL THEN NULL WHEN cpk >= 1.67 THEN 'A+' WHEN cpk >= 1.33 THEN 'A' WHEN cpk >= 1.0 THEN 'B'
            WHEN cpk >= 0.67 THEN 'C' ELSE 'D' END AS capability_level
FROM capability""")
def capability_grade(spark, sf):
    return rounded(spc.capability_view(spc.individuals_chart(measurements(spark, sf), tie=TIE)))


@R.add(f"""WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL}
SELECT process_id, tank_name AS process_name, item_name, shift, analysis_date, round(xbar, 6) AS mean_value,
       CASE WHEN r3_flag = 1 AND r3_direction > 0 THEN '连续6点递增' ELSE '' END AS trend_up,
       CASE WHEN r3_flag = 1 AND r3_direction < 0 THEN '连续6点递减' ELSE '' END AS trend_down,
       {big("r2_flag r3_flag ooc_points oospec_points ooc_total")}
FROM capability WHERE ooc_total > 0""")
def anomaly_patterns(spark, sf):
    return rounded(spc.anomaly_view(spc.individuals_chart(measurements(spark, sf), tie=TIE)))


@R.add(f"""WITH {MEASUREMENTS_SQL}, {CAPABILITY_SQL}
SELECT {K4}, analysis_date, 'low capability' AS alert, round(cpk, 6) AS observed FROM capability WHERE cpk < 0.5
UNION ALL SELECT {K4}, analysis_date, 'out of spec', CAST(oospec_points AS DOUBLE) FROM capability
  WHERE oospec_points >= 3
UNION ALL SELECT {K4}, analysis_date, 'alarm', CAST(ooc_total AS DOUBLE) FROM capability WHERE ooc_total != 0""")
def threshold_alerts(spark, sf):
    chart = spc.individuals_chart(measurements(spark, sf), tie=TIE)
    gates = [
        ("cpk", "<", 0.5, "low capability"),
        ("oospec_points", ">=", 3, "out of spec"),
        ("ooc_total", "!=", 0, "alarm"),
    ]
    return rounded(daily.threshold_alerts(chart, gates, [*spc.SHIFT_KEYS, "analysis_date"]))
