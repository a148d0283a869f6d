"""Whole runs of the gold jobs: every table by rows, keys and sums of its measures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import backfill
from plumbline.plans import gold, goldstate, serving
from plumbline.scale import materialise, shared_dir

from queries.charts import CAPABILITY_SQL, R as CHARTS, count_chart_sql, subgroup_sql
from queries.layers import chart_rows
from queries.roles import MEASUREMENTS_SQL, RECORDS_SQL, Registry, records, table

R = Registry()

CHART = "process_id tank_name item_name analysis_date"
#: Key columns and measures of each table.
TABLES = {
    "agg_qualification_rate_daily": ("process_name shift analysis_date", "total_analyses unqualified_count unqualified_rate"),
    "agg_warning_statistics_daily": ("process_name shift analysis_date", "total_analyses warning_count"),
    "spc_capability_daily": (
        f"{CHART} shift lsl usl cl",
        "n_samples xbar mr_bar sigma_within ucl_x lcl_x cp cpk pp ppk ooc_points oospec_points r2_flag r3_flag ooc_total",
    ),
    "spc_baseline": ("process_id tank_name item_name", "baseline_n x_double_bar mr_bar_baseline ucl_x lcl_x ucl_mr"),
    "spc_trend_ma": (CHART, "x sma_5 sma_7 sma_14 ema_7 ema_14"),
    "spc_xbar_r_chart": (f"{CHART} lsl usl", "subgroup_count xbar_grand xbar_ucl xbar_lcl r_bar r_ucl cp cpk r2_flag r3_flag ooc_total"),
    "spc_xbar_s_chart": (f"{CHART} lsl usl", "subgroup_count xbar_grand xbar_ucl xbar_lcl s_bar s_ucl cp cpk r2_flag r3_flag ooc_total"),
    "spc_p_chart": ("process_id shift analysis_date", "n np p p_bar ucl cl lcl ooc_points r2_flag r3_flag ooc_total"),
    "spc_c_chart": ("process_id shift analysis_date", "c c_bar ucl cl lcl ooc_points r2_flag r3_flag ooc_total"),
    "spc_monthly_alarm_rate": (
        "process_id tank_name item_name year month",
        "total_points r0_count r1_count r2_count r3_count total_alarm_count alarm_rate avg_cp avg_cpk",
    ),
}


def sums(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, measure, rows, distinct_keys, known, total`` for the measures of every table."""
    out = None
    for name, df in tables.items():
        keys, measures = (part.split() for part in TABLES[name])
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
        totals = [F.struct(F.lit(m).alias("measure"), F.count(m).alias("known"), F.sum(F.col(m).cast("double")).alias("total")) for m in measures]
        line = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.array(*totals).alias("m"))
        line = line.select(F.lit(name).alias("table_name"), "rows", "distinct_keys", F.inline("m"))
        out = line if out is None else out.unionByName(line)
    return out.withColumn("total", F.round("total", 3) + F.lit(0.0))


def measures_of(condition: str) -> str:
    """The measurements' SQL for some of the tanks."""
    return MEASUREMENTS_SQL[:-1] + f" WHERE {condition})"


SINGLE, PRODUCT = measures_of("user_id % 3 <> 1"), measures_of("user_id % 3 = 1")


def sources(baseline: str | None = None) -> dict[str, str]:
    """SQL of each whole table, from the charts' own; no warning predicate is given, so there are none.

    ``baseline`` is a condition on the days of the centre lines.
    """
    daily = CHARTS.oracles["nonconformance_daily"]
    return {
        "agg_qualification_rate_daily": daily,
        "agg_warning_statistics_daily": f"SELECT *, 0 AS warning_count FROM ({daily})",
        "spc_capability_daily": f"WITH {SINGLE}, {CAPABILITY_SQL} SELECT * FROM capability",
        "spc_baseline": CHARTS.oracles["spc_baseline"].replace(MEASUREMENTS_SQL, SINGLE),
        "spc_trend_ma": CHARTS.oracles["spc_moving_average"],
        "spc_xbar_r_chart": f"WITH {PRODUCT}, "
        + subgroup_sql(5, "r", "max(x) - min(x)", 0.577, 0.0, 2.114, 2.326, "analysis_id", True, baseline),
        "spc_xbar_s_chart": f"WITH {PRODUCT}, "
        + subgroup_sql(10, "s", "stddev_samp(x)", 0.975, 0.284, 1.716, 0.9727, "analysis_id", False, baseline),
        "spc_p_chart": count_chart_sql(True, baseline),
        "spc_c_chart": count_chart_sql(False, baseline),
        "spc_monthly_alarm_rate": CHARTS.oracles["spc_monthly_alarm"].replace(MEASUREMENTS_SQL, SINGLE),
    }


def sums_sql(where: str, names=tuple(TABLES), baseline: str | None = None) -> str:
    lines, texts = [], sources(baseline)
    for name in names:
        keys, measures = (part.split() for part in TABLES[name])
        cut = f" WHERE {where}" if "analysis_date" in keys else ""
        key = "concat_ws('|', " + ", ".join(f"coalesce(({k})::VARCHAR, '-')" for k in keys) + ")"
        for m in measures:
            lines.append(
                f"SELECT '{name}' AS table_name, '{m}' AS measure, count(*) AS rows, count(DISTINCT {key}) AS distinct_keys, "
                f"count({m}) AS known, round(sum({m}::DOUBLE), 3) + 0.0 AS total FROM t_{name}{cut}"
            )
    made = ",\n".join(f"t_{name} AS MATERIALIZED ({texts[name]})" for name in names)
    return f"WITH {made}\n" + "\nUNION ALL ".join(lines)


DAYS = ("2024-01-10", "2024-01-20")
BETWEEN = "analysis_date BETWEEN DATE '{}' AND DATE '{}'"


@R.add(sums_sql(BETWEEN.format(*DAYS)))
def gold_run(spark, sf):
    """All gold tables of one run over eleven days of the month."""
    tables = gold.gold_run(records(spark, sf), chart_rows(spark, sf), *DAYS, tie=["analysis_id"], stage=True)
    return sums(tables)


BASELINE = ("2024-01-04", "2024-01-18")


@R.add(sums_sql("true", baseline=BETWEEN.format(*BASELINE)))
def gold_daily(spark, sf):
    """The published tables after runs on stored day rows: the middle of the month first, then its end and its beginning."""
    root = shared_dir(spark, "gold-daily")
    chart_rows(spark, sf).write.partitionBy("analysis_date").parquet(f"{root}/wide")
    records(spark, sf).write.partitionBy("analysis_date").parquet(f"{root}/records")
    read = {n: spark.read.parquet(f"{root}/{n}") for n in ("wide", "records")}
    source = goldstate.Source(*[lambda a, b, df=df: gold.within(df, a, b) for df in read.values()])
    state = goldstate.GoldState(f"{root}/state")
    for start, end in (("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-31"), ("2024-01-01", "2024-01-10")):
        made = goldstate.run_days(
            spark, state, source, start, end, ["analysis_id"], baseline=BASELINE, since="2024-01-01"
        )
        gold.publish(spark, made, f"{root}/gold", start, end)
    return sums({name: gold.published(f"{root}/gold", name).read(spark) for name in TABLES})


@R.add(sums_sql(BETWEEN.format("2024-01-15", "2024-01-15"), [n for n in TABLES if n in serving.SERVING_KEYS]))
def serving_run(spark, sf):
    """Nine serving tables after the same day has been synchronised twice."""
    tables = gold.gold_run(records(spark, sf), chart_rows(spark, sf), *DAYS, tie=["analysis_id"], stage=True)
    tables = {name: materialise(df, "gold") for name, df in tables.items()}
    served = serving.sync_all(tables, {}, "2024-01-15", F.lit("2024-02-01").cast("timestamp"))
    served = serving.sync_all(tables, served, "2024-01-15", F.lit("2024-02-02").cast("timestamp"))
    return sums({name: serving.final(df, name) for name, df in served.items()})


# --- a backfill of three months -----------------------------------------------------------------

QUARTER = "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'"
ORDERS_SQL = f"""SELECT o_orderkey AS analysis_id, o_orderpriority AS process_id, 'T' || (o_custkey % 3) AS tank_name,
  'price' AS item_name, 'A' AS shift, CAST(o_orderdate AS DATE) AS analysis_date, o_orderdate::TIMESTAMP AS analysis_datetime,
  o_totalprice / 1000 AS x, 1.0::DOUBLE AS lsl, 400.0::DOUBLE AS usl, 150.0::DOUBLE AS cl,
  CASE WHEN o_totalprice > 250000 THEN 'NG' ELSE 'OK' END AS overall_judgment FROM orders WHERE {QUARTER}"""
FIRST_MONTH = ("1995-01-01", "1995-01-31")


def of_orders(sql: str) -> str:
    """A table's SQL over the orders of the quarter instead of the events."""
    for old, cut in ((SINGLE, " AND o_custkey % 3 <> 1"), (PRODUCT, " AND o_custkey % 3 = 1"), (MEASUREMENTS_SQL, "")):
        sql = sql.replace(old, f"meas AS ({ORDERS_SQL}{cut})")
    return sql.replace(RECORDS_SQL, f"rec AS ({ORDERS_SQL})").replace("BETWEEN 24288 AND 24289", "BETWEEN 23941 AND 23943")


def priced_orders(spark, sf):
    o = table(spark, sf, "orders").where(F.to_date("o_orderdate").between(F.lit("1995-01-01"), F.lit("1995-03-31")))
    return o.select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_orderpriority").alias("process_id"),
        F.concat(F.lit("T"), F.col("o_custkey") % 3).alias("tank_name"), F.lit("price").alias("item_name"), F.lit("A").alias("shift"),
        F.to_date("o_orderdate").alias("analysis_date"), F.col("o_orderdate").cast("timestamp").alias("analysis_datetime"),
        (F.col("o_totalprice") / 1000).alias("x"), F.lit(1.0).alias("lsl"), F.lit(400.0).alias("usl"), F.lit(150.0).alias("cl"),
        F.when(F.col("o_totalprice") > 250_000, "NG").otherwise("OK").alias("overall_judgment"),
        F.when(F.col("o_custkey") % 3 == 1, "product").otherwise("process").alias("char_type"),
    )


@R.add(of_orders(sums_sql("true", baseline=BETWEEN.format(*FIRST_MONTH))))
def backfill_run(spark, sf):
    """Gold tables of three months after a backfill whose second month failed at first, and was resumed."""
    root = shared_dir(spark, "backfill")
    rows = priced_orders(spark, sf)
    cut = lambda a, b: gold.within(rows, a, b)
    state, ledger = goldstate.GoldState(f"{root}/state"), backfill.ledger_at(f"{root}/ledger")
    broken = {dt.date(1995, 2, 1)}

    def run(start, end):
        made = goldstate.run_days(
            spark, state, goldstate.Source(cut, cut), start.isoformat(), end.isoformat(), ["analysis_id"], baseline=FIRST_MONTH
        )
        if start in broken:
            broken.remove(start)
            raise RuntimeError("lost before the tables were published")
        gold.publish(spark, made, f"{root}/gold", start.isoformat(), end.isoformat())

    backfill.plan(spark, ledger, "gold", dt.date(1995, 1, 1), dt.date(1995, 3, 31))
    for _ in range(2):
        done = backfill.run_backfill(spark, ledger, "gold", run, "query", in_order=True)
    assert [(r.status, r.attempts) for r in done.orderBy("month_start").collect()] == [("done", 1), ("done", 2), ("done", 1)]
    return sums({name: gold.published(f"{root}/gold", name).read(spark) for name in TABLES})
