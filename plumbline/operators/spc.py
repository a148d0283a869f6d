"""Statistical process control charts.

The input of the measurement charts is one row per measured value::

    process_id, tank_name, item_name, shift, analysis_date, analysis_datetime, x, lsl, usl, cl

plus columns that make the order of equal instants total (``tie``). One key, or one instant, may hold a
large share of all rows, so the ordered work on raw rows runs on ranges of the whole order
(``operators.series``). What a task finds of a key and day is one row, and these are joined up.

``day_pieces`` are statistics of a key and day that can be stored and continued: a later run needs the
pieces of earlier days, never their rows. Everything after them works on one row per key and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.operators.series import numbered, task_of, walked
from plumbline.scale import keyset_join, materialise, null_safe_join

CHART_KEYS = ("process_id", "tank_name", "item_name")
SHIFT_KEYS = (*CHART_KEYS, "shift")
COUNT_KEYS = ("process_id", "shift")
LIMITS = ("lsl", "usl", "cl")
DAY = "analysis_date"
INSTANT = "analysis_datetime"
CHUNK = 4096


def run_rules(
    df: DataFrame, value: str, centre: str, keys: Sequence[str], order: Sequence[str] = (DAY,)
) -> DataFrame:
    """Add ``r2_flag`` (nine points on one side of the centre line), ``r3_flag`` (six points
    strictly rising or falling) and ``r3_direction`` (1 rising, -1 falling, 0 none).

    Input is a chart: one row per point, so a key has at most one row per day and limit set.
    """
    points = W.partitionBy(*keys).orderBy(*order)
    signs = df.withColumns(
        {
            "_side": F.expr(f"signum({value} - {centre})"),
            "_step": F.signum(F.col(value) - F.lag(value).over(points)),
        }
    )
    sums = signs.withColumns(
        {
            "_sides": F.sum("_side").over(points.rowsBetween(-8, 0)),
            "_steps": F.sum("_step").over(points.rowsBetween(-4, 0)),
        }
    )
    return sums.withColumns(
        {
            "r2_flag": F.expr("if(abs(_sides) = 9, 1, 0)"),
            "r3_flag": F.expr("if(abs(_steps) = 5, 1, 0)"),
            "r3_direction": F.expr("if(abs(_steps) = 5, int(signum(_steps)), 0)"),
        }
    ).drop("_side", "_step", "_sides", "_steps")


def with_alarm_total(df: DataFrame, *flags: str) -> DataFrame:
    return df.withColumn("ooc_total", F.expr(" + ".join(flags)))


def outside(value: str, low: str, high: str) -> Column:
    """1 when the value is beyond a limit, else 0; a missing limit never alarms."""
    return F.expr(f"if({value} < {low} OR {value} > {high}, 1, 0)")


def capability(mean: str, sigma: str) -> tuple[Column, Column]:
    """Potential and actual capability; null without both limits or without spread."""
    potential = f"(usl - lsl) / (6 * {sigma})"
    # ``least`` skips nulls, so both limits are required explicitly.
    actual = f"least(usl - {mean}, {mean} - lsl) / (3 * {sigma})"
    usable = f"usl IS NOT NULL AND lsl IS NOT NULL AND {sigma} > 0"
    return F.expr(f"CASE WHEN {usable} THEN {potential} END"), F.expr(f"CASE WHEN {usable} THEN {actual} END")


def tightened(calculated: str, spec: str, centre: str, beyond: str, bare: float | None = None) -> Column:
    """Calculated limit, or 90 % of the way to the specification while history is short or when the
    calculated limit lies ``beyond`` the specification."""
    near = f"{centre} + ({spec} - {centre}) * {K.TIGHTEN}D"
    provisional = near if bare is None else f"coalesce({near}, {spec} * {bare}D)"
    return F.expr(f"CASE WHEN NOT data_sufficient OR {beyond} THEN {provisional} ELSE {calculated} END")


def source_of_limits(*beyond: str) -> Column:
    tests = " OR ".join(["NOT data_sufficient", *beyond])
    return F.expr(f"CASE WHEN {tests} THEN 'SPEC_90PCT' ELSE 'CALCULATED' END")


def day_pieces(
    df: DataFrame, keys: Sequence[str], limits: Sequence[str] = LIMITS, tie: Sequence[str] = ()
) -> DataFrame:
    """Per key, day and limit set what the charts need of it, from its own rows alone.

    ``n``, ``oospec``, and of the known values ``nx``, ``mean`` and ``m2``; ``ranges`` and ``nr``, sum and number of the
    moving ranges inside the day; ``place``, which orders the limit sets of a day by their first rows; ``opens``, set on
    the one that holds the day's first row, with that row's value ``open``; and the day's last value ``close``.
    """
    day = [*keys, DAY]
    out_of_spec = outside("x", "lsl", "usl") if limits else F.lit(0)
    rows = walked(df, day, "x", [INSTANT, *tie], list(limits))
    pieces = rows.groupBy(task_of().alias("_task"), *day, *limits).agg(
        F.count("*").alias("n"),
        F.count("x").alias("nx"),
        F.avg("x").alias("mean"),
        F.expr("var_pop(x) * count(x)").alias("m2"),
        F.sum(out_of_spec).alias("oospec"),
        F.sum("_apart").alias("ranges"),
        F.count("_apart").alias("nr"),
        F.min("_i").alias("place"),
        F.max("_i").alias("_last"),
        F.min_by("x", "_i").alias("open"),
        F.max_by("x", "_i").alias("close"),
    )
    # From here on: at most one row per key, day, limit set and task, and the rows of a key are together, as the charts want them.
    whole = W.partitionBy(*day)
    part = W.partitionBy(*day, "_task")
    group = W.partitionBy(*day, *limits)
    series = whole.orderBy("_task", "place")
    joined = (
        pieces.repartition(*keys)
        .withColumn("close", F.max_by("close", "_last").over(part))
        .withColumn("_heads", F.col("place") == F.min("place").over(part))
        .withColumn("_prior", F.lag("close").over(series))
        .withColumn("opens", F.col("place") == F.min("place").over(whole))
        .withColumn("_seam", F.expr("CASE WHEN _heads AND NOT opens THEN abs(open - _prior) END"))
        .withColumn("_mean", F.sum(F.expr("mean * nx")).over(group) / F.sum("nx").over(group))
        .withColumn("close", F.max_by("close", "_last").over(whole))
    )
    return joined.groupBy(*day, *limits).agg(
        F.sum("n").alias("n"),
        F.sum("nx").alias("nx"),
        F.max("_mean").alias("mean"),
        F.expr("sum(coalesce(m2 + nx * pow(mean - _mean, 2), 0D))").alias("m2"),
        F.sum("oospec").alias("oospec"),
        F.expr("sum(coalesce(ranges, 0D) + coalesce(_seam, 0D))").alias("ranges"),
        F.expr("sum(nr + if(_seam IS NULL, 0, 1))").alias("nr"),
        F.min("place").alias("place"),
        F.max("opens").alias("opens"),
        F.max_by(F.when(F.col("opens"), F.col("open")), F.when(F.col("opens"), F.lit(1))).alias("open"),
        F.first("close").alias("close"),
    )


def statistics_of_days(pieces: DataFrame, keys: Sequence[str], limits: Sequence[str] = LIMITS) -> DataFrame:
    """Per key, day and limit set: count, out-of-spec count, mean, mean moving range, deviation.

    The moving range goes on from day to day: a day's first range is the distance from the last value of the day before
    among the pieces, whenever those were computed.
    """
    series = W.partitionBy(*keys).orderBy(DAY, "place", *limits)
    seam = F.expr("CASE WHEN opens THEN abs(open - _prior) END")
    joined = pieces.withColumn("_prior", F.lag("close").over(series)).withColumn("_seam", seam)
    return joined.select(
        *keys,
        DAY,
        *limits,
        F.col("n").alias("n_samples"),
        F.col("oospec").alias("oospec_points"),
        F.col("mean").alias("xbar_d"),
        F.expr("try_divide(ranges + coalesce(_seam, 0D), nr + if(_seam IS NULL, 0, 1))").alias("mr_bar_d"),
        F.expr("CASE WHEN nx > 1 THEN sqrt(m2 / (nx - 1)) END").alias("sigma_overall_d"),
    )


def daily_statistics(
    df: DataFrame, keys: Sequence[str], limits: Sequence[str] = LIMITS, tie: Sequence[str] = ()
) -> DataFrame:
    """Statistics of all days in ``df``; see ``statistics_of_days``."""
    return statistics_of_days(day_pieces(df, keys, limits, tie), keys, limits)


def individuals_chart(df: DataFrame, keys: Sequence[str] = SHIFT_KEYS, tie: Sequence[str] = ()) -> DataFrame:
    """Individuals and moving-range chart with capability, one row per key, day and limit set."""
    return chart_of_days(daily_statistics(df, keys, LIMITS, tie), keys)


def chart_of_days(daily: DataFrame, keys: Sequence[str] = SHIFT_KEYS) -> DataFrame:
    """The individuals chart of daily statistics."""
    chart = rolling_limits(daily, keys)
    cp, cpk = capability("xbar", "sigma_within")
    pp, ppk = capability("xbar", "sigma_overall")
    chart = chart.withColumns(
        {
            "cl_x": F.col("xbar"),
            "ucl_mr": F.expr(f"mr_bar * {K.D4_PAIR}D"),
            "cl_mr": F.col("mr_bar"),
            "lcl_mr": F.lit(0.0),
            "ooc_points": outside("xbar_d", "lcl_x", "ucl_x"),
            "cp": cp,
            "cpk": cpk,
            "pp": pp,
            "ppk": ppk,
            "within_spec_rate": F.expr("(n_samples - oospec_points) / n_samples * 100D"),
        }
    )
    chart = run_rules(chart, "xbar_d", "cl_x", keys, (DAY, *LIMITS))
    return with_alarm_total(chart, "ooc_points", "r2_flag", "r3_flag").select(
        *keys, DAY, "n_samples", "xbar", "mr_bar", "sigma_within", "ucl_x", "cl_x", "lcl_x",
        "ucl_mr", "cl_mr", "lcl_mr", *LIMITS, "cp", "cpk", "pp", "ppk",
        "ooc_points", "oospec_points", "within_spec_rate",
        "r2_flag", "r3_flag", "r3_direction", "ooc_total", "data_sufficient", "limit_source",
    )


def rolling_limits(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Thirty-row rolling statistics and the control limits that follow from them."""
    series = W.partitionBy(*keys).orderBy(DAY, *LIMITS)
    month = series.rowsBetween(-29, 0)
    rolling = daily.withColumns(
        {
            "xbar": F.avg("xbar_d").over(month),
            "mr_bar": F.avg("mr_bar_d").over(month),
            "sigma_overall": F.avg("sigma_overall_d").over(month),
            "data_sufficient": F.row_number().over(series) >= K.MIN_GROUPS,
        }
    )
    upper, lower = f"(xbar + mr_bar * {K.E2_PAIR}D)", f"(xbar - mr_bar * {K.E2_PAIR}D)"
    high, low = f"{upper} > usl", f"{lower} < lsl"
    return rolling.withColumns(
        {
            "sigma_within": F.expr(f"mr_bar / {K.D2_PAIR}D"),
            "ucl_x": tightened(upper, "usl", "cl", high, K.TIGHTEN_UPPER_NO_CENTRE),
            "lcl_x": tightened(lower, "lsl", "cl", low, K.TIGHTEN_LOWER_NO_CENTRE),
            "limit_source": source_of_limits(high, low),
        }
    )


def frozen_baseline(df: DataFrame, keys: Sequence[str] = CHART_KEYS, tie: Sequence[str] = ()) -> DataFrame:
    """Control limits from the earliest 25 days of each key."""
    return baseline_of_days(daily_statistics(df, keys, (), tie), keys)


def baseline_of_days(daily: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    """The baseline of daily statistics."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(DAY))
    first = daily.withColumn("_place", place).filter(F.col("_place") <= K.MIN_GROUPS)
    baseline = first.groupBy(*keys).agg(
        F.count("*").alias("baseline_n"),
        F.min(DAY).alias("baseline_start_date"),
        F.max(DAY).alias("baseline_end_date"),
        F.avg("xbar_d").alias("x_double_bar"),
        F.avg("mr_bar_d").alias("mr_bar_baseline"),
    )
    return baseline.selectExpr(
        *keys, "'I-MR' AS chart_type", "baseline_n", "baseline_start_date", "baseline_end_date", "x_double_bar",
        "mr_bar_baseline", "x_double_bar AS cl_x",
        f"x_double_bar + mr_bar_baseline * {K.E2_PAIR}D AS ucl_x",
        f"x_double_bar - mr_bar_baseline * {K.E2_PAIR}D AS lcl_x",
        "mr_bar_baseline AS cl_mr", f"mr_bar_baseline * {K.D4_PAIR}D AS ucl_mr", "0D AS lcl_mr",
        f"baseline_n < {K.MIN_GROUPS} AS is_preliminary",
    )


def freeze(stored: DataFrame, computed: DataFrame, keys: Sequence[str] = (*CHART_KEYS, "chart_type")) -> DataFrame:
    """Keep finished baselines; take the computed one for new keys and while preliminary. Null keys match each other."""
    done = stored.filter("NOT is_preliminary")
    return done.unionByName(keyset_join(computed, done, list(keys), "left_anti").select(*stored.columns))


def day_order(df: DataFrame, keys: Sequence[str] = CHART_KEYS, tie: Sequence[str] = ()) -> DataFrame:
    """The values of each key and day in order, written, for subgroups of any size."""
    return materialise(walked(df, [*keys, DAY], "x", [INSTANT, *tie], ["lsl", "usl"]), "day-order")


def subgroups(
    df: DataFrame, size: int, keys: Sequence[str] = CHART_KEYS, tie: Sequence[str] = (), ordered: DataFrame | None = None
) -> DataFrame:
    """Complete subgroups of ``size`` consecutive values of a key and day. ``ordered``: the result of ``day_order``."""
    day = [*keys, DAY]
    rows = numbered(day_order(df, keys, tie) if ordered is None else ordered, day)
    return (
        rows.withColumn("_subgroup", F.expr(f"_row div {int(size)}"))
        .groupBy(*day, "_subgroup", "lsl", "usl")
        .agg(
            F.count("*").alias("_n"),
            F.avg("x").alias("xbar_i"),
            (F.max("x") - F.min("x")).alias("r_i"),
            F.stddev_samp("x").alias("s_i"),
        )
        .filter(F.col("_n") == size)
    )


def _subgroup_chart(groups: DataFrame, size: int, keys: Sequence[str], spread: str, factors: tuple) -> DataFrame:
    """Day rows of a subgroup chart with the untightened limits."""
    mean_factor, low_factor, high_factor, sigma_factor = factors
    day = [*keys, DAY]
    point, bar = f"{spread}_i", f"{spread}_bar"
    groups = groups.withColumn("_chunk", F.expr(f"int(_subgroup div {CHUNK})"))
    limits = (
        groups.groupBy(*day)
        .agg(
            F.count("*").alias("subgroup_count"),
            F.avg("xbar_i").alias("xbar_grand"),
            F.avg(point).alias(bar),
            F.max("_chunk").alias("_chunks"),
        )
        .selectExpr(
            "*",
            f"xbar_grand + {bar} * {mean_factor}D AS xbar_ucl",
            "xbar_grand AS xbar_cl",
            f"xbar_grand - {bar} * {mean_factor}D AS xbar_lcl",
            f"{bar} * {high_factor}D AS {spread}_ucl",
            f"{bar} AS {spread}_cl",
            f"{bar} * {low_factor}D AS {spread}_lcl",
            f"{bar} / {sigma_factor}D AS _sigma",
        )
    )
    # One copy of the day's limits per chunk of subgroups, so that no task gets a whole hot day.
    copies = limits.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks")))).drop("_chunks")
    constant = [n for n in copies.columns if n not in (*day, "_chunk")]
    rows = null_safe_join(groups, copies, [*day, "_chunk"])
    final = (
        rows.groupBy(*day, "lsl", "usl")
        .agg(
            *[F.max(n).alias(n) for n in constant],
            F.sum(outside("xbar_i", "xbar_lcl", "xbar_ucl")).alias("xbar_ooc_points"),
            F.sum(outside(point, f"{spread}_lcl", f"{spread}_ucl")).alias(f"{spread}_ooc_points"),
        )
        .withColumn("subgroup_size", F.lit(size))
    )
    cp, cpk = capability("xbar_grand", "_sigma")
    return final.withColumns({"cp": cp, "cpk": cpk}).drop("_sigma")


def centred(
    df: DataFrame, value: str, keys: Sequence[str], baseline: tuple[str, str] | None = None, centres: DataFrame | None = None
) -> DataFrame:
    """Add ``_centre``, the mean of a daily value over the rows of a key.

    With ``baseline`` the mean goes over the days of that range, both ends included, and holds for all days; a key
    without a day in it has no centre. ``centres`` gives the means as a frame, by key.
    """
    if centres is not None:
        return null_safe_join(df, centres.select(*keys, "_centre"), keys, "left")
    taken = F.col(value)
    if baseline is not None:
        taken = F.when(F.col(DAY).between(*[F.lit(d).cast("date") for d in baseline]), taken)
    return df.withColumn("_centre", F.avg(taken).over(W.partitionBy(*keys)))


def ruled_days(
    df: DataFrame,
    keys: Sequence[str] = CHART_KEYS,
    literal_centre: bool = False,
    baseline: tuple[str, str] | None = None,
    centres: DataFrame | None = None,
) -> DataFrame:
    """Run rules on the day rows of a subgroup chart. The centre line is the mean of the day means over the key.

    With ``literal_centre`` each day is compared with its own mean, so rule 2 never fires.
    """
    lined = df.withColumn("_centre", F.col("xbar_cl")) if literal_centre else centred(df, "xbar_grand", keys, baseline, centres)
    ruled = run_rules(lined, "xbar_grand", "_centre", keys, (DAY, "lsl", "usl"))
    return with_alarm_total(ruled, "xbar_ooc_points", "r2_flag", "r3_flag").drop("_centre")


def days_of_xbar_r(
    df: DataFrame | None, size: int = 5, keys: Sequence[str] = CHART_KEYS, tie: Sequence[str] = (), ordered: DataFrame | None = None
) -> DataFrame:
    """Day rows of the mean and range chart, without the run rules, each from its own day alone."""
    a2, d3, d4, d2 = K.RANGE_FACTORS.get(size, K.RANGE_FACTORS[K.DEFAULT_RANGE_SIZE])
    chart = _subgroup_chart(subgroups(df, size, keys, tie, ordered), size, keys, "r", (a2, d3, d4, d2))
    chart = chart.withColumn("data_sufficient", F.col("subgroup_count") * size >= K.MIN_POINTS)
    high, low = "xbar_ucl > usl", "xbar_lcl < lsl"
    # All three read the untightened limits.
    return chart.withColumns(
        {
            "limit_source": source_of_limits(high, low),
            "xbar_ucl": tightened("xbar_ucl", "usl", "xbar_cl", high),
            "xbar_lcl": tightened("xbar_lcl", "lsl", "xbar_cl", low),
        }
    )


def days_of_xbar_s(
    df: DataFrame | None, size: int = 10, keys: Sequence[str] = CHART_KEYS, tie: Sequence[str] = (), ordered: DataFrame | None = None
) -> DataFrame:
    """Day rows of the mean and deviation chart, without the run rules."""
    a3, b3, b4, c4 = K.DEVIATION_FACTORS.get(size, K.DEVIATION_FACTORS[K.DEFAULT_DEVIATION_SIZE])
    return _subgroup_chart(subgroups(df, size, keys, tie, ordered), size, keys, "s", (a3, b3, b4, c4))


def shown_xbar_r(ruled: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    return ruled.select(
        *keys, DAY, "subgroup_size", "subgroup_count", "xbar_grand", "xbar_ucl", "xbar_cl", "xbar_lcl",
        "r_bar", "r_ucl", "r_cl", "r_lcl", "lsl", "usl", "cp", "cpk", "xbar_ooc_points", "r_ooc_points",
        "r2_flag", "r3_flag", "ooc_total", "data_sufficient", "limit_source",
    )


def shown_xbar_s(ruled: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    return ruled.select(
        *keys, DAY, "subgroup_size", "subgroup_count", "xbar_grand", "xbar_ucl", "xbar_cl", "xbar_lcl",
        "s_bar", "s_ucl", "s_cl", "s_lcl", "lsl", "usl", "cp", "cpk", "xbar_ooc_points", "s_ooc_points",
        "r2_flag", "r3_flag", "ooc_total",
    )


def xbar_r_chart(
    df: DataFrame,
    size: int = 5,
    keys: Sequence[str] = CHART_KEYS,
    tie: Sequence[str] = (),
    literal_centre: bool = False,
    ordered: DataFrame | None = None,
    baseline: tuple[str, str] | None = None,
) -> DataFrame:
    """Subgroup mean and range chart. Limits are tightened while a day has fewer than 100 points."""
    return shown_xbar_r(ruled_days(days_of_xbar_r(df, size, keys, tie, ordered), keys, literal_centre, baseline), keys)


def xbar_s_chart(
    df: DataFrame,
    size: int = 10,
    keys: Sequence[str] = CHART_KEYS,
    tie: Sequence[str] = (),
    literal_centre: bool = False,
    ordered: DataFrame | None = None,
    baseline: tuple[str, str] | None = None,
) -> DataFrame:
    """Subgroup mean and standard-deviation chart."""
    return shown_xbar_s(ruled_days(days_of_xbar_s(df, size, keys, tie, ordered), keys, literal_centre, baseline), keys)


def judged_daily(records: DataFrame, keys: Sequence[str], bad: Column | None = None) -> DataFrame:
    """Records and rejected records per key and day."""
    bad = F.col("overall_judgment") == "NG" if bad is None else bad
    return records.groupBy(*keys, DAY).agg(F.count("*").alias("n"), F.count_if(bad).alias("np"))


def days_of_counts(records: DataFrame, keys: Sequence[str] = COUNT_KEYS) -> DataFrame:
    """Day rows of both count charts: records, rejected ones, and their share."""
    return judged_daily(records, keys).withColumn("p", F.col("np") / F.col("n"))


def p_chart(records: DataFrame, keys: Sequence[str] = COUNT_KEYS, baseline: tuple[str, str] | None = None) -> DataFrame:
    """Share of rejected records per day with binomial limits for the day's own sample size.

    The centre line is the mean share over the days of ``baseline``, or over all days.
    """
    return p_chart_of_days(centred(days_of_counts(records, keys), "p", keys, baseline), keys)


def p_chart_of_days(lined: DataFrame, keys: Sequence[str] = COUNT_KEYS) -> DataFrame:
    days = lined.withColumnRenamed("_centre", "p_bar")
    return _count_chart(days, "p", "p_bar", "3 * sqrt(p_bar * (1 - p_bar) / n)", keys).select(
        *keys, DAY, "n", "np", "p", "p_bar", "ucl", "cl", "lcl", "ooc_points", "r2_flag", "r3_flag", "ooc_total"
    )


def c_chart(records: DataFrame, keys: Sequence[str] = COUNT_KEYS, baseline: tuple[str, str] | None = None) -> DataFrame:
    """Number of rejected records per day with Poisson limits; centre line as in ``p_chart``."""
    return c_chart_of_days(centred(days_of_counts(records, keys), "np", keys, baseline), keys)


def c_chart_of_days(lined: DataFrame, keys: Sequence[str] = COUNT_KEYS) -> DataFrame:
    days = lined.select(*keys, DAY, F.col("np").alias("c"), F.col("_centre").alias("c_bar"))
    return _count_chart(days, "c", "c_bar", "3 * sqrt(c_bar)", keys).select(
        *keys, DAY, "c", "c_bar", "ucl", "cl", "lcl", "ooc_points", "r2_flag", "r3_flag", "ooc_total"
    )


def _count_chart(df: DataFrame, value: str, centre: str, margin: str, keys: Sequence[str]) -> DataFrame:
    limits = df.selectExpr(
        "*", f"{centre} AS cl", f"{centre} + {margin} AS ucl", f"greatest({centre} - {margin}, 0D) AS lcl"
    ).withColumn("ooc_points", outside(value, "lcl", "ucl"))
    return with_alarm_total(run_rules(limits, value, "cl", keys), "ooc_points", "r2_flag", "r3_flag")


def smooth_exponentially(df: DataFrame, keys: Sequence[str], value: str, order: str, spans: Sequence[int]) -> DataFrame:
    """Exponential moving averages seeded with the first value, one pandas frame per key.

    Where ``df`` has the averages of a series' first rows already, the others go on from the last of these. Meant for a
    daily series; the group size is the number of days.
    """
    names = [f"ema_{s}" for s in spans]
    known = df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})

    def smooth(pdf):
        pdf = pdf.sort_values(order)
        given = int(pdf[names[0]].notna().sum())
        for span, name in zip(spans, names, strict=True):
            series = pdf[value].iloc[max(given - 1, 0) :].copy()
            if given:
                series.iloc[0] = pdf[name].iloc[given - 1]
            pdf.loc[series.index, name] = series.ewm(span=span, adjust=False).mean()
        return pdf

    return known.groupBy(*keys).applyInPandas(smooth, known.schema)


def days_of_trend(df: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    """Daily means, without days that have no known value."""
    return df.groupBy(*keys, DAY).agg(F.avg("x").alias("x")).filter(F.col("x").isNotNull())


def moving_average_trend(df: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    """Daily mean with simple (5, 7, 14 rows) and exponential (span 7, 14) moving averages."""
    return with_simple_averages(smooth_exponentially(days_of_trend(df, keys), keys, "x", DAY, (7, 14)), keys)


def with_simple_averages(smoothed: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    series = W.partitionBy(*keys).orderBy(DAY)
    simple = smoothed.withColumns({f"sma_{n}": F.avg("x").over(series.rowsBetween(1 - n, 0)) for n in (5, 7, 14)})
    return simple.select(*keys, DAY, "x", "sma_5", "sma_7", "sma_14", "ema_7", "ema_14")


def monthly_alarm_rate(chart: DataFrame, keys: Sequence[str] = CHART_KEYS) -> DataFrame:
    """Alarms per key and month over the chart rows that have enough history."""
    return (
        chart.filter("data_sufficient")
        .groupBy(*keys, F.year(DAY).alias("year"), F.month(DAY).alias("month"))
        .agg(
            F.count("*").alias("total_points"),
            F.sum("oospec_points").alias("r0_count"),
            F.sum("ooc_points").alias("r1_count"),
            F.sum("r2_flag").alias("r2_count"),
            F.sum("r3_flag").alias("r3_count"),
            F.sum("ooc_total").alias("total_alarm_count"),
            (F.sum("ooc_total") / F.count("*") * 100.0).alias("alarm_rate"),
            F.avg("cp").alias("avg_cp"),
            F.avg("cpk").alias("avg_cpk"),
        )
    )


def capability_grade(cpk: Column) -> Column:
    """Letter grade; an unknown index has no grade."""
    steps = [F.when(cpk >= bound, F.lit(grade)) for bound, grade in K.CAPABILITY_GRADES]
    return F.when(cpk.isNotNull(), F.coalesce(*steps, F.lit(K.LOWEST_GRADE)))


def capability_view(chart: DataFrame) -> DataFrame:
    """Serving view of the individuals chart with the capability grade."""
    return chart.select(
        F.col("process_id"), F.col("tank_name").alias("process_name"), "item_name", "shift", DAY,
        F.col("xbar").alias("mean_value"), F.col("sigma_within").alias("std_dev"), "cp", "cpk",
        F.col("ucl_x").alias("ucl"), F.col("lcl_x").alias("lcl"), "usl", "lsl",
        F.col("n_samples").alias("sample_count"), F.col("ooc_total").alias("out_of_control_count"),
        "r2_flag", "r3_flag", "data_sufficient", "limit_source",
        capability_grade(F.col("cpk")).alias("capability_level"),
    )


def anomaly_view(chart: DataFrame, by_run: bool = True) -> DataFrame:
    """Chart rows with any alarm. The trend text follows the run's direction; with ``by_run=False``
    it is inferred from the mean's side of the centre line."""
    rising = F.col("r3_direction") > 0 if by_run else F.col("xbar") > F.col("cl_x")
    falling = F.col("r3_direction") < 0 if by_run else F.col("xbar") < F.col("cl_x")
    trend = F.col("r3_flag") == 1
    return chart.filter("ooc_total > 0 OR r2_flag > 0 OR r3_flag > 0").select(
        F.col("process_id"), F.col("tank_name").alias("process_name"), "item_name", "shift", DAY,
        F.col("xbar").alias("mean_value"),
        F.when(trend & rising, F.lit("连续6点递增")).otherwise("").alias("trend_up"),
        F.when(trend & falling, F.lit("连续6点递减")).otherwise("").alias("trend_down"),
        "r2_flag", "r3_flag", "ooc_points", "oospec_points", "ooc_total",
    )
