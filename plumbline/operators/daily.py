"""Daily quality figures over analysis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.spc import DAY, judged_daily

GROUP = ("process_id", "shift")


def _rates(df: DataFrame, flagged: Column, name: str) -> DataFrame:
    return judged_daily(df, GROUP, flagged).select(
        F.col("process_id").alias("process_name"),
        "shift",
        DAY,
        F.col("n").alias("total_analyses"),
        F.col("np").alias(f"{name}_count"),
        (F.col("np") / F.col("n") * 100.0).alias(f"{name}_rate"),
    )


def nonconformance_daily(records: DataFrame) -> DataFrame:
    return _rates(records, F.col("overall_judgment") == "NG", "unqualified")


def warning_daily(records: DataFrame, warning: Column | None = None) -> DataFrame:
    """Share of records that meet the warning predicate; none do unless one is given."""
    return _rates(records, F.lit(False) if warning is None else warning, "warning")


def judgement(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.between(low, high), "OK").otherwise("NG")


def daily_summary(records: DataFrame) -> DataFrame:
    qualified = F.count_if(F.col("overall_judgment") == "OK")
    return records.groupBy(DAY).agg(
        F.count("*").alias("total_analyses"),
        qualified.alias("qualified_count"),
        (qualified / F.count("*") * 100.0).alias("qualified_rate"),
    )


def threshold_alerts(df: DataFrame, gates: list[tuple[str, str, object, str]], keep: list[str]) -> DataFrame:
    """One row per gate that a row meets: ``(column, operator, bound, label)``."""
    compare = {
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "=": lambda a, b: a == b,
        "==": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
    }
    hits = [
        F.when(
            compare[op](F.col(column), F.lit(bound)),
            F.struct(F.lit(label).alias("alert"), F.col(column).cast("double").alias("observed")),
        )
        for column, op, bound, label in gates
    ]
    return df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select(
        *keep, "_hit.alert", "_hit.observed"
    )
