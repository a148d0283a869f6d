"""Star schema: dimension lookups, generated dimensions and joins inferred from column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.scale import lookup_join


@dataclass(frozen=True)
class Lookup:
    """How a fact column finds its surrogate key in a dimension."""

    dimension: str
    fact_key: str
    dim_key: str
    surrogate: str
    output: str
    current_only: bool = True


def resolve_keys(fact: DataFrame, dims: Mapping[str, DataFrame | None], lookups: Sequence[Lookup]) -> DataFrame:
    """Add one surrogate key per lookup. A missing dimension or member gives a null key."""
    for look in lookups:
        dim = dims.get(look.dimension)
        if dim is None:
            fact = fact.withColumn(look.output, F.lit(None).cast("int"))
            continue
        if look.current_only and "is_current" in dim.columns:
            dim = dim.filter("is_current")
        members = dim.select(F.col(look.dim_key).alias(look.fact_key), F.col(look.surrogate).alias(look.output))
        fact = lookup_join(fact, members, [look.fact_key])
    return fact


def lookup_misses(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits and misses of every lookup, counted in one pass."""
    counts = fact.agg(F.count("*").alias("_n"), *[F.count(k).alias(k) for k in keys])
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("hits")) for k in keys])
    return counts.select("_n", F.explode(rows).alias("r")).select(
        "r.dimension", "r.hits", (F.col("_n") - F.col("r.hits")).alias("misses")
    )


def date_dimension(span: DataFrame) -> DataFrame:
    """One row per day between ``lo`` and ``hi`` of a one-row frame."""
    days = span.select(F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.weekofyear(d).alias("iso_week"),
        (F.weekday(d) + 1).alias("iso_weekday"),
        (F.weekday(d) >= 5).alias("is_weekend"),
    )


def date_span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def time_dimension(spark: SparkSession, shift_starts: Sequence[tuple[int, str]], step_minutes: int = 1) -> DataFrame:
    """One row per ``step_minutes`` of a day. ``shift_starts`` lists (hour, shift), earliest first."""
    minutes = spark.range(0, 24 * 60, step_minutes).select(F.col("id").cast("int").alias("minute_of_day"))
    hour, minute = F.floor(F.col("minute_of_day") / 60), F.col("minute_of_day") % 60
    shift = F.lit(shift_starts[-1][1])
    for start, name in shift_starts:
        shift = F.when(hour >= start, name).otherwise(shift)
    return minutes.select(
        (hour * 100 + minute).cast("int").alias("time_key"),
        F.format_string("%02d:%02d", hour, minute).alias("full_time"),
        hour.cast("int").alias("hour"),
        minute.cast("int").alias("minute"),
        shift.alias("shift"),
    )


@dataclass(frozen=True)
class InferredJoin:
    fact: str
    dim: str
    fact_field: str
    dim_field: str


def column_roles(schema: T.StructType, is_fact: bool) -> list[tuple[str, str]]:
    """(column, role) with role PK, FK, num, str, date or bool, from names and types."""
    roles = []
    for field in schema.fields:
        name, kind = field.name.lower(), field.dataType
        if not is_fact and (name.endswith("_sk") or name in ("date_key", "time_key")):
            role = "PK"
        elif is_fact and name.endswith("_key"):
            role = "FK"
        elif isinstance(kind, T.NumericType):
            role = "num"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = "date"
        elif isinstance(kind, T.BooleanType):
            role = "bool"
        else:
            role = "str"
        roles.append((field.name, role))
    return roles


def infer_joins(facts: Mapping[str, DataFrame], dims: Mapping[str, DataFrame]) -> list[InferredJoin]:
    """Match each fact column ``<root>_key`` with a dimension's ``<root>_sk`` or ``<root>_key``."""
    primary = {
        column.lower(): (dim, column)
        for dim in sorted(dims, reverse=True)
        for column, role in column_roles(dims[dim].schema, False)
        if role == "PK"
    }
    found = []
    for fact in sorted(facts):
        for column, role in column_roles(facts[fact].schema, True):
            root = column.lower().removesuffix("_key")
            hit = primary.get(f"{root}_sk") or primary.get(f"{root}_key")
            if role == "FK" and hit:
                found.append(InferredJoin(fact, hit[0], column, hit[1]))
    return found


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame], joins: Sequence[InferredJoin]) -> DataFrame:
    """Left-join a fact to its dimensions; dimension columns are prefixed with the dimension's name."""
    for join in joins:
        dim = dims[join.dim]
        renamed = dim.select(
            F.col(join.dim_field).alias(join.fact_field),
            *[F.col(c).alias(f"{join.dim}_{c}") for c in dim.columns if c != join.dim_field],
        )
        fact = lookup_join(fact, renamed, [join.fact_field])
    return fact
