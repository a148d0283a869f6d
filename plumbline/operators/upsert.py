"""Row-level changes as DataFrame to DataFrame functions; storage is left to ``sources.sinks``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.scale import keyset_join, null_safe_join


def newest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest version.

    The remaining columns break ties, so the result does not depend on the order of the input.
    Spark keeps only the best row per key and task before the shuffle, so many copies of one key
    do not gather in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in version]
    order = [F.col(c).desc_nulls_last() for c in [*version, *rest]]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def live(df: DataFrame, deleted: str = "__deleted", keep_deleted: bool = False) -> DataFrame:
    """Drop rows whose newest image is a delete."""
    return df if keep_deleted else df.filter(F.coalesce(F.col(deleted), F.lit("false")) != "true")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    version: Sequence[str] = (),
    frozen: Sequence[str] = ("created_at",),
) -> DataFrame:
    """Insert new keys and overwrite known ones, except the ``frozen`` columns of known keys.

    A null in a key is a value like any other, so a repeated run finds its rows again.
    """
    keys = list(keys)
    fresh = newest(incoming, keys, version)
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = fresh.select(*keys, F.struct(*values).alias("_new"))
    both = null_safe_join(old, new, keys, "full_outer")
    picked = []
    for c in values:
        if c in frozen:
            choice = F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        else:
            choice = F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        picked.append(choice.alias(c))
    return both.select(*keys, *picked).select(*existing.columns)


def coalescing_upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """Upsert in which a null or empty incoming text keeps the stored value."""
    keys = list(keys)
    text = {name for name, kind in existing.dtypes if kind == "string"}
    fresh = newest(incoming, keys, version)
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values])
    new = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    both = null_safe_join(old, new, keys, "full_outer")
    picked = []
    for c in values:
        offered = F.nullif(F.col(f"_new_{c}"), F.lit("")) if c in text else F.col(f"_new_{c}")
        picked.append(F.coalesce(offered, F.col(f"_old_{c}")).alias(c))
    return both.select(*keys, *picked).select(*existing.columns)


def replace_where(existing: DataFrame, incoming: DataFrame, predicate: str) -> DataFrame:
    """Drop the stored rows that meet the predicate and add the incoming rows that meet it."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    return existing.filter(~hit).unionByName(incoming.filter(hit))


def replace_dates(existing: DataFrame, incoming: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Idempotent replacement of a date range."""
    return replace_where(existing, incoming, f"{column} BETWEEN DATE '{start}' AND DATE '{end}'")


def months_predicate(start: str, end: str, year: str = "year", month: str = "month") -> str:
    """Predicate on a (year, month) pair for all months touched by [start, end]."""
    first, last = (int(d[:4]) * 12 + int(d[5:7]) for d in (start, end))
    return f"{year} * 12 + {month} BETWEEN {first} AND {last}"


def replace_days_present(existing: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    """Replace exactly the days that occur in the incoming frame."""
    return keyset_join(existing, incoming, [column], "left_anti").unionByName(incoming)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows with unknown keys only; stored rows always win."""
    keys = list(keys)
    added = null_safe_join(newest(incoming, keys, ()), existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(added.select(*existing.columns))


def explode_metrics(reports: DataFrame, keys: Sequence[str], metrics: str, ts: str) -> DataFrame:
    """One row per entry of a name-to-number map."""
    return reports.select(*keys, F.col(ts).alias("ts"), F.explode(metrics).alias("metric", "value"))
