"""Slowly changing dimensions with validity dates (type 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cleansing import row_digest
from plumbline.operators.upsert import newest
from plumbline.scale import null_safe_join

VALIDITY = ("effective_date", "expiration_date", "is_current")


def _compare(dimension: DataFrame, latest: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Current version next to the incoming one, with the outcome of the comparison.

    Both sides have one row per key, so this is one shuffle per side and cannot be skewed.
    """
    keys = list(keys)
    old = dimension.filter("is_current").select(*keys, F.struct(*dimension.columns).alias("_old"))
    new = latest.select(*keys, F.struct(*tracked).alias("_new"))
    both = null_safe_join(old, new, keys, "full_outer")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    outcome = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "missing")
        .when(same, "same")
        .otherwise("changed")
    )
    return both.withColumn("change", outcome)


def scd2_diff(
    dimension: DataFrame, latest: DataFrame, keys: Sequence[str], tracked: Sequence[str], close_missing: bool = False
) -> DataFrame:
    """Keys to insert and to expire: ``change`` is new, changed or (on request) missing."""
    kinds = ["new", "changed", *(["missing"] if close_missing else [])]
    diff = _compare(dimension, latest, keys, tracked).filter(F.col("change").isin(kinds))
    return diff.select(*keys, "change", *[F.col(f"_new.{c}").alias(c) for c in tracked])


def scd2_metrics(dimension: DataFrame, latest: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """New, changed and expired counts and the share of incoming rows that changed, in per cent."""
    changed = F.count_if(F.col("change") == "changed")
    incoming = F.count_if(F.col("change") != "missing")
    return _compare(dimension, latest, keys, tracked).agg(
        F.count_if(F.col("change") == "new").alias("new_rows"),
        changed.alias("changed_rows"),
        changed.alias("expired_rows"),
        F.round(F.try_divide(changed * 100.0, incoming), 2).alias("change_rate"),
    )


def surrogate(keys: Sequence[str], tracked: Sequence[str], day: Column) -> Column:
    """Key of one version: differs between versions of the same business key."""
    return F.sha2(
        F.to_json(F.struct(*keys, *tracked, day.cast("string").alias("_from")), {"ignoreNullFields": "false"}), 256
    )


def scd2_apply(
    dimension: DataFrame,
    latest: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    execution_date: str,
    surrogate_key: str | None = None,
    close_missing: bool = False,
) -> DataFrame:
    """The dimension after one load: changed versions are expired, new versions added.

    A second run with the same input changes nothing.
    """
    today = F.lit(execution_date).cast("date")
    diff = _compare(dimension, latest, keys, tracked)
    expired = F.col("change").isin("changed", *(["missing"] if close_missing else []))

    def field(struct: str, name: str) -> Column:
        return F.col(f"{struct}.{name}")

    old = F.struct(
        *[
            (
                F.when(expired, today).otherwise(field("_old", c))
                if c == "expiration_date"
                else F.when(expired, F.lit(False)).otherwise(field("_old", c))
                if c == "is_current"
                else field("_old", c)
            ).alias(c)
            for c in dimension.columns
        ]
    )
    fresh = {k: F.col(k) for k in keys}
    fresh.update({c: field("_new", c) for c in tracked})
    fresh.update(effective_date=today, expiration_date=F.lit(None).cast("date"), is_current=F.lit(True))
    if surrogate_key:
        fresh[surrogate_key] = surrogate(keys, [F.col(f"_new.{c}").alias(c) for c in tracked], today)
    new = F.struct(
        *[
            fresh.get(c, F.lit(None)).cast(dimension.schema[c].dataType).alias(c)
            for c in dimension.columns
        ]
    )
    versions = F.array_compact(
        F.array(
            F.when(F.col("_old").isNotNull(), old),
            F.when(F.col("change").isin("new", "changed"), new),
        )
    )
    current = diff.select(F.explode(versions).alias("_row")).select("_row.*")
    return dimension.filter("NOT is_current").unionByName(current)


def first_load(latest: DataFrame, keys: Sequence[str], tracked: Sequence[str], execution_date: str) -> DataFrame:
    """Dimension of an empty target: every row is a current version."""
    return latest.select(
        *keys,
        *tracked,
        F.lit(execution_date).cast("date").alias("effective_date"),
        F.lit(None).cast("date").alias("expiration_date"),
        F.lit(True).alias("is_current"),
    )


HASH_COLUMNS = ("_surrogate_key", "_hash", "_effective_from", "_effective_to", "_is_current")


def hashed_versions(df: DataFrame, keys: Sequence[str], tracked: Sequence[str], execution_date: str) -> DataFrame:
    """Incoming rows with row hash and version key, ready for ``scd2_hash_merge``."""
    day = F.lit(execution_date).cast("date")
    return df.withColumns(
        {
            "_surrogate_key": surrogate(keys, tracked, day),
            "_hash": row_digest(tracked),
            "_effective_from": day,
            "_effective_to": F.lit(None).cast("date"),
            "_is_current": F.lit(True),
        }
    )


def scd2_hash_merge(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], execution_date: str, version: Sequence[str] = ()
) -> DataFrame:
    """Close the current rows whose hash changed and insert the versions that are not current yet.

    Of repeated incoming keys the newest by ``version`` counts, ties broken by the other columns. Only current rows
    are joined; closed history passes by.
    """
    keys = list(keys)
    fresh = newest(incoming, keys, version)
    changed = fresh.select(*keys, F.col("_hash").alias("_new_hash"))
    flagged = null_safe_join(target.filter("_is_current"), changed, keys, "left")
    stale = F.col("_new_hash").isNotNull() & (F.col("_new_hash") != F.col("_hash"))
    now = flagged.withColumns(
        {
            "_effective_to": F.when(stale, F.lit(execution_date).cast("date")).otherwise(F.col("_effective_to")),
            "_is_current": ~stale,
        }
    ).select(*target.columns)
    known = target.filter("_is_current").select(*keys, "_hash")
    added = null_safe_join(fresh, known, [*keys, "_hash"], "left_anti").select(*target.columns)
    return target.filter(~F.coalesce("_is_current", F.lit(False))).unionByName(now).unionByName(added)


def close_members(dimension: DataFrame, gone: DataFrame, keys: Sequence[str], execution_date: str) -> DataFrame:
    """The dimension with the current versions of deleted members expired."""
    marked = null_safe_join(dimension, gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    hit = F.col("is_current") & F.coalesce("_gone", F.lit(False))
    return marked.withColumns(
        {
            "expiration_date": F.when(hit, F.lit(execution_date).cast("date")).otherwise(F.col("expiration_date")),
            "is_current": F.col("is_current") & ~hit,
        }
    ).select(*dimension.columns)
