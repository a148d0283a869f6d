"""Column profiles that are kept per partition and merged, so that only changed partitions are read again.

The profile of a partition is one row: its number of rows, and for each column the known values, the least and greatest
value in the column's own type, and a sketch of the distinct values. Counts add up, bounds are bounds of bounds, and
sketches unite; the profile of a table is that of its partitions' rows. Which partitions have changed is told by the
table's manifest, without reading any.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.versions import VersionedTable

#: Two to this many registers: a standard error of 1.6 % in distinct counts.
SKETCH_BITS = 12


def partition_profiles(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per partition. Columns of a partition are numbered, as their names may be any text."""
    aggs = []
    for i, c in enumerate([c for c in df.columns if c not in by]):
        q = F.col(f"`{c}`")
        aggs += [
            F.count(q).alias(f"known_{i}"), F.min(q).alias(f"lo_{i}"), F.max(q).alias(f"hi_{i}"),
            F.hll_sketch_agg(q.cast("string"), F.lit(SKETCH_BITS)).alias(f"sketch_{i}"),
        ]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *aggs)


def merged_profile(profiles: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``column_name, row_count, null_share, min_value, max_value, distinct_values`` from partitions' rows.

    Distinct values are estimated, those of partition columns counted.
    """
    aggs, plain = [F.sum("rows").alias("n")], [c for c in columns if c not in by]
    for i in range(len(plain)):
        aggs += [
            F.sum(f"known_{i}").alias(f"known_{i}"), F.min(f"lo_{i}").cast("string").alias(f"lo_{i}"),
            F.max(f"hi_{i}").cast("string").alias(f"hi_{i}"),
            F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{i}")).alias(f"distinct_{i}"),
        ]
    for k, c in enumerate(by, len(plain)):
        q = F.col(f"`{c}`")
        aggs += [
            F.sum(F.when(q.isNotNull(), F.col("rows")).otherwise(0)).alias(f"known_{k}"), F.min(q).cast("string").alias(f"lo_{k}"),
            F.max(q).cast("string").alias(f"hi_{k}"), F.count_distinct(q).alias(f"distinct_{k}"),
        ]
    lines = [
        F.struct(
            F.lit(c).alias("column_name"), F.coalesce("n", F.lit(0)).alias("row_count"),
            F.when(F.col("n") > 0, (F.col("n") - F.col(f"known_{i}")) / F.col("n")).alias("null_share"),
            F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value"),
            F.coalesce(f"distinct_{i}", F.lit(0)).cast("bigint").alias("distinct_values"),
        )
        for i, c in enumerate([*plain, *by])
    ]
    return profiles.agg(*aggs).select(F.inline(F.array(*lines)))


def refresh(spark: SparkSession, source: VersionedTable, store: VersionedTable) -> list[str]:
    """Bring the stored profiles of a table up to date; returns the partitions that were read.

    The store's manifest notes which writes of each partition it has seen.
    """
    now, before = source.current(spark), store.current(spark)
    seen = json.loads(before.note) if before else {}
    changed = sorted(k for k, tokens in now.entries.items() if seen.get(k) != tokens)
    gone = sorted(set(seen) - set(now.entries))
    if changed or gone or before is None:
        made = partition_profiles(source.read(spark, folders=changed), source.by)
        store.publish(spark, store.stage(made, ended=[*changed, *gone]), json.dumps(now.entries))
    return changed


def profile(spark: SparkSession, source: VersionedTable, store: VersionedTable) -> DataFrame:
    """The profile of a table after its changed partitions were read."""
    refresh(spark, source, store)
    return merged_profile(store.read(spark), source.read(spark).columns, source.by)
