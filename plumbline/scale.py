"""Helpers that keep a plan safe when one key holds a large share of the rows."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can reach, below ``spark.checkpoint.dir``.

    The cluster names that folder. Only a local session, where driver and executors share a disk,
    may fall back to a temporary one. All of them lie in one folder of the application, which is
    removed when the application ends, so staged copies don't pile up.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_base()
    own = f"{base.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"
    _remove_at_end(spark, own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


_OWNED: set[str] = set()


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    if folder not in _OWNED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWNED.add(folder)


def materialise(df: DataFrame, purpose: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """The same rows, read back from a Parquet folder in the shared directory.

    Cuts the lineage, so a lost executor never recomputes earlier rounds, and computes the frame
    once. Unlike a checkpoint it gives the optimizer the true size of the rows.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], Any], at_once: int = 5) -> list[Any]:
    """Run independent jobs of one driver side by side, so that small ones share the cluster; the first error is raised."""
    with ThreadPoolExecutor(min(at_once, max(len(jobs), 1))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def observed(seen: Observation) -> dict[str, Any]:
    """What an observation saw; empty if Spark found the frame to be empty and left it out of the plan."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return {}


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a large frame to a lookup frame with unique keys, whatever the size of the lookup.

    Spark broadcasts a lookup that proves small. A larger one is shuffled with the fact, and adaptive
    execution splits the partitions of a hot key; only the columns that are asked for are read.
    """
    return fact.join(dim, list(on), how)


def split_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of ``left`` can be split although ``right`` is an aggregate by the same key.

    Adaptive execution splits a join's partitions only if both sides were shuffled for that join. An aggregate would be
    joined as it lies; with its key wrapped in a struct its few rows are shuffled once more, and the hot key is spread.
    """
    on = [on] if isinstance(on, str) else on
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    mine, other = F.struct(*[F.col(c).alias(c) for c in on]), F.struct(*[F.col(f"_on_{c}").alias(c) for c in on])
    return left.join(renamed, mine == other, how).drop(*[f"_on_{c}" for c in on])


def keyset_join(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join of a large frame with a set of keys, such as touched partitions.

    The distinct keys are written first, so that their true size decides between a broadcast and a
    shuffle. The large side is only shuffled when the key set is large too. Null keys match each other.
    """
    written = materialise(keys.select(*on).distinct(), "keys")
    return null_safe_join(df, written, on, how).select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, as they do in a grouping."""
    renamed = right.select(
        *[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    joined = left.join(renamed, same, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({c: F.coalesce(c, f"_on_{c}") for c in on})
    return joined.drop(*[f"_on_{c}" for c in on])
