"""Keys for rows that are taken apart and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship_package


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so, in whatever case."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def row_key(*columns: str) -> Column:
    """A text that two rows share only if they agree in all ``columns``, nulls included.

    It is made from the content, so a recomputed partition gives the same keys. Equal rows share a key on purpose:
    whatever is found for one holds for the other.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def prepare(spark: SparkSession, batch_mb: int = 16) -> None:
    """What the operators' Python tasks rely on: the package itself, and Arrow batches that end at so many MB.

    Long texts then fit in a worker, whatever the number of rows in a batch.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
