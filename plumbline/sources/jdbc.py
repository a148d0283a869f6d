"""JDBC reads and writes. The driver jar and the connection come from the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    table: str
    properties: tuple[tuple[str, str], ...] = ()
    partition_column: str | None = None
    lower: str | None = None
    upper: str | None = None
    partitions: int = 1
    batch_rows: int = 1000

    def read_options(self) -> dict[str, str]:
        options = {"url": self.url, "dbtable": self.table, "fetchsize": str(self.batch_rows), **dict(self.properties)}
        if self.partition_column:
            options.update(
                partitionColumn=self.partition_column,
                lowerBound=str(self.lower),
                upperBound=str(self.upper),
                numPartitions=str(self.partitions),
            )
        return options

    def write_options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": self.table,
            "batchsize": str(self.batch_rows),
            "truncate": "true",
            **dict(self.properties),
        }


def read_jdbc(spark: SparkSession, target: JdbcTarget, missing: T.StructType | str | None = None) -> DataFrame:
    """Table scan split over ``partitions`` range reads. With ``missing``, an absent table is empty."""
    try:
        return spark.read.format("jdbc").options(**target.read_options()).load()
    except PySparkException as error:
        text = str(error).lower()
        if missing is None or not ("not exist" in text or "not found" in text):
            raise
        return spark.createDataFrame([], missing)


def write_jdbc(df: DataFrame, target: JdbcTarget, mode: str = "overwrite") -> None:
    """Full reload (``overwrite``, keeping the table's definition) or append, from the executors."""
    df.write.format("jdbc").options(**target.write_options()).mode(mode).save()
