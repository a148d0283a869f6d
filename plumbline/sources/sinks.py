"""Writers. This module and ``versions`` are the only ones that change stored data.

A ``ParquetTable`` is a plain folder, changed in place; a ``VersionedTable`` is changed by one switch per write, and all
functions here take either. Every write goes through Spark's file committer, so a lost executor only repeats its tasks. A frame
that is derived from the folder it replaces is first written to a staging folder in the shared
directory, because Spark cannot overwrite what it still has to read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.scale import keyset_join, materialise, null_safe_join
from plumbline.sources.versions import VersionedTable, partition_folder, publish_pair


@dataclass(frozen=True)
class ParquetTable:
    """A Parquet folder partitioned by the given columns.

    With ``schema`` the table reads with these types; without it Spark infers the types of the partition columns.
    """

    path: str
    by: tuple[str, ...] = ()
    schema: T.StructType | None = None

    def exists(self, spark: SparkSession) -> bool:
        return _fs(spark, self.path).exists(_path(spark, self.path))

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read if self.schema is None else spark.read.schema(self.schema)
        return reader.parquet(self.path)

    def typed(self, schema: T.StructType) -> ParquetTable:
        """The same table, read with the columns and types of ``schema``."""
        return replace(self, schema=T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


Table = ParquetTable | VersionedTable


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _writer(df: DataFrame, table: ParquetTable, mode: str, overwrite: str):
    writer = df.write.mode(mode).option("partitionOverwriteMode", overwrite)
    return writer.partitionBy(*table.by) if table.by else writer


def cluster_for_write(df: DataFrame, table: Table) -> DataFrame:
    """Shuffle rows to their partition folder, so that a folder gets few files.

    Spark rebalances by size: small folders share a task and an oversized folder is split.
    """
    return df.hint("rebalance", *[F.col(c) for c in table.by]) if table.by else df


def write_create(df: DataFrame, table: Table) -> None:
    """Create the table; an existing one is an error."""
    if isinstance(table, VersionedTable):
        return table.create(df)
    _writer(df, table, "errorifexists", "static").parquet(table.path)


def write_append(df: DataFrame, table: Table) -> None:
    if isinstance(table, VersionedTable):
        return table.append(df)
    _writer(df, table, "append", "static").parquet(table.path)


def write_replace(df: DataFrame, table: Table) -> None:
    """Replace the whole table."""
    if isinstance(table, VersionedTable):
        return table.replace_all(df)
    _writer(df, table, "overwrite", "static").parquet(table.path)


def write_partitions(df: DataFrame, table: Table) -> None:
    """Replace exactly the partitions that occur in the frame and leave all others alone."""
    if isinstance(table, VersionedTable):
        return table.replace_partitions(df)
    _writer(df, table, "overwrite", "dynamic").parquet(table.path)


def create_if_absent(df: DataFrame, table: Table) -> bool:
    spark = df.sparkSession
    if table.exists(spark):
        return False
    write_create(df, table)
    return True


def rewrite(table: Table, change: Callable[[DataFrame], DataFrame], spark: SparkSession) -> None:
    """Replace the table by a frame derived from it."""
    if isinstance(table, VersionedTable):
        return table.rewrite(change, spark)
    write_replace(materialise(change(table.read(spark))), table)


def replace_range(df: DataFrame, table: Table, column: str, start: str, end: str) -> None:
    """Replace the rows with ``column`` in [start, end] by the frame's rows in that range.

    Only partitions that hold such rows, before or after, are rewritten. A partition that would end
    up empty is removed.
    """
    if isinstance(table, VersionedTable):
        return table.replace_range(df, column, start, end)
    spark = df.sparkSession
    within = F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    fresh = df.filter(within)
    if not table.exists(spark):
        write_create(fresh, table)
        return
    table = table.typed(df.schema)
    old = table.read(spark).select(*df.columns)
    if not table.by:
        write_replace(materialise(old.filter(~F.coalesce(within, F.lit(False))).unionByName(fresh)), table)
        return
    by = list(table.by)
    touched = materialise(old.filter(within).select(*by).unionByName(fresh.select(*by)).distinct(), "keys")
    kept = keyset_join(old.filter(~F.coalesce(within, F.lit(False))), touched, by, "left_semi")
    result = materialise(kept.unionByName(fresh).select(*df.columns))
    write_partitions(cluster_for_write(result, table), table)
    drop_partitions(keyset_join(touched, result, by, "left_anti"), table)


def drop_partitions(keys: DataFrame, table: ParquetTable) -> None:
    """Remove partition folders. The list of folders is metadata and is walked one at a time."""
    spark = keys.sparkSession
    fs = _fs(spark, table.path)
    parent = _path(spark, table.path)
    for row in keys.select(*table.by).distinct().toLocalIterator():
        # a child given as text is parsed as a URI, in which "%" stands for itself only through this constructor
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(parent, partition_folder(row, table.by)), True)


def _image(table: Table, touched: DataFrame | None, spark: SparkSession) -> DataFrame | None:
    """A written copy of the touched partitions, or of the whole table; None for a table that isn't there."""
    if not table.exists(spark):
        return None
    stored = table.read(spark)
    return materialise(keyset_join(stored, touched, list(table.by), "left_semi") if table.by else stored, "pre-image")


def _restore(table: Table, before: DataFrame | None, touched: DataFrame | None, spark: SparkSession) -> None:
    if before is None:
        _fs(spark, table.path).delete(_path(spark, table.path), True)
    elif not table.by:
        write_replace(before, table)
    else:
        write_partitions(before, table)
        drop_partitions(keyset_join(touched, before, list(table.by), "left_anti"), table)


def intents_of(table: VersionedTable) -> str:
    return f"{table.path}/_intents"


def dual_write(
    df: DataFrame,
    first: Table,
    second: Table,
    write_second: Callable[[DataFrame, ParquetTable], None] | None = None,
    touched: tuple[DataFrame, DataFrame] | None = None,
    second_df: DataFrame | None = None,
    intents: str | None = None,
) -> None:
    """Write the same rows to two tables. If either write fails, both tables are put back.

    Two versioned tables are changed by a switch each, after an intent was written to the folder ``intents`` (by default
    one of the first table's): after the loss of the whole session ``versions.recover`` completes the change. Plain folders
    are put back by this session only.

    The rows are computed once, into staging; pre-images cover the partitions that are replaced, or the whole table
    where it has none. ``touched`` names further partitions of each table that end up empty if no row falls in them.
    """
    spark = df.sparkSession
    rows = materialise(df)
    if isinstance(first, VersionedTable) and isinstance(second, VersionedTable) and write_second is None:
        other = rows if second_df is None else second_df
        emptied = touched or (None, None)
        staged = [(t, t.stage_partitions(cluster_for_write(r, t), e)) for t, r, e in zip((first, second), (rows, other), emptied, strict=True)]
        publish_pair(spark, staged, intents or intents_of(first))
        return
    pairs = [(first, rows), (second, rows if second_df is None else materialise(second_df))]
    jobs = []
    for k, (table, frame) in enumerate(pairs):
        by = list(table.by)
        keys = None
        if by:
            named = frame.select(*by)
            keys = materialise((named if touched is None else named.unionByName(touched[k].select(*by))).distinct(), "keys")
        typed = table.typed(frame.schema)
        jobs.append((typed, frame, keys, _image(typed, keys, spark)))
    done = []
    try:
        for k, job in enumerate(jobs):
            table, frame, keys, before = job
            done.append(job)
            write = write_second if k and write_second else write_partitions if table.by else write_replace
            write(cluster_for_write(frame, table), table)
            if table.by:
                drop_partitions(keyset_join(keys, frame, list(table.by), "left_anti"), table)
    except Exception:
        for table, _, keys, before in done:
            _restore(table, before, keys, spark)
        raise


def compact(table: Table, spark: SparkSession, target_bytes: int = 256 * 1024 * 1024, min_files: int = 2) -> None:
    """Rewrite the partitions that hold at least ``min_files`` files below half of ``target_bytes``.

    They are chosen from file metadata; all others stay as they are. A partition's rows are written by as many tasks as
    its bytes ask for, so no session setting changes.
    """
    df = table.read(spark)
    by = list(table.by)
    whole = table.replace_all if isinstance(table, VersionedTable) else lambda d: write_replace(d, table)
    files = df.select(*by, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_bytes"))
    each = files.groupBy(*by, "_file").agg(F.first("_bytes").alias("_bytes"))
    small = F.count_if(F.col("_bytes") < target_bytes / 2)
    shape = each.groupBy(*by).agg(F.sum("_bytes").alias("_total"), small.alias("_small"))
    pieces = F.ceil(F.col("_total") / target_bytes).cast("int")
    chosen = materialise(shape.where(F.col("_small") >= min_files).withColumn("_pieces", pieces), "chosen")
    if chosen.isEmpty():
        return
    if not by:
        whole(materialise(df).repartition(chosen.first()["_pieces"]))
        return
    rows = null_safe_join(df, chosen.select(*by, "_pieces"), by).withColumn("_piece", F.floor(F.rand(1) * F.col("_pieces")))
    staged = materialise(rows.drop("_pieces"), "compacted")
    n = chosen.agg(F.sum("_pieces")).first()[0]
    write_partitions(staged.repartition(min(n, 10_000), *by, "_piece").drop("_piece"), table)


def write_csv(df: DataFrame, path: str) -> None:
    """Result export with a header line in every file."""
    df.write.mode("overwrite").option("header", True).csv(path)
