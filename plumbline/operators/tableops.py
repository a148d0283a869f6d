"""Schema changes, row patches with rollback, and file health."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from plumbline.errors import SpecError
from plumbline.scale import keyset_join, materialise
from plumbline.sources.versions import VersionedTable

# Fixed value: a data file below this size counts as small.
SMALL_FILE = 32 * 1024 * 1024
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
# Casts that never lose a value.
WIDENINGS = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"),
    ("int", "bigint"), ("int", "double"), ("float", "double"), ("date", "timestamp_ntz"),
}
DESTRUCTIVE = ("drop", "narrow")


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name or ""):
        raise SpecError(f"invalid identifier {name!r}")
    return name


def alter(
    df: DataFrame, op: str, column: str, new_name: str = "", data_type: str = "", approved: bool = False
) -> DataFrame:
    """The frame after one schema change; changes that lose data need approval."""
    identifier(column)
    if op in DESTRUCTIVE and not approved:
        raise SpecError(f"{op} loses data and needs approval")
    if op != "add" and column not in df.columns:
        raise SpecError(f"the table has no column named {column!r}")
    if op == "add":
        if not data_type:
            raise SpecError("a new column needs a name and a type")
        if column in df.columns:
            raise SpecError(f"column {column!r} exists")
        return df.withColumn(column, F.lit(None).cast(data_type))
    if op == "rename":
        if identifier(new_name).lower() in {c.lower() for c in df.columns if c != column}:
            raise SpecError(f"column {new_name!r} exists")
        return df.withColumnRenamed(column, new_name)
    if op == "drop":
        return df.drop(column)
    if op in ("widen", "narrow"):
        if not data_type:
            raise SpecError(f"to {op} a column, its new type has to be named")
        have, want = df.schema[column].dataType.simpleString(), DataType.fromDDL(data_type).simpleString()
        if op == "widen":
            if (have, want) not in WIDENINGS and not _wider_decimal(have, want):
                raise SpecError(f"{have} to {want} is not a widening")
            return df.withColumn(column, F.col(column).cast(data_type))
        return df.withColumn(column, F.col(column).try_cast(data_type))
    raise SpecError(f"{op!r} is no schema change")


def _wider_decimal(have: str, want: str) -> bool:
    parts = [re.fullmatch(r"decimal\((\d+),(\d+)\)", t) for t in (have, want)]
    if not all(parts):
        return False
    (p1, s1), (p2, s2) = [tuple(int(g) for g in m.groups()) for m in parts]
    return s2 >= s1 and p2 - s2 >= p1 - s1


def _hit(where: str):
    if not where or not where.strip():
        raise SpecError("a patch needs a predicate")
    return F.coalesce(F.expr(where), F.lit(False))


def patch_preview(df: DataFrame, where: str) -> DataFrame:
    return df.agg(F.count_if(_hit(where)).alias("affected_rows"))


def patch(df: DataFrame, op: str, where: str, assign: Mapping[str, str] | None = None) -> DataFrame:
    """Update or delete the rows that meet a mandatory predicate.

    All assignments read the row as it was before the patch.
    """
    hit = _hit(where)
    if op == "delete":
        return df.filter(~hit)
    if op != "update":
        raise SpecError(f"a patch updates or deletes; {op!r} does neither")
    if not assign:
        raise SpecError("an update has to assign something")
    for column in assign:
        if identifier(column) not in df.columns:
            raise SpecError(f"the table has no column named {column!r}")
    return df.select(
        *[
            F.when(hit, F.expr(assign[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in assign
            else F.col(c)
            for c in df.columns
        ]
    )


def touched_partitions(
    df: DataFrame, where: str, by: Sequence[str], op: str = "delete", assign: Mapping[str, str] | None = None
) -> DataFrame:
    """Partitions that a patch will rewrite: those that its rows leave, and those that they move to."""
    hit = df.filter(_hit(where))
    keys = hit.select(*by)
    if op == "update" and assign and set(assign) & set(by):
        keys = keys.unionByName(patch(hit, op, where, assign).select(*by))
    return keys.distinct()


def pre_image(
    df: DataFrame, where: str, by: Sequence[str], op: str = "delete", assign: Mapping[str, str] | None = None
) -> DataFrame:
    """All rows of the partitions that a patch will rewrite, kept as a written copy."""
    return materialise(keyset_join(df, touched_partitions(df, where, by, op, assign), list(by), "left_semi"), "pre-image")


def rollback(patched: DataFrame, before: DataFrame, by: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Put the partitions of the pre-image back. ``touched`` names further ones, which had no rows before the patch."""
    keys = before.select(*by)
    keys = keys if touched is None else keys.unionByName(touched.select(*by))
    return keyset_join(patched, keys, list(by), "left_anti").unionByName(before)


def patch_table(
    table: VersionedTable, spark: SparkSession, op: str, where: str, assign: Mapping[str, str] | None = None
) -> int:
    """Patch a stored table in one switch. Only touched partitions are rewritten.

    Returns the version before, which ``table.rollback`` makes current again, whatever the patch moved.
    """
    before = table.current(spark).version
    df = table.read(spark)
    by = list(table.by)
    if not by:
        table.replace_all(patch(df, op, where, assign))
        return before
    touched = materialise(touched_partitions(df, where, by, op, assign), "touched")
    table.replace_partitions(patch(keyset_join(df, touched, by, "left_semi"), op, where, assign), touched)
    return before


def narrowing_losses(df: DataFrame, column: str, data_type: str) -> DataFrame:
    """How many values of a column would become null in a narrower type, to be looked at before approval."""
    kept = F.col(identifier(column))
    return df.agg(F.count_if(kept.isNotNull() & kept.try_cast(data_type).isNull()).alias("lost_values"))


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """File count, bytes and small files of a table, from file metadata only."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("length", "modificationTime")
    )
    return files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("length") < SMALL_FILE).alias("small_files"),
        F.min("modificationTime").alias("oldest_file"),
    )
