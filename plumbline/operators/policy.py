"""Row filters, column masks, tenant scope and sensitivity, applied to the relation itself.

Policies are applied before any expression of the caller, so no predicate or derived column can see
a masked value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.functions.cleansing import sha_upper
from plumbline.scale import observed

# Sensitivity ladder, lowest first, and the first level that must not leave.
LEVELS = ("Public", "Internal", "Confidential", "Restricted")
FIRST_CLOSED_LEVEL = "Confidential"
FULL_MASK = "***"


@dataclass(frozen=True)
class Mask:
    column: str
    kind: str
    template: str | None = None


@dataclass(frozen=True)
class Decision:
    row_filters: Sequence[str] = field(default_factory=tuple)
    masks: Sequence[Mask] = field(default_factory=tuple)


@dataclass(frozen=True)
class PolicyTables:
    """subject(subject_id, group_name), row_policy(subject_id, table_name, filter_expr, enabled),
    column_policy(subject_id, table_name, column_name, mask_type, mask_expr, enabled)"""

    subject: DataFrame
    row_policy: DataFrame
    column_policy: DataFrame


def resolve(policies: PolicyTables, groups: Sequence[str], table: str) -> Decision:
    """Enabled policies of the caller's groups for one table. Without any, all is visible.

    The result is a handful of policy texts; they are the only rows brought to the driver.
    """
    if not groups:
        return Decision()
    subjects = policies.subject.filter(F.col("group_name").isin(list(groups))).select("subject_id").distinct()

    def applicable(frame: DataFrame) -> DataFrame:
        active = frame.filter(F.col("enabled") & (F.col("table_name") == table))
        return active.join(subjects, "subject_id", "left_semi")

    rows = applicable(policies.row_policy).select("filter_expr").distinct().orderBy("filter_expr").collect()
    masks = applicable(policies.column_policy).filter(F.coalesce("mask_type", F.lit("none")) != "none")
    columns = masks.select("column_name", "mask_type", "mask_expr").distinct().orderBy("column_name").collect()
    return Decision(
        tuple(r.filter_expr for r in rows if r.filter_expr and r.filter_expr.strip()),
        tuple(Mask(c.column_name, c.mask_type, c.mask_expr) for c in columns),
    )


def masked(column: str, kind: str, template: str | None, datatype) -> Column:
    c = F.col(f"`{column}`")
    kind = kind.lower()
    if kind == "deny":
        return F.lit(None).cast(datatype)
    if kind == "full":
        return F.lit(FULL_MASK)
    if kind == "hash":
        return sha_upper(c)
    if kind == "partial":
        return F.expr((template or "{col}").replace("{col}", f"`{column}`"))
    if kind == "none":
        return c
    raise SpecError(f"unknown mask {kind!r}")


def govern(df: DataFrame, decision: Decision) -> DataFrame:
    """The relation as its reader may see it: same columns, permitted rows, masked values."""
    for predicate in decision.row_filters:
        df = df.filter(F.expr(predicate))
    known = {c.lower(): c for c in df.columns}
    changes = {}
    for mask in decision.masks:
        name = known.get(mask.column.lower())
        if name:
            changes[name] = masked(name, mask.kind, mask.template, df.schema[name].dataType)
    return df.withColumns(changes) if changes else df


def preview_as(df: DataFrame, policies: PolicyTables, groups: Sequence[str], table: str) -> DataFrame:
    """What a member of these groups would see."""
    return govern(df, resolve(policies, groups, table))


def for_tenant(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of the tenant and shared rows; no tenant means all rows."""
    return df if not tenant else df.filter(F.col(column).isNull() | (F.col(column) == tenant))


def sensitivity_rank(label: Column) -> Column:
    """Place on the ladder; an unknown label counts as the lowest."""
    ranks = [F.when(label == name, F.lit(i)) for i, name in enumerate(LEVELS)]
    return F.coalesce(*ranks, F.lit(0))


def highest_level(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Highest sensitivity per key."""
    best = df.groupBy(*keys).agg(F.max(sensitivity_rank(F.col(label))).alias("_rank"))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return best.select(*keys, F.get(names, F.col("_rank")).alias("sensitivity"))


def releasable(label: Column, destination: str = "external") -> Column:
    """Whether rows of this level may be handed to the destination."""
    if destination == "local":
        return F.lit(True)
    return sensitivity_rank(label) < LEVELS.index(FIRST_CLOSED_LEVEL)


def sample(df: DataFrame, predicate: str | None = None, rows: int | None = None, default: int = 20, top: int = 200):
    """Rows of a governed relation that meet a free predicate: ``default`` of them, or as many as are asked for.

    A row count that is not positive or is above ``top`` is an error.
    """
    if rows is not None and not 0 < rows <= top:
        raise SpecError(f"a sample has from 1 to {top} rows, not {rows}")
    if predicate and predicate.strip():
        df = df.filter(F.expr(predicate))
    return df.limit(default if rows is None else rows)


def require_gold(namespace: str) -> None:
    if not namespace.lower().startswith("gold"):
        raise SpecError(f"{namespace!r} is not a gold namespace; only those may be analysed")


def audit_row(df: DataFrame, who: str, request: str, engine: str = "spark") -> DataFrame:
    """One audit record for a governed query, to be appended to the audit table."""
    plan = str(df.semanticHash())
    return df.sparkSession.range(1).select(
        F.lit(who).alias("subject_ref"),
        F.lit(request).alias("raw"),
        F.lit(plan).alias("rewritten"),
        F.lit(engine).alias("engine"),
        F.current_timestamp().alias("decided_at"),
    )


def append_audit(
    df: DataFrame, path: str, who: str, request: str, answer: Callable[[DataFrame], Any], engine: str = "spark"
) -> Any:
    """Answer a governed query and store its audit record with the number of rows that it answered.

    ``answer`` gets the query's frame and runs it once, to its end: it writes or collects it. The rows are counted by that
    very run, so the query is not computed again, and the record tells what the caller got.
    """
    seen = Observation()
    given = answer(df.observe(seen, F.count(F.lit(1)).alias("answered_rows")))
    counted = audit_row(df, who, request, engine).withColumn("answered_rows", F.lit(observed(seen).get("answered_rows", 0)).cast("bigint"))
    counted.write.mode("append").parquet(path)
    return given
