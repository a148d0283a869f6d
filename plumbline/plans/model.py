"""Warehouse tables declared as data and built as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.operators.scd import hashed_versions, scd2_hash_merge
from plumbline.scale import lookup_join

Hook = Callable[[DataFrame], DataFrame]
# Measure functions that a model may name.
MEASURES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class ModelColumn:
    name: str
    dtype: str
    expr: str | None = None
    role: str = ""  # business_key, attribute or empty
    tracked: bool = False
    measure: str | None = None

    def projected(self) -> Column:
        return F.expr(self.expr if self.expr else f"`{self.name}`").cast(self.dtype).alias(self.name)


@dataclass(frozen=True)
class ModelTable:
    name: str
    layer: str
    kind: str
    source: str
    columns: Sequence[ModelColumn]
    scd: str = ""

    def builder(self) -> str:
        """Which of the five builders makes this table."""
        if self.kind == "sync":
            return "sync"
        if self.layer == "bronze":
            return "bronze"
        if self.kind == "dim":
            return "dimension" if self.scd == "scd2" else "bronze"
        if self.kind in ("fact", "agg"):
            return self.kind
        raise SpecError(f"no builder for {self.layer} {self.kind}")


@dataclass(frozen=True)
class Relationship:
    fact: str
    dim: str
    fact_key: str
    dim_key: str


@dataclass(frozen=True)
class Hooks:
    """User transforms by table name."""

    transform: Mapping[str, Hook] = field(default_factory=dict)
    post_agg: Mapping[str, Hook] = field(default_factory=dict)
    pre_sync: Mapping[str, Hook] = field(default_factory=dict)


def check(table: ModelTable) -> None:
    names = [c.name for c in table.columns]
    if not names or len(set(names)) != len(names):
        raise SpecError(f"{table.name}: columns are missing or repeated")
    kind = table.builder()
    if kind == "dimension" and not (
        any(c.role == "business_key" for c in table.columns) and any(c.tracked for c in table.columns)
    ):
        raise SpecError(f"{table.name}: a versioned dimension needs a business key and a tracked column")
    if kind == "agg":
        if not any(c.measure for c in table.columns):
            raise SpecError(f"{table.name}: an aggregate needs a measure")
        for c in table.columns:
            if c.measure and c.measure not in MEASURES:
                raise SpecError(f"{table.name}: unknown measure function {c.measure!r}")


def project(df: DataFrame, table: ModelTable, hooks: Hooks) -> DataFrame:
    out = df.select(*[c.projected() for c in table.columns])
    return out.transform(hooks.transform.get(table.name, lambda x: x))


def build(
    table: ModelTable,
    tables: Mapping[str, DataFrame],
    now: Column,
    execution_date: str,
    relationships: Sequence[Relationship] = (),
    hooks: Hooks = Hooks(),
    stored: DataFrame | None = None,
) -> DataFrame:
    """Content of one modeled table; ``tables`` holds its source and, for facts, its dimensions."""
    check(table)
    source = tables[table.source]
    kind = table.builder()
    if kind == "bronze":
        stamped = {"_ingested_at": now, "_source": F.lit(table.source)}
        return project(source, table, hooks).withColumns(stamped)
    if kind == "dimension":
        keys = [c.name for c in table.columns if c.role == "business_key"]
        tracked = [c.name for c in table.columns if c.tracked]
        incoming = hashed_versions(project(source, table, hooks), keys, tracked, execution_date)
        return incoming if stored is None else scd2_hash_merge(stored, incoming, keys, execution_date)
    if kind == "fact":
        fact = project(source, table, hooks)
        for r in relationships:
            if r.fact == table.name:
                dim = tables[r.dim]
                if "_is_current" in dim.columns:
                    dim = dim.filter("_is_current")
                member = dim.select(F.col(r.dim_key).alias(r.fact_key), F.col("_surrogate_key").alias(f"{r.dim}_key"))
                fact = lookup_join(fact, member, [r.fact_key])
        return fact.withColumn("_loaded_at", now)
    if kind == "agg":
        groups = [c.projected() for c in table.columns if not c.measure]
        measures = [
            MEASURES[c.measure](F.expr(c.expr or f"`{c.name}`")).cast(c.dtype).alias(c.name)
            for c in table.columns
            if c.measure
        ]
        rows = source.transform(hooks.transform.get(table.name, lambda x: x)).groupBy(*groups).agg(*measures)
        return rows.transform(hooks.post_agg.get(table.name, lambda x: x)).withColumn("_computed_at", now)
    return project(source, table, hooks).transform(hooks.pre_sync.get(table.name, lambda x: x))
