"""Structured queries, chart series, dashboards and published data contracts.

A query is described as data, checked against the frame's schema and built from DataFrame calls;
no SQL text is assembled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SpecError

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v) if isinstance(v, (list, tuple, set)) else [v]),
    "like": lambda c, v: c.like(v),
}


@dataclass(frozen=True)
class QuerySpec:
    dataset: str = ""
    dimensions: Sequence[str] = ()
    measures: Sequence[tuple[str, str]] = ()  # (column or *, aggregate)
    filters: Sequence[tuple[str, str, Any]] = ()  # (column, operator, value)
    order_by: Sequence[tuple[str, str]] = ()  # (column or measure alias, asc or desc)
    limit: int | None = None


class Columns:
    """Case-insensitive column names of a frame."""

    def __init__(self, df: DataFrame) -> None:
        self._names = {c.lower(): c for c in df.columns}

    def find(self, name: str) -> str:
        try:
            return self._names[name.lower()]
        except KeyError:
            raise SpecError(f"the dataset has no column named {name!r}") from None


def measure_alias(column: str, aggregate: str) -> str:
    return "count" if aggregate.lower() == "count" and column in ("", "*") else f"{aggregate.lower()}_{column}"


def _measure(names: Columns, column: str, aggregate: str) -> Column:
    function = AGGREGATES.get(aggregate.lower())
    if function is None:
        raise SpecError(f"{aggregate!r} is not one of the aggregates: {', '.join(AGGREGATES)}")
    alias = measure_alias(column, aggregate)
    if alias == "count":
        return F.count("*").alias(alias)
    return function(names.find(column)).alias(alias)


def apply_filters(df: DataFrame, filters: Sequence[tuple[str, str, Any]]) -> DataFrame:
    names = Columns(df)
    for column, op, value in filters:
        compare = OPERATORS.get(op.lower())
        if compare is None:
            raise SpecError(f"{op!r} is not one of the comparisons: {', '.join(OPERATORS)}")
        df = df.filter(compare(F.col(names.find(column)), value))
    return df


def row_limit(requested: int | None, ceiling: int | None = None) -> int | None:
    """The rows that a caller asked for; None asks for all. More than the ceiling is an error, never a cut."""
    if requested is None:
        return None
    if requested <= 0:
        raise SpecError(f"a row count must be positive, not {requested}")
    if ceiling is not None and requested > ceiling:
        raise SpecError(f"at most {ceiling} rows can be asked for, not {requested}")
    return requested


def build_query(df: DataFrame, spec: QuerySpec, ceiling: int | None = None) -> DataFrame:
    """Filter, project or aggregate, and sort, as the spec says; only a spec with a limit is cut."""
    names = Columns(df)
    dims = [F.col(names.find(d)).alias(d) for d in spec.dimensions]
    out = apply_filters(df, spec.filters)
    if spec.measures:
        out = out.groupBy(*dims).agg(*[_measure(names, c, a) for c, a in spec.measures])
    if spec.order_by and not spec.measures:
        out = out.orderBy(*_order(Columns(out), spec.order_by))
    if dims and not spec.measures:
        out = out.select(*dims)
    if spec.order_by and spec.measures:
        out = out.orderBy(*_order(Columns(out), spec.order_by))
    limit = row_limit(spec.limit, ceiling)
    return out if limit is None else out.limit(limit)


def _order(names: Columns, order: Sequence[tuple[str, str]]) -> list[Column]:
    return [
        F.col(names.find(c)).desc() if direction.lower() == "desc" else F.col(names.find(c)).asc()
        for c, direction in order
    ]


def chart_series(result: DataFrame, spec: QuerySpec) -> DataFrame:
    """Long form ``group, key, value`` of a query result.

    The first dimension is the key. A second dimension names the series, else each measure does.
    Without measures the first column is the key and the last the value.
    """
    columns = result.columns
    measures = columns[len(spec.dimensions) :]
    if not measures:
        return result.select(
            F.lit("value").alias("group"),
            F.col(columns[0]).cast("string").alias("key"),
            F.col(columns[-1]).cast("double").alias("value"),
        )
    key = F.col(columns[0]).cast("string") if spec.dimensions else F.lit("")
    points = []
    for m in measures:
        group = F.col(columns[1]).cast("string") if len(spec.dimensions) >= 2 else F.lit(m)
        points.append(F.struct(group.alias("group"), key.alias("key"), F.col(m).cast("double").alias("value")))
    return result.select(F.explode(F.array(*points)).alias("p")).select("p.*")


@dataclass(frozen=True)
class Widget:
    id: str
    title: str
    spec: QuerySpec


@dataclass
class WidgetResult:
    series: DataFrame | None = None
    error: str | None = None


def run_dashboard(
    widgets: Sequence[Widget], source: Callable[[str], DataFrame], only_first: bool = False
) -> dict[str, WidgetResult]:
    """Chart series per configured widget. One broken widget does not stop the others."""
    results: dict[str, WidgetResult] = {}
    for widget in widgets:
        if not widget.spec.dataset:
            continue
        try:
            frame = build_query(source(widget.spec.dataset), widget.spec)
            results[widget.id] = WidgetResult(series=chart_series(frame, widget.spec))
        except SpecError as error:
            results[widget.id] = WidgetResult(error=str(error))
        if only_first:
            break
    return results


SERIES = "`group` string, key string, value double, error string, widget string"


def dashboard_frame(spark: SparkSession, results: Mapping[str, WidgetResult]) -> DataFrame:
    """The series of all widgets as rows, and one row with the error of each widget that has none."""
    broken = [(None, None, None, r.error, k) for k, r in results.items() if r.error is not None]
    out = spark.createDataFrame(broken, SERIES)
    for k, r in results.items():
        if r.series is not None:
            named = [F.lit(None).cast("string").alias("error"), F.lit(k).alias("widget")]
            out = out.unionByName(r.series.select("group", "key", F.col("value").cast("double"), *named))
    return out


def report_frame(
    source: Callable[[str], DataFrame], spec: QuerySpec | None = None, widgets: Sequence[Widget] = ()
) -> DataFrame:
    """Result of a report: its own spec, or the first configured widget of its dashboard."""
    if spec is None:
        configured = [w for w in widgets if w.spec.dataset]
        if not configured:
            raise SpecError("report has neither a query nor a configured dashboard widget")
        spec = configured[0].spec
    return build_query(source(spec.dataset), spec)


@dataclass(frozen=True)
class ContractFilter:
    column: str
    ops: Sequence[str] = ("=",)
    required: bool = False
    default: str | None = None


@dataclass(frozen=True)
class DataContract:
    columns: Mapping[str, str]  # source column to exposed name
    filters: Sequence[ContractFilter] = ()
    default_size: int = 100
    max_size: int | None = None
    sortable: Sequence[str] = field(default_factory=tuple)  # exposed names


def split_list(text: str) -> list[str]:
    return [item.strip() for item in text.split(",") if item.strip()]


def serve_contract(df: DataFrame, contract: DataContract, params: Mapping[str, str]) -> DataFrame:
    """Answer of a published endpoint. Callers may only use exposed columns and declared filters.

    A parameter is named after the exposed column, optionally followed by ``__`` and one of the
    filter's allowed operators. ``_limit`` and ``_sort`` control paging and order.
    """
    if not contract.columns:
        raise SpecError("a contract must expose at least one column")
    filters = []
    for f in contract.filters:
        exposed = contract.columns.get(f.column, f.column)
        given = {op: params[f"{exposed}__{op}"] for op in f.ops if params.get(f"{exposed}__{op}")}
        if params.get(exposed):
            given[f.ops[0] if f.ops else "="] = params[exposed]
        if not given and f.default is not None:
            given[f.ops[0] if f.ops else "="] = f.default
        if not given and f.required:
            raise SpecError(f"a value for {exposed!r} has to be given")
        for op, raw in given.items():
            filters.append((f.column, op, split_list(raw) if op.lower() == "in" else raw))
    size = contract.default_size if contract.default_size > 0 else 100
    asked = params.get("_limit", "")
    if asked:
        if not asked.isdigit() or int(asked) == 0:
            raise SpecError(f"_limit is a positive number, not {asked!r}")
        size = int(asked)
    if contract.max_size and size > contract.max_size:
        if asked:
            raise SpecError(f"at most {contract.max_size} rows may be asked for, not {size}")
        size = contract.max_size
    order = []
    for item in split_list(params.get("_sort", "")):
        name = item.lstrip("-")
        if name not in contract.sortable:
            raise SpecError(f"{name!r} is not offered for sorting")
        order.append(F.col(name).desc() if item.startswith("-") else F.col(name).asc())
    names = Columns(df)
    out = apply_filters(df, filters).select(
        *[F.col(names.find(src)).alias(exposed) for src, exposed in contract.columns.items()]
    )
    return (out.orderBy(*order) if order else out).limit(size)
