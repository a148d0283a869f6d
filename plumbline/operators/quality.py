"""Data-quality rules, profiles, sensitive-field detection and standards checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """``kind`` is not_null, range, unique or custom."""

    name: str
    kind: str
    column: str = ""
    low: float | None = None
    high: float | None = None
    assertion: str = ""
    severity: str = "High"
    block: bool = True

    def failed(self) -> Column:
        c = F.col(self.column) if self.column else None
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "range":
            return ~F.coalesce(c.between(self.low, self.high), F.lit(False))
        if self.kind == "custom":
            return ~F.coalesce(F.expr(self.assertion), F.lit(False))
        raise ValueError(f"unknown rule kind {self.kind!r}")


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Row count and failed rows of every rule.

    All row-wise rules share one pass. A uniqueness rule counts the surplus rows of each value, so
    that zero means ``count(*) = count(DISTINCT column)``.
    """
    rowwise = [r for r in rules if r.kind != "unique"]
    parts = []
    if rowwise:
        counts = df.agg(F.count("*").alias("_n"), *[F.count_if(r.failed()).alias(f"_{i}") for i, r in enumerate(rowwise)])
        lines = F.array(*[_line(r, F.col("_n"), F.col(f"_{i}")) for i, r in enumerate(rowwise)])
        parts.append(counts.select(F.explode(lines).alias("r")).select("r.*"))
    for r in rules:
        if r.kind == "unique":
            values = df.groupBy(r.column).agg(F.count("*").alias("_c"))
            counts = values.agg(
                F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"),
                F.count(r.column).alias("_d"),
            )
            parts.append(
                counts.select(_line(r, F.col("_n"), F.col("_n") - F.col("_d")).alias("r")).select("r.*")
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line(rule: Rule, rows: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(rule.name).alias("rule"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.block).alias("_block"),
        rows.cast("long").alias("checked_rows"),
        failed.cast("long").alias("failed_rows"),
    )


def judge(results: DataFrame) -> DataFrame:
    """Pass, Warn or Fail per rule; a failed rule of high severity stops the downstream job."""
    bad = F.col("failed_rows") > 0
    high = F.col("severity") == "High"
    return results.select(
        "rule", "kind", "severity", "checked_rows", "failed_rows",
        F.when(~bad, "Pass").when(high, "Fail").otherwise("Warn").alias("result"),
        (bad & high & F.col("_block")).alias("blocks_downstream"),
    )


def blocked(judged: DataFrame) -> bool:
    return not judged.filter("blocks_downstream").isEmpty()


def duplicate_rows(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows."""
    return df.groupBy(column).agg(F.count("*").alias("copies")).filter("copies > 1")


def status_distribution(df: DataFrame, status: str = "data_quality_status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("rows"))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean share of set values over the columns, in whole per cent."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    total = sum((F.col(f"_{i}") for i in range(1, len(columns))), F.col("_0"))
    share = F.when(F.col("_n") > 0, total / (F.col("_n") * len(columns))).otherwise(0.0)
    return counts.select(F.col("_n").alias("row_count"), F.round(share * 100).cast("long").alias("completeness"))


def completeness_of_profiles(profiles: DataFrame) -> DataFrame:
    """The same score from stored column profiles."""
    return profiles.agg(F.round(F.avg(1 - F.col("null_share")) * 100).cast("long").alias("completeness"))


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: rows, null share, distinct values, least and greatest value as text.

    Distinct counts are approximate unless ``exact``. The exact form counts each value once per
    task before the shuffle.
    """
    columns = df.columns
    aggs = []
    for i, c in enumerate(columns):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"c{i}"), F.min(q).cast("string").alias(f"lo{i}"), F.max(q).cast("string").alias(f"hi{i}")]
        if not exact:
            aggs.append(F.approx_count_distinct(q).alias(f"d{i}"))
    one = df.agg(F.count("*").alias("n"), *aggs)
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("row_count"),
            F.when(F.col("n") > 0, (F.col("n") - F.col(f"c{i}")) / F.col("n")).alias("null_share"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            *([] if exact else [F.col(f"d{i}").alias("distinct_values")]),
        )
        for i, c in enumerate(columns)
    ]
    profile = one.select(F.explode(F.array(*lines)).alias("p")).select("p.*")
    if not exact:
        return profile
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    )
    values = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("v").isNotNull()).distinct()
    distinct = values.groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    return profile.join(distinct, "column_name", "left").fillna(0, ["distinct_values"])


# Patterns of sensitive content with the level they suggest, and texts of which every
# match contains at least one (in lower case; DIGITS stands for any digit). The patterns use the
# common subset of Java and RE2.
DIGITS = ("0-9",)
SENSITIVE_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "Confidential", ("@",)),
    ("phone", r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3,4}[ -]?[0-9]{4}", "Confidential", DIGITS),
    ("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "Restricted", DIGITS),
    ("payment_card", r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", "Restricted", DIGITS),
    ("secret_key", r"(?i)(api[_-]?key|secret|password|token)[ ]*[=:]", "Restricted", ("key", "secret", "password", "token")),
    ("ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "Internal", DIGITS),
)
SENSITIVE_NAMES = (
    ("email", r"(?i)e?mail", "Confidential"),
    ("phone", r"(?i)phone|mobile", "Confidential"),
    ("national_id", r"(?i)id_?card|ssn|national_id", "Restricted"),
    ("person", r"(?i)(customer|operator|person|c|s)_name$", "Confidential"),
)


def _may_match(text: str, needles: Sequence[str]) -> str:
    """Cheap test that every match passes; it spares most rows the costly pattern."""
    if needles == DIGITS:
        return f"{text} RLIKE '[0-9]'"
    plain = text if needles == ("@",) else f"lower({text})"
    return " OR ".join(f"contains({plain}, '{n}')" for n in needles)


def sensitive_scan(df: DataFrame, table: str, threshold: float = 0.0) -> DataFrame:
    """Hits of every pattern in every text column, counted in one pass over the whole texts."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    guards = list(dict.fromkeys(p[3] for p in SENSITIVE_PATTERNS))
    flags = {(c, g): f"_g{i}_{j}" for i, c in enumerate(texts) for j, g in enumerate(guards)}
    guarded = df.selectExpr(
        *[f"`{c}`" for c in texts], *[f"({_may_match(f'`{c}`', g)}) AS {n}" for (c, g), n in flags.items()]
    )
    pairs = [(c, *p) for c in texts for p in SENSITIVE_PATTERNS]
    hits = [f"count_if({flags[c, guard]} AND `{c}` RLIKE r'{rx}')" for c, _, rx, _, guard in pairs]
    counts = guarded.agg(F.expr("count(*)").alias("_n"), *[F.expr(h).alias(f"_{i}") for i, h in enumerate(hits)])
    lines = ", ".join(
        f"struct('{table}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, '{level}' AS suggested_level, "
        f"_{i} AS hits, try_divide(_{i}, _n) AS confidence)"
        for i, (c, kind, _, level, _) in enumerate(pairs)
    )
    found = counts.selectExpr(f"inline(array({lines}))")
    return found.filter((F.col("hits") > 0) & (F.col("confidence") >= threshold))


def sensitive_names(columns: DataFrame) -> DataFrame:
    """Columns of a schema frame whose names suggest sensitive content."""
    hits = [
        F.when(F.col("column_name").rlike(rx), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("suggested_level")))
        for kind, rx, level in SENSITIVE_NAMES
    ]
    return columns.withColumn("_hit", F.coalesce(*hits)).filter("_hit IS NOT NULL").select(*columns.columns, "_hit.*")


def level_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("assets"))


def schema_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type of a few tables, from their schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def naming_violations(schema: DataFrame, prefixes: Sequence[str] = ("dim_", "fact_")) -> DataFrame:
    """Names that break the naming standards, with a proposed name."""
    snake = F.lower(F.regexp_replace(F.col("column_name"), "([a-z0-9])([A-Z])", "$1_$2"))
    columns = schema.filter(~F.col("column_name").rlike("^[a-z][a-z0-9_]*$")).select(
        "table_name", "column_name", F.lit("lower_snake_case").alias("standard"),
        F.concat(F.lit("Rename to "), F.regexp_replace(snake, "[^a-z0-9_]+", "_")).alias("fix"),
    )
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("table_name").startswith(p)
    tables = schema.select("table_name").distinct().filter(~named).select(
        "table_name", F.lit("").alias("column_name"), F.lit("table prefix").alias("standard"),
        F.concat(F.lit("Use one of "), F.lit(", ".join(prefixes))).alias("fix"),
    )
    return columns.unionByName(tables)


def type_violations(schema: DataFrame, standards: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns whose name matches a pattern but whose type is not the standard one."""
    wanted = F.coalesce(*[F.when(F.col("column_name").rlike(rx), F.lit(kind)) for rx, kind in standards])
    return schema.withColumn("_want", wanted).filter("_want <> data_type").select(
        "table_name", "column_name", F.lit("type standard").alias("standard"),
        F.concat(F.lit("Use "), F.col("_want"), F.lit(" instead of "), F.col("data_type")).alias("fix"),
    )


@dataclass(frozen=True)
class DomainStandard:
    """Values of a column that the standard allows, as a predicate."""

    column: str
    predicate: str
    note: str


def domain_violations(df: DataFrame, table: str, standards: Sequence[DomainStandard]) -> DataFrame:
    """Per standard: rows outside the value domain. Compliant columns have zero."""
    rules = [Rule(s.column, "custom", assertion=s.predicate) for s in standards]
    notes = {s.column: s.note for s in standards}
    counted = run_rules(df, rules)
    note = F.coalesce(*[F.when(F.col("rule") == c, F.lit(n)) for c, n in notes.items()])
    return counted.select(
        F.lit(table).alias("table_name"), F.col("rule").alias("column_name"), note.alias("standard"),
        "failed_rows", (F.col("failed_rows") == 0).alias("compliant"),
    )


def standard_impact(violations: DataFrame) -> DataFrame:
    """Tables touched by a standard, with their non-compliant columns."""
    return violations.groupBy("table_name").agg(
        F.count("*").alias("violations"), F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("fields")
    )


def dimension_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """How far two dimensions cover the same members, and whether their grain is the same."""
    a = left.groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("l"))
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("r"))
    both = a.join(b, "k", "full_outer")
    shared = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        shared.alias("shared_members"),
        F.coalesce(F.max("l"), F.lit(0)).alias("left_rows_per_member"),
        F.coalesce(F.max("r"), F.lit(0)).alias("right_rows_per_member"),
    ).select(
        "*",
        F.try_divide(F.col("shared_members"), F.col("shared_members") + F.col("only_left") + F.col("only_right")).alias(
            "overlap"
        ),
        (F.col("left_rows_per_member") != F.col("right_rows_per_member")).alias("different_grain"),
    )


def bus_matrix(usage: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Business process by dimension: number of fact rows that use the dimension, 0 for none."""
    return usage.groupBy("process").pivot("dimension", list(dimensions)).agg(F.sum("used_rows")).fillna(0)
