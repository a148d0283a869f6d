"""Run status, site status, metric rollups, log search and the metric registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.upsert import newest

# Seconds without a report until a site is stale; colours of a run status.
STALE_SECONDS = 300
AMBER = ("Retrying", "Queued", "Running")


def run_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def light(status: Column) -> Column:
    return F.when(status == "Failed", "r").when(status.isin(*AMBER), "a").otherwise("g")


def pipeline_board(runs: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Newest run of each pipeline with its traffic light."""
    last = newest(runs, ["pipeline"], ["started", *tie])
    return last.select("pipeline", "started", "status", "duration", light(F.col("status")).alias("light"))


def latest_metric(rollups: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Newest value per site and metric."""
    return newest(rollups, ["site", "metric"], ["ts", *tie])


def site_state(last_report: Column, now: Column) -> Column:
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_report.cast("timestamp"))
    return F.when(last_report.isNull(), "offline").when(age > STALE_SECONDS, "stale").otherwise("online")


def site_totals(sites: DataFrame) -> DataFrame:
    return sites.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("online", "stale", "offline")],
    )


def component_health(status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components that are up, out of all, per site."""
    up = F.col("status").isin("Connected", "Degraded")
    return status.groupBy(*keys).agg(F.count_if(up).alias("components_up"), F.count("*").alias("components"))


def kpi_tiles(connectors: DataFrame, runs: DataFrame, assets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Four headline numbers, one row each."""

    def tile(df: DataFrame, key: str, value: Column, tone: str) -> DataFrame:
        return df.agg(value.alias("value")).select(F.lit(key).alias("key"), "value", F.lit(tone).alias("tone"))

    return (
        tile(connectors, "Healthy pipelines", F.count_if(F.col("state") == "Running"), "ok")
        .unionByName(tile(runs, "Failed (24h)", F.count_if(F.col("status") == "Failed"), "fail"))
        .unionByName(tile(assets, "Catalog assets", F.count("*"), ""))
        .unionByName(tile(alerts, "Open alerts", F.count("*"), "warn"))
    )


def recent_runs(runs: DataFrame, rows: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    return runs.orderBy(F.col("started").desc(), *[F.col(c).desc() for c in tie]).limit(rows)


def first_json(document: Column, *paths: str) -> Column:
    """First of several JSON paths that is there, else empty text."""
    found = [F.get_json_object(document, f"$.{p}") for p in paths]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))


def log_search(
    logs: DataFrame, document: str, time: Column, text: str = "", rows: int = 100, tie: Sequence[str] = ()
) -> DataFrame:
    """Newest log entries that contain the text, with fields found under any of their usual names."""
    hits = logs.filter(F.lower(document).contains(text.lower())) if text.strip() else logs
    d = F.col(document)
    return (
        hits.select(
            time.alias("time"),
            first_json(d, "level", "log.level").alias("level"),
            first_json(d, "kubernetes.container_name", "container", "service").alias("service"),
            first_json(d, "message", "log", "msg").alias("message"),
            *tie,
        )
        .orderBy(F.col("time").desc(), *[F.col(c).desc() for c in tie])
        .limit(rows if rows > 0 else 100)
    )


@dataclass(frozen=True)
class Metric:
    """A published metric: an aggregate expression over one source."""

    name: str
    formula: str
    source: str
    unit: str = ""
    status: str = "Certified"


def published(definitions: DataFrame) -> DataFrame:
    """Newest definition per metric, drafts left out."""
    return newest(definitions.filter("status <> 'Draft'"), ["name"], ["version"])


def evaluate_metrics(metrics: Sequence[Metric], source: Callable[[str], DataFrame]) -> DataFrame:
    """One row per metric. The metrics of one source are computed in one pass over it."""
    parts = []
    for name in dict.fromkeys(m.source for m in metrics):
        own = [m for m in metrics if m.source == name]
        values = source(name).agg(*[F.expr(m.formula).cast("double").alias(f"_{i}") for i, m in enumerate(own)])
        lines = [
            F.struct(
                F.lit(m.name).alias("metric"),
                F.lit(m.source).alias("source"),
                F.lit(m.unit).alias("unit"),
                F.lit(m.status).alias("status"),
                F.col(f"_{i}").alias("value"),
            )
            for i, m in enumerate(own)
        ]
        parts.append(values.select(F.explode(F.array(*lines)).alias("m")).select("m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
