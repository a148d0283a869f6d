"""Asset summaries, lineage graph, asset value and semantic entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.quality import completeness
from plumbline.operators.upsert import insert_absent, upsert
from plumbline.scale import materialise, lookup_join

EDGE = "src string, dst string"


def lineage_edges(runs: DataFrame, sources: str, targets: str) -> DataFrame:
    """Edges from every source to every target of the same job run, each edge once."""
    return (
        runs.select(F.explode(sources).alias("src"), F.col(targets))
        .select("src", F.explode(targets).alias("dst"))
        .distinct()
    )


def one_hop(edges: DataFrame, node: str) -> DataFrame:
    """Direct neighbours of a dataset: ``node, direction``."""
    down = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("downstream").alias("direction"))
    up = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("upstream").alias("direction"))
    return down.unionByName(up).distinct()


#: Rounds of plain breadth-first search before chains are looked for; most graphs end within them.
PLAIN_ROUNDS = 4


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All nodes downstream of the ``node`` column of ``start``, except those, with the least depth.

    Breadth-first: each round joins the newest nodes with the edges, and keeps unseen nodes. The frontier is a distinct
    set, so a node with many edges is split by the join. What is still open after a few rounds is searched with every
    chain of nodes that have one way in and one way out taken in one step, so the number of rounds grows with the
    branchings on the way and the logarithm of the longest chain, not with the depth. The edges are written once, and the
    result of each round, to the shared directory.
    """
    edges = materialise(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    seen = materialise(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        if depth == PLAIN_ROUNDS:
            return _along_chains(edges, seen, frontier, max_depth).filter("depth > 0")
        depth += 1
        step = lookup_join(edges, frontier.select(F.col("node").alias("src")), ["src"], "inner")
        found = step.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = materialise(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def chains(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """``node, head, far``: nodes with one way in and one way out, not among ``fixed``, with the first node before them
    that is none, and the steps from there. Each round doubles the steps that are known.

    A ring of such nodes has no head and can't be reached; it is left out.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("head")).where("n = 1")
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n = 1")
    inner = ins.join(outs, "node", "left_semi").join(fixed.select("node"), "node", "left_anti")
    links = materialise(inner.select("node", "head", F.lit(1).cast("long").alias("far")), "chains")
    rounds = max(links.count(), 1).bit_length() + 1
    for _ in range(rounds):
        before = links.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("far").alias("_far"))
        if links.join(before, "head", "left_semi").isEmpty():
            break
        jumped = links.join(before, "head", "left")
        far = F.col("far") + F.coalesce("_far", F.lit(0))
        links = materialise(jumped.select("node", F.coalesce("_head", "head").alias("head"), far.alias("far")), "chains")
    return links.join(links.select(F.col("node").alias("head")), "head", "left_anti")


def _along_chains(edges: DataFrame, seen: DataFrame, frontier: DataFrame, max_depth: int | None) -> DataFrame:
    """``seen`` and all that is reachable from ``frontier``, whose nodes are among it, with the least depths."""
    links = materialise(chains(edges, seen), "chains")
    crossing = edges.join(links.select(F.col("node").alias("dst")), "dst", "left_anti")
    from_chain = crossing.join(links.withColumnRenamed("node", "src"), "src", "left")
    steps = materialise(
        from_chain.select(F.coalesce("head", "src").alias("src"), "dst", (1 + F.coalesce("far", F.lit(0))).alias("far")), "steps"
    )
    within = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    known = seen
    while True:
        reached = lookup_join(steps, frontier.select(F.col("node").alias("src"), "depth"), ["src"], "inner")
        best = reached.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("far")).cast("int").alias("depth"))
        old = known.select("node", F.col("depth").alias("_depth"))
        better = best.where(within).join(old, "node", "left").where("_depth IS NULL OR depth < _depth").select("node", "depth")
        frontier = materialise(better)
        if frontier.isEmpty():
            break
        known = materialise(known.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))
    inside = links.join(known.select(F.col("node").alias("head"), "depth"), "head")
    inside = inside.select("node", (F.col("depth") + F.col("far")).cast("int").alias("depth")).where(within)
    return known.unionByName(inside)


def impact(edges: DataFrame, node: str, max_depth: int | None = None) -> DataFrame:
    spark: SparkSession = edges.sparkSession
    return reachable(edges, spark.range(1).select(F.lit(node).alias("node")), max_depth).filter(F.col("node") != node)


def usage_by_day(audit: DataFrame, table: str) -> DataFrame:
    """Queries per day that mention a table, in any letter case."""
    needle = f"%{table}%"
    hits = audit.filter(F.col("raw").ilike(needle) | F.col("rewritten").ilike(needle))
    return hits.groupBy(F.to_date("decided_at").alias("day")).agg(F.count("*").alias("queries"))


def recent_audit(audit: DataFrame, rows: int = 200, tie: Sequence[str] = ()) -> DataFrame:
    return audit.orderBy(F.col("decided_at").desc(), *[F.col(c).desc() for c in tie]).limit(rows if rows > 0 else 200)


def facets(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Number of assets per value of each field, in one pass."""
    cells = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(cells).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("assets"))


def asset_summary(name: str, df: DataFrame, audit: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per asset: rows, completeness, queries that used it, direct downstream assets."""
    base = completeness(df).select(F.lit(name).alias("asset"), "row_count", "completeness")
    used = usage_by_day(audit, name).agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"))
    down = edges.filter(F.col("src") == name).agg(F.count_distinct("dst").alias("downstream"))
    return (
        base.join(used.select(F.lit(name).alias("asset"), "queries"), "asset")
        .join(down.select(F.lit(name).alias("asset"), "downstream"), "asset")
    )


def asset_score(assets: DataFrame) -> DataFrame:
    """Value score from 0 to 100 and category of each asset.

    Input: ``asset, usage, storage, compute, dependants, quality`` (quality in per cent). Our own
    definition: 40 % usage, 25 % dependants, 35 % quality, each relative to the best asset. An
    unused asset without dependants is a zombie. Below 75 it is costly when its share of storage
    and compute exceeds its share of usage, otherwise it has normal value.
    """
    total = assets.agg(
        F.max("usage").alias("_mu"), F.max("dependants").alias("_md"),
        F.sum("usage").alias("_su"), F.sum("storage").alias("_ss"), F.sum("compute").alias("_sc"),
    )
    c = F.col
    # A one-row frame: its size is fixed.
    wide = assets.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))

    score = 40 * share("usage", "_mu") + 25 * share("dependants", "_md") + F.lit(0.35) * c("quality")
    cost = (share("storage", "_ss") + share("compute", "_sc")) / 2
    category = (
        F.when((c("usage") == 0) & (c("dependants") == 0), "zombie")
        .when(c("score") >= 75, "high")
        .when(cost > share("usage", "_su"), "costly")
        .otherwise("normal")
    )
    return wide.withColumn("score", F.round(score, 4)).withColumn("category", category).select(
        *assets.columns, "score", "category"
    )


def stale_assets(assets: DataFrame, edges: DataFrame, as_of, idle_days: int = 90) -> DataFrame:
    """Assets (``asset, last_used``) idle for long and without anything downstream."""
    idle = assets.filter(F.datediff(F.lit(as_of).cast("date"), F.col("last_used")) >= idle_days)
    return idle.join(edges.select(F.col("src").alias("asset")).distinct(), "asset", "left_anti")


def without_description(assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Assets that no semantic entry describes."""
    described = entries.filter(F.coalesce(F.nullif("nl_description", F.lit("")), F.lit("")) != "")
    return assets.join(described.select(F.col("entity_urn").alias("asset")).distinct(), "asset", "left_anti")


ENTRY = (
    "entity_urn string, entity_type string, nl_description string, business_caliber string, "
    "domain_knowledge string, sensitivity string, status string"
)


def compile_entries(entries: DataFrame, assets: DataFrame, terms: DataFrame) -> DataFrame:
    """Add entries for unknown assets and metric terms; authored entries are never changed.

    ``assets``: name, description, sensitivity. ``terms``: name, definition, formula.
    """
    formula = F.when(F.coalesce("formula", F.lit("")) != "", F.concat(F.lit(" Formula: "), "formula"))
    text = F.concat(F.coalesce("definition", F.lit("")), F.coalesce(formula, F.lit("")))
    found = assets.select(
        F.col("name").alias("entity_urn"), F.lit("table").alias("entity_type"),
        F.col("description").alias("nl_description"),
        F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("Internal")).alias("sensitivity"),
    ).unionByName(
        terms.select(
            F.col("name").alias("entity_urn"), F.lit("metric").alias("entity_type"), text.alias("nl_description"),
            F.lit("Internal").alias("sensitivity"),
        )
    )
    ready = found.filter(F.coalesce("entity_urn", F.lit("")) != "").withColumns(
        {"business_caliber": F.lit(None).cast("string"), "domain_knowledge": F.lit(None).cast("string")}
    )
    return insert_absent(entries, with_entry_status(ready).select(*entries.columns), ["entity_urn"])


def with_entry_status(entries: DataFrame) -> DataFrame:
    """``desc`` once any text is there, else ``pend``."""
    texts = ["nl_description", "business_caliber", "domain_knowledge"]
    any_text = F.concat_ws("", *texts) != ""
    return entries.withColumn("status", F.when(any_text, "desc").otherwise("pend"))


def upsert_entries(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    ready = with_entry_status(incoming).withColumn(
        "sensitivity", F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("Internal"))
    )
    return upsert(entries, ready.select(*entries.columns), ["entity_urn"], frozen=())


def search_entries(entries: DataFrame, text: str, rows: int = 5) -> DataFrame:
    """Entries that mention the text; those that have it in the name come first."""
    needle = f"%{text}%"
    in_name = F.col("entity_urn").ilike(needle)
    anywhere = in_name
    for c in ("nl_description", "business_caliber", "domain_knowledge"):
        anywhere = anywhere | F.coalesce(F.col(c).ilike(needle), F.lit(False))
    return entries.filter(anywhere).orderBy(in_name.desc(), "entity_urn").limit(rows if rows > 0 else 5)
