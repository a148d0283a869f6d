"""Data quality, catalog, lineage, table operations, monitoring, matching and standards."""

from __future__ import annotations


from pyspark.sql import functions as F

from plumbline.operators import catalog, matching, monitoring, profiles, quality, tableops
from plumbline.scale import shared_dir
from plumbline.sources import sinks
from plumbline.sources.versions import VersionedTable
from queries.governed import audit
from queries.roles import Registry, rounded, table

R = Registry()

# --- data quality ----------------------------------------------------------------------------


def gappy_orders(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(p < 400_000, p).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(p > 20_000, F.col("o_orderstatus")).alias("o_orderstatus"),
    )


GAPPY_SQL = """gap AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority,
         CASE WHEN o_totalprice > 20000 THEN o_orderstatus END AS o_orderstatus FROM orders)"""


@R.add(f"""WITH {GAPPY_SQL}
SELECT count(*) AS row_count, CAST(round((count(o_orderkey) + count(o_custkey) + count(o_totalprice)
  + count(o_orderpriority) + count(o_orderstatus)) * 100.0 / (count(*) * 5)) AS BIGINT) AS completeness FROM gap""")
def completeness(spark, sf):
    return quality.completeness(gappy_orders(spark, sf))


@R.add(f"""WITH {GAPPY_SQL},
p AS (SELECT 'o_custkey' AS c, count(o_custkey) * 1.0::DOUBLE / count(*) AS s FROM gap
      UNION ALL SELECT 'o_orderkey', count(o_orderkey) * 1.0 / count(*) FROM gap
      UNION ALL SELECT 'o_totalprice', count(o_totalprice) * 1.0 / count(*) FROM gap
      UNION ALL SELECT 'o_orderpriority', count(o_orderpriority) * 1.0 / count(*) FROM gap
      UNION ALL SELECT 'o_orderstatus', count(o_orderstatus) * 1.0 / count(*) FROM gap)
SELECT CAST(round(avg(s) * 100) AS BIGINT) AS completeness FROM p""")
def completeness_of_profiles(spark, sf):
    return quality.completeness_of_profiles(quality.column_profile(gappy_orders(spark, sf)))


def profile_sql(columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, round(1 - count({c})::DOUBLE / count(*), 6) AS null_share,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
        count(DISTINCT {c}) AS distinct_values FROM gap"""
        for c in columns
    )


@R.add(f"""WITH {GAPPY_SQL} {profile_sql(["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])}""")
def column_profile(spark, sf):
    """All columns, numbers compared as numbers and shown as text."""
    return rounded(quality.column_profile(gappy_orders(spark, sf), exact=True))


@R.add("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price,
             year(o_orderdate) AS year FROM orders),
p AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, round(1 - count({c})::DOUBLE / count(*), 6) AS null_share,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM o"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "price", "year")
) + """)
SELECT column_name, row_count, null_share, CASE WHEN column_name = 'price' THEN NULL ELSE min_value END AS min_value,
       CASE WHEN column_name = 'price' THEN NULL ELSE max_value END AS max_value, true AS distinct_close, 1 AS partitions_read FROM p""")
def merged_profile(spark, sf):
    """Profile kept per year: one year is written anew, and only that one is read before the profiles are merged."""
    o = orders_by_year(spark, sf).withColumn("price", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))).drop("o_totalprice", "d")
    source, store = VersionedTable(shared_dir(spark, "orders"), ("year",)), VersionedTable(shared_dir(spark, "profiles"), ("year",))
    source.create(o.withColumn("o_custkey", F.when(F.col("year") == 1996, F.lit(-1)).otherwise(F.col("o_custkey"))))
    profiles.refresh(spark, source, store)
    source.replace_partitions(o.filter("year = 1996"))
    read = len(profiles.refresh(spark, source, store))
    merged = profiles.profile(spark, source, store)
    counted = quality.column_profile(source.read(spark), exact=True).select("column_name", F.col("distinct_values").alias("_exact"))
    close = F.abs(F.col("distinct_values") - F.col("_exact")) <= F.greatest(0.08 * F.col("_exact"), F.lit(1))
    text = lambda c: F.when(F.col("column_name") != "price", F.col(c)).alias(c)
    return rounded(merged.join(counted, "column_name").select(
        "column_name", "row_count", "null_share", text("min_value"), text("max_value"), close.alias("distinct_close"),
        F.lit(read).alias("partitions_read"),
    ))


RULES = [
    quality.Rule("key set", "not_null", "l_orderkey"),
    quality.Rule("tax in range", "range", "l_tax", 0.0, 0.05, severity="Medium"),
    quality.Rule("one row per order", "unique", "l_orderkey"),
    quality.Rule("price covers quantity", "custom", assertion="l_extendedprice >= l_quantity * 100", block=False),
    quality.Rule("known flags", "custom", assertion="l_returnflag IN ('A', 'N', 'R')"),
]
RULES_SQL = """rules AS (
  SELECT 'key set' AS rule, 'not_null' AS kind, 'High' AS severity, count(*) AS checked_rows,
         count(*) FILTER (l_orderkey IS NULL) AS failed_rows, true AS blk FROM lineitem
  UNION ALL SELECT 'tax in range', 'range', 'Medium', count(*), count(*) FILTER (NOT l_tax BETWEEN 0 AND 0.05), true
    FROM lineitem
  UNION ALL SELECT 'one row per order', 'unique', 'High', count(*), count(*) - count(DISTINCT l_orderkey), true
    FROM lineitem
  UNION ALL SELECT 'price covers quantity', 'custom', 'High', count(*),
    count(*) FILTER (NOT l_extendedprice >= l_quantity * 100), false FROM lineitem
  UNION ALL SELECT 'known flags', 'custom', 'High', count(*),
    count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')), true FROM lineitem)"""


@R.add(f"WITH {RULES_SQL} SELECT rule, kind, severity, checked_rows, failed_rows FROM rules")
def dq_rules(spark, sf):
    return quality.run_rules(table(spark, sf, "lineitem"), RULES).drop("_block")


@R.add(f"""WITH {RULES_SQL}
SELECT rule, kind, severity, checked_rows, failed_rows,
       CASE WHEN failed_rows = 0 THEN 'Pass' WHEN severity = 'High' THEN 'Fail' ELSE 'Warn' END AS result,
       failed_rows > 0 AND severity = 'High' AND blk AS blocks_downstream FROM rules""")
def dq_result(spark, sf):
    return quality.judge(quality.run_rules(table(spark, sf, "lineitem"), RULES))


@R.add("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "lineitem"), "l_orderkey")


# --- catalog and lineage ---------------------------------------------------------------------


def edges(spark, sf):
    """Region to nation to customer to order, as datasets that feed each other."""
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))

    def link(df, a, ac, b, bc):
        return df.select(
            F.concat(F.lit(a), F.col(ac).cast("string")).alias("src"),
            F.concat(F.lit(b), F.col(bc).cast("string")).alias("dst"),
        )

    return (
        link(n, "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(link(c, "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(link(o, "c", "o_custkey", "o", "o_orderkey"))
    )


EDGES_SQL = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@R.add("""
SELECT DISTINCT s.src, 'order' || l_orderkey AS dst
FROM lineitem, LATERAL (VALUES ('part' || l_partkey), ('supplier' || l_suppkey)) s(src)
UNION SELECT DISTINCT s.src, 'flag' || l_returnflag
FROM lineitem, LATERAL (VALUES ('part' || l_partkey), ('supplier' || l_suppkey)) s(src)""")
def lineage_edges(spark, sf):
    """Every line is a job run with two sources and two targets."""
    i = table(spark, sf, "lineitem")

    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    runs = i.select(
        F.array(name("part", "l_partkey"), name("supplier", "l_suppkey")).alias("sources"),
        F.array(name("order", "l_orderkey"), name("flag", "l_returnflag")).alias("targets"),
    )
    return catalog.lineage_edges(runs, "sources", "targets")


@R.add(f"""WITH {EDGES_SQL}
SELECT dst AS node, 'downstream' AS direction FROM edges WHERE src = 'n3'
UNION SELECT src, 'upstream' FROM edges WHERE dst = 'n3'""")
def lineage_one_hop(spark, sf):
    return catalog.one_hop(edges(spark, sf), "n3")


@R.add(f"""WITH RECURSIVE {EDGES_SQL},
walk AS (SELECT dst AS node, 1 AS depth FROM edges WHERE src = 'r1'
         UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node""")
def impact(spark, sf):
    return rounded(catalog.impact(edges(spark, sf), "r1"))


@R.add(f"""WITH {EDGES_SQL}, {GAPPY_SQL}
SELECT 'gold.click' AS asset, (SELECT count(*) FROM gap) AS row_count,
       (SELECT CAST(round((count(o_totalprice) + count(o_orderkey) + count(o_custkey) + count(o_orderpriority)
          + count(o_orderstatus)) * 100.0 / (count(*) * 5)) AS BIGINT) FROM gap) AS completeness,
       (SELECT count(*) FROM events WHERE event_type = 'click' OR value > 100) AS queries,
       (SELECT count(DISTINCT dst) FROM edges WHERE src LIKE 'n%') AS downstream""")
def asset_profile(spark, sf):
    """Summary of one asset that all nations' edges start from."""
    own = edges(spark, sf).withColumn("src", F.when(F.col("src").startswith("n"), "gold.click").otherwise(F.col("src")))
    return catalog.asset_summary("gold.click", gappy_orders(spark, sf), audit(spark, sf), own)


@R.add("""SELECT 'lang' AS facet, lang AS value, count(*) AS assets FROM documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL""")
def facets(spark, sf):
    return catalog.facets(table(spark, sf, "documents"), ["lang", "source"])


def entries(spark, sf):
    """Documents as semantic entries; the quality label decides what is written about them."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        F.concat(F.lit("urn:"), "lang", F.lit(":"), "doc_id").alias("entity_urn"), F.lit("table").alias("entity_type"),
        F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("nl_description"),
        F.when(F.col("toxic") == 1, F.lit("blocked")).alias("business_caliber"),
        F.lit(None).cast("string").alias("domain_knowledge"),
        F.lit("Internal").alias("sensitivity"), F.lit("pend").alias("status"),
    )


@R.add("""
WITH e AS (SELECT 'urn:' || lang || ':' || doc_id AS entity_urn,
                  CASE WHEN quality = 1 THEN text ELSE '' END AS nl, CASE WHEN toxic = 1 THEN 'blocked' END AS bc
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT entity_urn FROM e WHERE entity_urn ILIKE '%en%' OR nl ILIKE '%en%' OR bc ILIKE '%en%'
ORDER BY entity_urn ILIKE '%en%' DESC, entity_urn LIMIT 40""")
def semantic_search(spark, sf):
    return catalog.search_entries(entries(spark, sf), "en", 40).select("entity_urn")


@R.add("""
WITH e AS (SELECT 'urn:' || lang || ':' || doc_id AS urn, doc_id, quality, toxic, text
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT urn AS entity_urn, 'table' AS entity_type,
       CASE WHEN quality = 1 AND length(text) > 0 OR toxic = 1 THEN 'desc' ELSE 'pend' END AS status FROM e
UNION ALL SELECT 'source:' || source, 'table', 'desc' FROM documents GROUP BY source
UNION ALL SELECT 'metric:' || p_type, 'metric', 'desc' FROM part GROUP BY p_type""")
def semantic_entries(spark, sf):
    """Upsert sets the status; compiling adds unknown assets and terms and leaves authored rows alone."""
    authored = catalog.with_entry_status(entries(spark, sf))
    kept = catalog.upsert_entries(authored.filter("status = 'desc'"), authored.filter("status = 'pend'"))
    d = table(spark, sf, "documents")
    known = kept.select(F.col("entity_urn").alias("name"), F.lit("machine text").alias("description"))
    found = d.select(F.concat(F.lit("source:"), "source").alias("name"), F.lit("a source").alias("description"))
    assets = known.unionByName(found.distinct()).withColumn("sensitivity", F.lit(""))
    terms = table(spark, sf, "part").select(F.concat(F.lit("metric:"), "p_type").alias("name")).distinct().select(
        "name", F.lit("Parts of a type.").alias("definition"), F.lit("count(*)").alias("formula")
    )
    return catalog.compile_entries(kept, assets, terms).select("entity_urn", "entity_type", "status")


@R.add("""
SELECT 'doc' || doc_id AS asset FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_semantics(spark, sf):
    """Documents without a label count as assets without a description."""
    name = F.concat(F.lit("doc"), "doc_id")
    labelled = table(spark, sf, "labels").select(name.alias("entity_urn"), F.lit("labelled").alias("nl_description"))
    return catalog.without_description(table(spark, sf, "documents").select(name.alias("asset")), labelled)


@R.add("""
WITH last AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_used FROM orders GROUP BY ALL)
SELECT 'c' || o_custkey AS asset, last_used FROM last
WHERE date_diff('day', last_used, DATE '2001-08-01') >= 90
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000)""")
def stale_assets(spark, sf):
    """Customers idle for 90 days without a large open order."""
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    assets = o.groupBy(name.alias("asset")).agg(F.max(F.to_date("o_orderdate")).alias("last_used"))
    open_orders = o.filter("o_orderstatus = 'O' AND o_totalprice > 250000").select(name.alias("src"))
    return catalog.stale_assets(assets, open_orders, "2001-08-01")


ASSETS_SQL = """a AS (
  SELECT p_brand AS asset, count(l_orderkey) FILTER (l_shipdate >= DATE '2000-01-01') AS usage,
         sum(coalesce(l_quantity, 0)) AS storage, sum(coalesce(l_extendedprice, 0)) AS compute,
         count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS dependants,
         count(*) FILTER (l_discount < 0.05) * 100.0::DOUBLE / count(*) AS quality
  FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT max(usage) AS mu, max(dependants) AS md, sum(usage) AS su, sum(storage) AS ss, sum(compute) AS sc FROM a),
s AS (SELECT a.*, round(40 * usage::DOUBLE / mu + 25 * dependants::DOUBLE / md + 0.35 * quality, 4) AS score,
             (storage / ss + compute / sc) / 2 AS cost, usage::DOUBLE / su AS use FROM a, t)"""


@R.add(f"""WITH {ASSETS_SQL}
SELECT asset, usage, dependants, score, CASE WHEN usage = 0 AND dependants = 0 THEN 'zombie' WHEN score >= 75 THEN 'high'
       WHEN cost > use THEN 'costly' ELSE 'normal' END AS category FROM s""")
def asset_score(spark, sf):
    """Brands as assets, valued by their lines."""
    recent = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    # Lines are added up per part and returning supplier before the join: a part may have very many.
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), returned.alias("returner")).agg(
        F.count("*").alias("n"),
        F.count_if(recent).alias("recent"),
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.count_if(F.col("l_discount") < 0.05).alias("low"),
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_brand").join(lines, "p_partkey", "left")
    rows = parts.fillna({"n": 1, "recent": 0, "quantity": 0.0, "price": 0.0, "low": 0})
    assets = rows.groupBy(F.col("p_brand").alias("asset")).agg(
        F.sum("recent").alias("usage"),
        F.sum("quantity").alias("storage"),
        F.sum("price").alias("compute"),
        F.count_distinct("returner").alias("dependants"),
        (F.sum("low") * 100.0 / F.sum("n")).alias("quality"),
    )
    return rounded(catalog.asset_score(assets).select("asset", "usage", "dependants", "score", "category"))


# --- table operations ------------------------------------------------------------------------

WHERE = "o_orderstatus = 'P' AND o_totalprice > 300000"


def orders_by_year(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))


@R.add(f"SELECT count(*) AS affected_rows FROM orders WHERE {WHERE}")
def patch_preview(spark, sf):
    return tableops.patch_preview(table(spark, sf, "orders"), WHERE)


PATCHED_SQL = f"""SELECT o_orderkey, o_custkey, CASE WHEN {WHERE} THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  round(CASE WHEN {WHERE} THEN o_totalprice / 2 ELSE o_totalprice END, 6) AS o_totalprice, year(o_orderdate) AS year
FROM orders"""
SET = {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice / 2"}


@R.add(PATCHED_SQL)
def patch_update(spark, sf):
    return rounded(tableops.patch(orders_by_year(spark, sf), "update", WHERE, SET))


@R.add(f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, year(o_orderdate) AS year
FROM orders WHERE NOT ({WHERE})""")
def patch_delete(spark, sf):
    return rounded(tableops.patch(orders_by_year(spark, sf), "delete", WHERE))


@R.add("""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, year(o_orderdate) AS year
FROM orders""")
def patch_rollback(spark, sf):
    """A delete, undone from the pre-image of the partitions it touched, and then, in a stored table, an update that moves
    rows to other partitions, undone by a switch to the version before."""
    before = orders_by_year(spark, sf)
    image = tableops.pre_image(before, WHERE, ["year"])
    target = VersionedTable(shared_dir(spark, "orders"), ("year",))
    target.create(tableops.rollback(tableops.patch(before, "delete", WHERE), image, ["year"]))
    version = tableops.patch_table(target, spark, "update", WHERE, {"year": "year + 1", "o_totalprice": "0"})
    target.rollback(spark, version)
    return rounded(target.read(spark))


@R.add(f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(CASE WHEN {WHERE} THEN 0 ELSE o_totalprice END, 6) AS o_totalprice,
  year(o_orderdate) + CASE WHEN {WHERE} THEN 1 ELSE 0 END AS year FROM orders""")
def patch_table(spark, sf):
    """An update of a stored table that moves rows to other partitions."""
    target = VersionedTable(shared_dir(spark, "orders"), ("year",))
    target.create(orders_by_year(spark, sf))
    tableops.patch_table(target, spark, "update", WHERE, {"year": "year + 1", "o_totalprice": "0"})
    return rounded(target.read(spark))


@R.add("""SELECT o_orderkey, o_orderstatus AS state, CAST(round(o_totalprice) AS BIGINT) AS o_totalprice,
  CAST(NULL AS DATE) AS closed_on, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders""")
def schema_evolve(spark, sf):
    """Add, rename and widen run at once; drop and narrow are approved."""
    df = orders_by_year(spark, sf).withColumn("o_totalprice", F.round("o_totalprice"))
    df = tableops.alter(df, "add", "closed_on", data_type="date")
    df = tableops.alter(df, "rename", "o_orderstatus", new_name="state")
    df = tableops.alter(df, "widen", "year", data_type="bigint")
    df = tableops.alter(df, "drop", "o_custkey", approved=True)
    return tableops.alter(df, "narrow", "o_totalprice", data_type="bigint", approved=True)


@R.add("""SELECT year(o_orderdate) AS year, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders
GROUP BY ALL""")
def compact(spark, sf):
    """A table written in many small files, compacted; the rows stay the same."""
    target = VersionedTable(shared_dir(spark, "orders"), ("year",))
    sinks.write_create(orders_by_year(spark, sf).repartition(6), target)
    sinks.compact(target, spark)
    return rounded(target.read(spark).groupBy("year").agg(
        F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    ))


@R.add("""SELECT count(DISTINCT year(o_orderdate)) AS file_count, count(DISTINCT year(o_orderdate)) AS small_files,
  true AS has_bytes, true AS has_oldest FROM orders""")
def table_files(spark, sf):
    """One file for each year, all of them small; bytes and times depend on the run and are only there."""
    target = sinks.ParquetTable(shared_dir(spark, "orders"), ("year",))
    sinks.write_create(orders_by_year(spark, sf).repartition(4, "year"), target)
    files = tableops.table_files(spark, target.path)
    known = (F.col("total_bytes") > 0).alias("has_bytes"), F.col("oldest_file").isNotNull().alias("has_oldest")
    return files.select("file_count", "small_files", *known)


# --- monitoring ------------------------------------------------------------------------------


def runs(spark, sf):
    """Events as pipeline runs."""
    v = F.col("value")
    status = (
        F.when(F.col("event_type") == "error", "Failed").when(v > 150, "Retrying").when(v < 5, "Running")
        .otherwise("Success")
    )
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("pipe"), F.col("user_id")).alias("pipeline"), F.col("ts").alias("started"),
        status.alias("status"), v.alias("duration"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id, 'pipe' || user_id AS pipeline, ts AS started, value AS duration,
         CASE WHEN event_type = 'error' THEN 'Failed' WHEN value > 150 THEN 'Retrying' WHEN value < 5 THEN 'Running'
              ELSE 'Success' END AS status FROM events)"""


@R.add(f"WITH {RUNS_SQL} SELECT status, count(*) AS runs FROM runs GROUP BY ALL")
def run_status(spark, sf):
    return monitoring.run_status(runs(spark, sf))


@R.add(f"""WITH {RUNS_SQL}
SELECT pipeline, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, status, round(duration, 6) AS duration,
       CASE WHEN status = 'Failed' THEN 'r' WHEN status IN ('Retrying', 'Running') THEN 'a' ELSE 'g' END AS light
FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started DESC, event_id DESC) = 1""")
def pipeline_board(spark, sf):
    board = monitoring.pipeline_board(runs(spark, sf), ["event_id"])
    return rounded(board.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss")))


@R.add("""
WITH last AS (SELECT user_id, max(CASE WHEN value < 100 THEN ts END) AS seen FROM events GROUP BY ALL),
s AS (SELECT CASE WHEN seen IS NULL THEN 'offline'
        WHEN date_diff('second', date_trunc('second', seen), TIMESTAMP '2024-01-30 12:00:00') > 300 THEN 'stale'
        ELSE 'online' END AS state FROM last)
SELECT count(*) AS total, count(*) FILTER (state = 'online') AS online, count(*) FILTER (state = 'stale') AS stale,
       count(*) FILTER (state = 'offline') AS offline FROM s""")
def site_status(spark, sf):
    """Users as sites; large values do not count as reports."""
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("value") < 100, F.col("ts"))).alias("at"))
    noon = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return monitoring.site_totals(last.select(monitoring.site_state(F.col("at"), noon).alias("state")))


@R.add(f"""WITH {RUNS_SQL},
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started DESC, event_id DESC) = 1)
SELECT 'P' || (CAST(substr(pipeline, 5) AS BIGINT) % 4) AS site,
       count(*) FILTER (status IN ('Success', 'Running')) AS components_up, count(*) AS components
FROM last GROUP BY 1""")
def site_health(spark, sf):
    """Components of a site that are up."""
    board = monitoring.pipeline_board(runs(spark, sf), ["event_id"])
    parts = board.select(
        F.concat(F.lit("P"), F.substring("pipeline", 5, 20).cast("bigint") % 4).alias("site"),
        F.when(F.col("status") == "Success", "Connected").when(F.col("status") == "Running", "Degraded")
        .otherwise("Error").alias("status"),
    )
    return monitoring.component_health(parts, ["site"])


@R.add(f"""WITH {RUNS_SQL}
SELECT 'Healthy pipelines' AS key, count(DISTINCT pipeline) FILTER (status = 'Running') AS value, 'ok' AS tone FROM runs
UNION ALL SELECT 'Failed (24h)', count(*) FILTER (status = 'Failed'), 'fail' FROM runs
UNION ALL SELECT 'Catalog assets', count(*), '' FROM documents
UNION ALL SELECT 'Open alerts', count(*), 'warn' FROM labels WHERE toxic = 1""")
def kpi_tiles(spark, sf):
    r = runs(spark, sf)
    connectors = r.groupBy("pipeline").agg(F.max(F.when(F.col("status") == "Running", "Running")).alias("state"))
    alerts = table(spark, sf, "labels").filter("toxic = 1")
    return monitoring.kpi_tiles(connectors, r, table(spark, sf, "documents"), alerts)


@R.add(f"""WITH {RUNS_SQL}
SELECT event_id, pipeline, status FROM runs ORDER BY started DESC, event_id DESC LIMIT 5""")
def recent_runs(spark, sf):
    return monitoring.recent_runs(runs(spark, sf), tie=["event_id"]).select("event_id", "pipeline", "status")


@R.add("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type AS level,
       CASE WHEN value > 50 THEN 'svc' || user_id ELSE '' END AS service, 'user ' || user_id AS message
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def log_search(spark, sf):
    """Events as JSON log lines; level and service are found under their second names."""
    e = table(spark, sf, "events")
    doc = F.to_json(F.struct(
        F.struct(F.col("event_type").alias("level")).alias("log"),
        F.when(F.col("value") > 50, F.concat(F.lit("svc"), "user_id")).alias("container"),
        F.concat(F.lit("user "), "user_id").alias("message"),
    ))
    lines = e.select("event_id", "ts", doc.alias("doc"))
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    found = monitoring.log_search(lines, "doc", time, "ERROR", tie=["event_id"])
    return found.withColumn("time", F.substring("time", 1, 19))


# --- matching --------------------------------------------------------------------------------


def two_systems(spark, sf):
    """Suppliers and a copy with changed spelling; debtors are missing from the copy."""
    s = table(spark, sf, "supplier")
    typo = F.when(F.col("s_acctbal") > 5000, F.regexp_replace("s_name", "Supplier", "Suplier")).when(
        F.col("s_acctbal") > 4000, F.lit("unknown")
    )
    other = s.filter("s_acctbal >= 0").select(
        F.concat(F.lit("E"), F.col("s_suppkey")).alias("e_id"),
        F.lower(F.replace(F.coalesce(typo, F.col("s_name")), F.lit("#"), F.lit(" - "))).alias("e_name"),
        F.col("s_nationkey").alias("e_nation"),
        F.floor("s_acctbal").alias("e_balance"),
    )
    mine = s.withColumn("s_balance", F.floor("s_acctbal"))
    return mine, other


SYSTEMS_SQL = """l AS (SELECT s_suppkey AS left_id, s_nationkey AS nat, floor(s_acctbal) AS bal,
        regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS nm FROM supplier),
r AS (SELECT 'E' || s_suppkey AS right_id, s_nationkey AS nat, floor(s_acctbal) AS bal,
        regexp_replace(upper(CASE WHEN s_acctbal > 5000 THEN replace(s_name, 'Supplier', 'Suplier')
          WHEN s_acctbal > 4000 THEN 'unknown' ELSE s_name END), '[^A-Z0-9]', '', 'g') AS nm
      FROM supplier WHERE s_acctbal >= 0),
pairs AS (SELECT left_id, right_id, 1 - levenshtein(l.nm, r.nm)::DOUBLE / greatest(length(l.nm), length(r.nm)) AS sim
          FROM l JOIN r USING (nat, bal)),
exact AS (SELECT left_id, right_id, 1.0::DOUBLE AS sim FROM l JOIN r ON l.nm = r.nm AND l.nat = r.nat),
m AS (SELECT left_id, right_id, max(sim) AS confidence
      FROM (SELECT * FROM pairs WHERE sim >= 0.85 UNION ALL SELECT * FROM exact) GROUP BY ALL)"""
TERMS = [
    matching.Term("s_nationkey", "e_nation"),
    matching.Term("s_balance", "e_balance"),
    matching.Term("s_name", "e_name", "similarity", 0.85),
]
MATCH_RULES = [TERMS, [matching.Term("s_nationkey", "e_nation"), matching.Term("s_name", "e_name", "normalized")]]


@R.add(f"""WITH {SYSTEMS_SQL}
SELECT left_id, right_id, round(confidence, 6) AS confidence, 1 AS left_records,
       sha256('entity:' || left_id) AS global_id FROM m""")
def entity_match(spark, sf):
    mine, other = two_systems(spark, sf)
    return rounded(matching.match(mine, other, "s_suppkey", "e_id", MATCH_RULES))


@R.add(f"""WITH {SYSTEMS_SQL}
SELECT 'left' AS side, CAST(left_id AS VARCHAR) AS native_id, 'unmatched' AS issue FROM l
  WHERE left_id NOT IN (SELECT left_id FROM m)
UNION ALL SELECT 'right', right_id, 'unmatched' FROM r WHERE right_id NOT IN (SELECT right_id FROM m)
UNION ALL SELECT 'left', CAST(left_id AS VARCHAR), 'one-to-many' FROM m GROUP BY left_id HAVING count(*) > 1
UNION ALL SELECT 'right', right_id, 'one-to-many' FROM m GROUP BY right_id HAVING count(*) > 1
UNION ALL SELECT 'left', CAST(left_id AS VARCHAR), 'low-confidence' FROM pairs GROUP BY left_id HAVING max(sim) < 0.85""")
def entity_conflicts(spark, sf):
    mine, other = two_systems(spark, sf)
    return matching.conflicts(mine, other, "s_suppkey", "e_id", MATCH_RULES)


@R.add("""
WITH o AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
s AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT o_orderkey FROM o WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.k = o.k AND s.d BETWEEN o.d - INTERVAL 30 DAY AND o.d + INTERVAL 30 DAY)""")
def entity_window(spark, sf):
    """Orders without a shipment within thirty days."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("shipped"))
    return matching.without_partner_near(o, s, ["k"], "d", "shipped", 30).select("o_orderkey")


# --- sensitive content and standards ---------------------------------------------------------


def sensitive_sql(name, columns):
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, '{level}' AS suggested_level,
        count(*) FILTER (regexp_matches({c}, '{rx}')) AS hits,
        round(count(*) FILTER (regexp_matches({c}, '{rx}'))::DOUBLE / count(*), 6) AS confidence FROM {name}"""
        for c in columns
        for kind, rx, level, _ in quality.SENSITIVE_PATTERNS
    )


SCAN_SQL = f"""scan AS (SELECT * FROM ({sensitive_sql("documents", ["text", "lang", "source"])}
UNION ALL {sensitive_sql("conversations", ["role", "text"])} UNION ALL {sensitive_sql("pages", ["url", "html"])})
WHERE hits > 0)"""


def full_scan(spark, sf):
    out = None
    for name in ("documents", "conversations", "pages"):
        found = quality.sensitive_scan(table(spark, sf, name), name)
        out = found if out is None else out.unionByName(found)
    return out


@R.add(f"WITH {SCAN_SQL} SELECT * FROM scan")
def sensitive_scan(spark, sf):
    """Patterns over the whole texts of documents, conversations and pages."""
    return rounded(full_scan(spark, sf))


@R.add(f"WITH {SCAN_SQL} SELECT suggested_level, count(*) AS assets FROM scan GROUP BY ALL")
def sensitivity_distribution(spark, sf):
    return quality.level_distribution(full_scan(spark, sf), "suggested_level")


STANDARDS = {
    "events": [
        quality.DomainStandard("event_type", "event_type IN ('click', 'view', 'signup', 'purchase')", "event codes"),
        quality.DomainStandard("value", "value >= 0", "never negative"),
    ],
    "customer": [
        quality.DomainStandard("c_acctbal", "c_acctbal >= 0", "never negative"),
        quality.DomainStandard("c_name", "c_name RLIKE '^Customer#[0-9]{9}$'", "customer code"),
    ],
}
STANDARDS_SQL = """std AS (
  SELECT 'events' AS table_name, 'event_type' AS column_name, 'event codes' AS standard,
         count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'purchase')) AS failed_rows FROM events
  UNION ALL SELECT 'events', 'value', 'never negative', count(*) FILTER (value < 0) FROM events
  UNION ALL SELECT 'customer', 'c_acctbal', 'never negative', count(*) FILTER (c_acctbal < 0) FROM customer
  UNION ALL SELECT 'customer', 'c_name', 'customer code',
    count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) FROM customer)"""


def all_domains(spark, sf):
    out = None
    for name, standards in STANDARDS.items():
        found = quality.domain_violations(table(spark, sf, name), name, standards)
        out = found if out is None else out.unionByName(found)
    return out


@R.add(f"WITH {STANDARDS_SQL} SELECT *, failed_rows = 0 AS compliant FROM std")
def standards_check(spark, sf):
    return all_domains(spark, sf)


@R.add("""
SELECT 'fact_orders' AS table_name, 'OrderDate' AS column_name, 'lower_snake_case' AS standard,
       'Rename to order_date' AS fix, count(*) AS affected_rows FROM orders WHERE o_orderdate IS NOT NULL
UNION ALL SELECT 'fact_orders', 'o_custkey', 'type standard', 'Use string instead of bigint', count(o_custkey) FROM orders
UNION ALL SELECT 'fact_orders', 'o_orderkey', 'type standard', 'Use string instead of bigint', count(o_orderkey) FROM orders
UNION ALL SELECT 'customers', 'c_custkey', 'type standard', 'Use string instead of bigint', count(c_custkey) FROM customer
UNION ALL SELECT 'customers', 'c_nationkey', 'type standard', 'Use string instead of int', count(c_nationkey) FROM customer
UNION ALL SELECT 'customers', '', 'table prefix', 'Use one of dim_, fact_', count(*) FROM customer""")
def naming_standards(spark, sf):
    """Names and types that break the standards, with the number of values they concern."""
    tables = {
        "fact_orders": table(spark, sf, "orders").withColumnRenamed("o_orderdate", "OrderDate"),
        "customers": table(spark, sf, "customer"),
    }
    schema = quality.schema_frame(tables)
    found = quality.naming_violations(schema).unionByName(quality.type_violations(schema, [("key$", "string")]))
    counts = None
    for name, df in tables.items():
        cells = [F.struct(F.lit(name).alias("table_name"), F.lit("").alias("column_name"), F.count("*").alias("affected_rows"))]
        for c in df.columns:
            cells.append(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.count(c).alias("affected_rows")))
        part = df.agg(F.array(*cells).alias("a")).select(F.inline("a"))
        counts = part if counts is None else counts.unionByName(part)
    return found.join(counts, ["table_name", "column_name"])


@R.add(f"""WITH {STANDARDS_SQL}
SELECT table_name, count(*) AS violations, string_agg(column_name, ', ' ORDER BY column_name) AS fields
FROM std WHERE failed_rows > 0 GROUP BY ALL""")
def standard_impact(spark, sf):
    return quality.standard_impact(all_domains(spark, sf).filter("NOT compliant"))


@R.add("""
WITH a AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY ALL),
b AS (SELECT c_custkey AS k, count(*) AS r FROM customer WHERE c_acctbal > 100 GROUP BY ALL),
j AS (SELECT l, r FROM a FULL JOIN b USING (k)),
x AS (SELECT count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right,
       count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared_members,
       coalesce(max(l), 0) AS left_rows_per_member, coalesce(max(r), 0) AS right_rows_per_member FROM j)
SELECT *, round(shared_members::DOUBLE / (shared_members + only_left + only_right), 6) AS overlap,
       left_rows_per_member <> right_rows_per_member AS different_grain FROM x""")
def dimension_overlap(spark, sf):
    customers = table(spark, sf, "customer").filter("c_acctbal > 100")
    return rounded(quality.dimension_overlap(table(spark, sf, "orders"), customers, "o_custkey", "c_custkey"))


@R.add("""
SELECT 'Order fulfilment' AS process, count(*) AS date, count(c_custkey) AS customer, 0 AS part, 0 AS supplier
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'Shipment', count(*), 0, count(p_partkey), count(s_suppkey)
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def bus_matrix(spark, sf):
    """Which process uses which dimension, counted over all fact rows."""
    from plumbline.scale import lookup_join

    def used(process, fact, key, dimension, dim, dim_key):
        members = dim.select(F.col(dim_key).alias(key), F.lit(1).alias("_hit"))
        hits = lookup_join(fact.select(key), members, [key]).agg(F.count("_hit").alias("used_rows"))
        return hits.select(F.lit(process).alias("process"), F.lit(dimension).alias("dimension"), "used_rows")

    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    days = [
        df.agg(F.count(c).alias("used_rows")).select(F.lit(p).alias("process"), F.lit("date").alias("dimension"), "used_rows")
        for df, c, p in ((o, "o_orderdate", "Order fulfilment"), (i, "l_shipdate", "Shipment"))
    ]
    usage = (
        days[0].unionByName(days[1])
        .unionByName(used("Order fulfilment", o, "o_custkey", "customer", table(spark, sf, "customer"), "c_custkey"))
        .unionByName(used("Shipment", i, "l_partkey", "part", table(spark, sf, "part"), "p_partkey"))
        .unionByName(used("Shipment", i, "l_suppkey", "supplier", table(spark, sf, "supplier"), "s_suppkey"))
    )
    return quality.bus_matrix(usage, ["date", "customer", "part", "supplier"])
