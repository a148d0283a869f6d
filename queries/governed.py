"""Structured queries, contracts, policies, audit and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog, daily, monitoring, policy, spec
from plumbline.scale import materialise, shared_dir
from plumbline.sources import scans
from queries.roles import RECORDS_SQL, Registry, records, rounded, table

R = Registry()


def source(spark, sf):
    return lambda name: table(spark, sf, name)


REVENUE = spec.QuerySpec(
    "orders",
    dimensions=["o_orderstatus", "o_orderpriority"],
    measures=[("o_totalprice", "sum"), ("o_totalprice", "avg"), ("O_TOTALPRICE", "max"), ("*", "count")],
    filters=[("o_totalprice", ">=", 1000.0), ("o_orderpriority", "like", "%-%"), ("o_orderstatus", "in", ["O", "F"])],
    order_by=[("sum_o_totalprice", "desc"), ("o_orderpriority", "asc")],
)
REVENUE_SQL = """SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 4) AS sum_o_totalprice,
  round(avg(o_totalprice), 4) AS avg_o_totalprice, round(max(o_totalprice), 4) AS "max_O_TOTALPRICE", count(*) AS count
FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority LIKE '%-%' AND o_orderstatus IN ('O', 'F') GROUP BY ALL"""


@R.add(REVENUE_SQL)
def query_spec(spark, sf):
    return rounded(spec.build_query(table(spark, sf, "orders"), REVENUE), 4)


@R.add(f"""WITH q AS ({REVENUE_SQL})
SELECT o_orderpriority AS "group", o_orderstatus AS key, sum_o_totalprice AS value FROM q
UNION ALL SELECT o_orderpriority, o_orderstatus, avg_o_totalprice FROM q
UNION ALL SELECT o_orderpriority, o_orderstatus, "max_O_TOTALPRICE" FROM q
UNION ALL SELECT o_orderpriority, o_orderstatus, count FROM q""")
def chart_series(spark, sf):
    return rounded(spec.chart_series(spec.build_query(table(spark, sf, "orders"), REVENUE), REVENUE), 4)


WIDGETS = [
    spec.Widget("empty", "Not configured", spec.QuerySpec()),
    spec.Widget(
        "flags", "Rows by flag",
        spec.QuerySpec("lineitem", ["l_returnflag"], [("l_quantity", "sum"), ("*", "count")]),
    ),
    spec.Widget("broken", "Unknown column", spec.QuerySpec("lineitem", ["nope"], [("*", "count")])),
    spec.Widget("status", "Orders by status", spec.QuerySpec("orders", ["o_orderstatus"], [("*", "count")])),
]


@R.add("""
SELECT 'flags' AS widget, 'sum_l_quantity' AS "group", l_returnflag AS key, round(sum(l_quantity), 4) AS value,
       CAST(NULL AS VARCHAR) AS error FROM lineitem GROUP BY ALL
UNION ALL SELECT 'flags', 'count', l_returnflag, count(*), NULL FROM lineitem GROUP BY ALL
UNION ALL SELECT 'status', 'count', o_orderstatus, count(*), NULL FROM orders GROUP BY ALL
UNION ALL SELECT 'broken', NULL, NULL, NULL, 'the dataset has no column named ' || chr(39) || 'nope' || chr(39)""")
def dashboard_widgets(spark, sf):
    return rounded(spec.dashboard_frame(spark, spec.run_dashboard(WIDGETS, source(spark, sf))), 4)


@R.add("""SELECT l_returnflag, round(sum(l_quantity), 4) AS sum_l_quantity, count(*) AS count FROM lineitem GROUP BY ALL""")
def report_result(spark, sf):
    return rounded(spec.report_frame(source(spark, sf), widgets=WIDGETS), 4)


@R.add("""SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders
WHERE o_orderstatus != 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_n(spark, sf):
    """Raw projection, sorted and limited."""
    top = spec.QuerySpec(
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"], filters=[("o_orderstatus", "!=", "P")],
        order_by=[("o_totalprice", "desc"), ("o_orderkey", "asc")], limit=25,
    )
    return rounded(spec.build_query(table(spark, sf, "orders"), top))


CONTRACT = spec.DataContract(
    columns={"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance"},
    filters=[
        spec.ContractFilter("c_mktsegment", ["in"], required=True),
        spec.ContractFilter("c_acctbal", [">=", "<"], default="0"),
    ],
    max_size=1000,
    sortable=["balance", "id"],
)


@R.add("""SELECT c_custkey AS id, c_mktsegment AS segment, round(c_acctbal, 6) AS balance FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 1000""")
def data_contract(spark, sf):
    """Published endpoint: the caller asks for as many rows as a page may hold."""
    asked = {"segment": "BUILDING, MACHINERY,", "_limit": "1000", "_sort": "-balance,id"}
    return rounded(spec.serve_contract(table(spark, sf, "customer"), CONTRACT, asked))


def policies(spark, sf):
    """Subjects and policies. The row filters follow the customers' nations."""
    subject = spark.createDataFrame(
        [("s1", "quality"), ("s2", "sales"), ("s3", "audit")], "subject_id string, group_name string"
    )
    row = spark.createDataFrame(
        [("s1", "customer", "c_nationkey < 10", True), ("s1", "customer", "c_acctbal > 0", True),
         ("s2", "customer", "c_mktsegment = 'BUILDING'", True), ("s1", "customer", "false", False),
         ("s1", "orders", "false", True)],
        "subject_id string, table_name string, filter_expr string, enabled boolean",
    )
    column = spark.createDataFrame(
        [("s1", "customer", "c_name", "hash", None, True), ("s1", "customer", "c_acctbal", "deny", None, True),
         ("s2", "customer", "c_mktsegment", "full", None, True),
         ("s2", "customer", "c_name", "partial", "concat(substr({col}, 1, 3), '****')", True),
         ("s3", "customer", "c_name", "none", None, True)],
        "subject_id string, table_name string, column_name string, mask_type string, mask_expr string, enabled boolean",
    )
    return policy.PolicyTables(subject, row, column)


@R.add("""SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_nationkey < 10 AND c_acctbal > 0 GROUP BY ALL""")
def row_policy(spark, sf):
    """Row filters hold although the query joins and groups the governed relation."""
    governed = policy.govern(
        table(spark, sf, "customer"), policy.Decision(row_filters=["c_nationkey < 10", "c_acctbal > 0"])
    )
    nations = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return governed.join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"))


@R.add("""SELECT c_custkey, upper(sha256(c_name)) AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CAST(NULL AS DOUBLE) AS c_acctbal, '***' AS c_mktsegment FROM customer""")
def column_masks(spark, sf):
    masks = [policy.Mask("C_NAME", "hash"), policy.Mask("c_acctbal", "deny"), policy.Mask("c_mktsegment", "full")]
    return rounded(policy.govern(table(spark, sf, "customer"), policy.Decision(masks=masks)))


@R.add("""SELECT c_custkey, substr(c_name, 1, 3) || '****' AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  round(c_acctbal, 6) AS c_acctbal, '***' AS c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def preview_as(spark, sf):
    """What a member of the sales group sees, with policies read from their tables."""
    return rounded(policy.preview_as(table(spark, sf, "customer"), policies(spark, sf), ["sales"], "customer"))


@R.add("""SELECT 'alice' AS subject_ref, 'customers' AS raw, 'spark' AS engine, count(*) AS answered_rows FROM customer
UNION ALL SELECT 'bob', 'rich customers', 'spark', count(*) FROM customer WHERE c_acctbal > 0""")
def audit_append(spark, sf):
    """Two governed queries, each of which leaves its record in the audit table."""
    path = shared_dir(spark, "audit")
    c = table(spark, sf, "customer")
    answer = lambda df: materialise(df, "answer")
    policy.append_audit(policy.govern(c, policy.Decision()), path, "alice", "customers", answer)
    rich = policy.govern(c, policy.Decision(row_filters=["c_acctbal > 0"]))
    policy.append_audit(rich, path, "bob", "rich customers", answer)
    return spark.read.parquet(path).select("subject_ref", "raw", "engine", "answered_rows")


# A result of many groups comes back whole.
WIDE = spec.QuerySpec("lineitem", dimensions=["l_orderkey"], measures=[("l_quantity", "sum"), ("*", "count")])


@R.add("SELECT l_orderkey, round(sum(l_quantity), 4) AS sum_l_quantity, count(*) AS count FROM lineitem GROUP BY ALL")
def query_spec_whole(spark, sf):
    """More than ten thousand groups, none of them cut."""
    return rounded(spec.build_query(table(spark, sf, "lineitem"), WIDE))


@R.add("""SELECT s_suppkey, s_nationkey::BIGINT AS tenant FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 7""")
def tenant_scope(spark, sf):
    """Suppliers with a debit balance count as shared."""
    s = table(spark, sf, "supplier")
    owned = s.withColumn("tenant_id", F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("string")))
    return rounded(policy.for_tenant(owned, "7").select("s_suppkey", F.col("s_nationkey").alias("tenant")))


@R.add("""
WITH lv AS (SELECT source, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS r
            FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, ['Public', 'Internal', 'Confidential', 'Restricted'][max(r) + 1] AS sensitivity,
       max(r) < 2 AS releasable, count(*) FILTER (r < 2) AS releasable_documents
FROM lv GROUP BY source""")
def release_filter(spark, sf):
    """Highest sensitivity per source, and how many documents may leave."""
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    level = (
        F.when(F.col("toxic") == 1, "Restricted").when(F.col("quality") == 0, "Confidential")
        .when(F.col("quality") == 1, "Internal").otherwise("Public")
    )
    labelled = docs.withColumn("label", level)
    best = policy.highest_level(labelled, ["source"], "label")
    free = labelled.groupBy("source").agg(F.count_if(policy.releasable(F.col("label"))).alias("releasable_documents"))
    out = best.withColumn("releasable", policy.releasable(F.col("sensitivity")))
    return out.join(free, "source")


@R.add("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10 AND c_acctbal > 0 AND c_mktsegment = 'BUILDING'
ORDER BY c_custkey LIMIT 200""")
def governed_sample(spark, sf):
    """Sample of a governed relation with a free predicate; row counts beyond the maximum are refused."""
    governed = policy.govern(
        table(spark, sf, "customer"), policy.Decision(row_filters=["c_nationkey < 10", "c_acctbal > 0"])
    )
    policy.require_gold("gold_quality")
    ordered = governed.orderBy("c_custkey")
    return policy.sample(ordered, "c_mktsegment = 'BUILDING'", 200).select("c_custkey", "c_name")


@R.add("""SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20""")
def dataset_sample(spark, sf):
    return scans.sample_rows(table(spark, sf, "orders").orderBy("o_orderkey")).select("o_orderkey")


def audit(spark, sf):
    """Every event as one query of the audit trail."""
    e = table(spark, sf, "events")
    named = F.concat(F.lit("SELECT * FROM Gold."), F.upper("event_type"), F.lit(" WHERE user_id = "), F.col("user_id"))
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("subject_ref"), named.alias("raw"),
        F.when(F.col("value") > 100, "REFRESH gold.click").otherwise("").alias("rewritten"),
        F.col("ts").alias("decided_at"),
    )


@R.add("""SELECT CAST(ts AS DATE) AS day, count(*) AS queries FROM events
WHERE event_type = 'click' OR value > 100 GROUP BY ALL""")
def audit_usage(spark, sf):
    return catalog.usage_by_day(audit(spark, sf), "gold.click")


@R.add("""SELECT event_id, CAST(user_id AS VARCHAR) AS subject_ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS decided_at
FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""")
def audit_recent(spark, sf):
    last = catalog.recent_audit(audit(spark, sf), tie=["event_id"])
    return last.select("event_id", "subject_ref", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"))


METRICS = [
    monitoring.Metric("qualified rate", "sum(qualified_count) / sum(total_analyses) * 100", "daily_summary", "%"),
    monitoring.Metric("defect rate", "sum(unqualified_count) / sum(total_analyses) * 100", "qualification", "%"),
    monitoring.Metric("worst shift rate", "max(unqualified_rate)", "qualification", "%", "Review"),
    monitoring.Metric("revenue", "sum(o_totalprice)", "orders", "USD"),
]


@R.add(f"""WITH {RECORDS_SQL},
q AS (SELECT process_id, shift, analysis_date, count(*) AS n, count(*) FILTER (overall_judgment = 'NG') AS ng
      FROM rec GROUP BY ALL)
SELECT 'qualified rate' AS metric, 'daily_summary' AS source, '%' AS unit, 'Certified' AS status,
       round(count(*) FILTER (overall_judgment = 'OK') * 100.0::DOUBLE / count(*), 4) AS value FROM rec
UNION ALL SELECT 'defect rate', 'qualification', '%', 'Certified', round(sum(ng) * 100.0::DOUBLE / sum(n), 4) FROM q
UNION ALL SELECT 'worst shift rate', 'qualification', '%', 'Review', round(max(ng * 100.0::DOUBLE / n), 4) FROM q
UNION ALL SELECT 'revenue', 'orders', 'USD', 'Certified', round(sum(o_totalprice), 4) FROM orders""")
def metric_registry(spark, sf):
    """Metric formulas evaluated over their source tables."""
    rec = records(spark, sf)
    sources = {
        "daily_summary": daily.daily_summary(rec),
        "qualification": daily.nonconformance_daily(rec),
        "orders": table(spark, sf, "orders"),
    }
    return rounded(monitoring.evaluate_metrics(METRICS, sources.__getitem__), 4)


@R.add("""SELECT p_name AS name, max(p_partkey) AS version FROM part WHERE p_type <> 'SMALL' GROUP BY p_name""")
def published_terms(spark, sf):
    """Newest published definition per name; small parts play the drafts."""
    p = table(spark, sf, "part")
    terms = p.select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("version"),
        F.when(F.col("p_type") == "SMALL", "Draft").otherwise("Certified").alias("status"),
    )
    return monitoring.published(terms).select("name", "version")
