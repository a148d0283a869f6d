"""Layer jobs: raw, bronze, silver, gold and serving, with their state and writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import cleansing as cl
from plumbline.operators import scd, star, upsert, watermark
from plumbline.plans import bronze, gold, model, serving, silver
from plumbline.scale import materialise, shared_dir
from plumbline.sources import scans, sinks, versions
from plumbline.streaming import cdc
from queries.roles import (
    MEASUREMENTS_SQL,
    RECORDS_SQL,
    SHIFT_SQL,
    Registry,
    measurements,
    records,
    rounded,
    shift,
    table,
)

R = Registry()
NOW = dt.datetime(2024, 2, 1)


def now():
    return F.lit(NOW).cast("timestamp")


def iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- cleansing -------------------------------------------------------------------------------


@R.add("""
SELECT p_partkey, trim(p_name) AS p_name, upper(trim(p_brand)) AS p_brand, lower(p_type) AS p_type_lower,
       substring(p_name, 1, 10) AS name_start, replace(p_brand, '#', '') AS brand_plain,
       concat_ws('|', p_brand, p_type) AS joined, p_name LIKE '%ring%' AS is_ring, p_name ILIKE '%RED%' AS is_red,
       regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')
         AS identifier,
       len(list_filter(list_transform(string_split(p_name || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''))
         AS items,
       string_split(p_brand || '.' || p_type || '.' || p_name, '.')[-1] AS last_part,
       array_to_string(string_split(p_brand || '.' || p_type || '.' || p_partkey, '.')[-2:], '.') AS last_two,
       list_reduce(list_filter(regexp_split_to_array(p_name || ' or ' || p_type, '[^a-zA-Z0-9_]+'), lambda t: t <> ''),
         lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest,
       'p' || p_size AS platform, 'parts.' || replace(p_brand, '#', '') AS namespace, 't' || p_partkey AS table_name,
       sha256(p_name) AS digest, upper(sha256(p_brand)) AS digest_upper, nullif(p_type, 'SMALL') AS type_or_null,
       printf('%s(%d)', p_brand, p_size) AS label
FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> ''""")
def clean_strings(spark, sf):
    raw = cl.require(cl.tidy(table(spark, sf, "part"), ["p_name"]), ["p_name"], ["p_name"])
    brand, kind, name = F.col("p_brand"), F.col("p_type"), F.col("p_name")
    urn = F.format_string(
        "urn:x:dataset:(urn:x:platform:p%d,parts.%s.t%d,PROD)", F.col("p_size"), F.replace(brand, F.lit("#"), F.lit("")), F.col("p_partkey")
    )
    out = raw.select(
        "p_partkey", "p_name", F.upper(F.trim(brand)).alias("p_brand"), F.lower(kind).alias("p_type_lower"),
        F.substring(name, 1, 10).alias("name_start"), F.replace(brand, F.lit("#"), F.lit("")).alias("brand_plain"),
        F.concat_ws("|", brand, kind).alias("joined"), name.like("%ring%").alias("is_ring"),
        name.ilike("%RED%").alias("is_red"),
        cl.safe_identifier(F.concat(brand, F.lit(" / "), kind)).alias("identifier"),
        F.size(cl.list_items(F.concat(name, F.lit(", ,"), brand))).alias("items"),
        F.element_at(F.split(F.concat(brand, F.lit("."), kind, F.lit("."), name), r"\."), -1).alias("last_part"),
        cl.last_parts(F.concat_ws(".", brand, kind, "p_partkey")).alias("last_two"),
        cl.longest_token(F.concat(name, F.lit(" or "), kind)).alias("longest"),
        *[cl.urn_parts(urn)[a].alias(b) for a, b in (("platform", "platform"), ("namespace", "namespace"), ("table", "table_name"))],
        F.sha2(name, 256).alias("digest"), cl.sha_upper(brand).alias("digest_upper"),
        F.nullif(kind, F.lit("SMALL")).alias("type_or_null"),
        F.format_string("%s(%d)", brand, F.col("p_size")).alias("label"),
    )
    return rounded(out)


@R.add("""
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_millis,
       CAST(ts AS DATE) AS from_days, strftime(ts, '%Y%m%d') AS day_key,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_day_and_millis,
       CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d,
       CAST(CAST(ts AS DATE) + INTERVAL 7 DAY AS DATE) AS week_later, last_day(ts) AS month_end,
       strftime(ts, '%H:%M') AS clock,
       printf('%dm %02ds', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) AS duration,
       CAST(NULL AS DATE) AS unreadable
FROM events""")
def clean_datetimes(spark, sf):
    e = table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    day = F.unix_date(F.to_date("ts"))
    feed = e.select("event_id", "ts", "value", ms.alias("ms"), day.alias("days"), (ms % 86_400_000).alias("ms_of_day"))
    seconds = F.floor("value").cast("bigint")
    back = cl.millis_to_timestamp(F.col("ms"))
    out = feed.select(
        "event_id", iso(back).alias("from_millis"), cl.as_date(feed, "days").alias("from_days"),
        cl.day_key(cl.days_to_date(F.col("days"))).alias("day_key"),
        iso(cl.date_and_millis(cl.days_to_date(F.col("days")), F.col("ms_of_day"))).alias("from_day_and_millis"),
        F.year(back).alias("y"), F.month(back).alias("m"), F.dayofmonth(back).alias("d"),
        F.date_add(F.to_date(back), 7).alias("week_later"), F.last_day(back).alias("month_end"),
        F.date_format(back, "HH:mm").alias("clock"),
        F.format_string("%dm %02ds", F.floor(seconds / 60), seconds % 60).alias("duration"),
        F.try_to_date(F.concat(F.lit("x"), F.col("days").cast("string"))).alias("unreadable"),
    )
    return rounded(out)


@R.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(CAST(CAST(l_extendedprice AS DECIMAL(14,4)) AS DOUBLE), 6) AS price_fixed,
       round(abs(l_discount - l_tax), 6) AS gap, round(sqrt(l_quantity), 6) AS root, least(l_discount, l_tax) AS low,
       l_partkey // 7 AS seventh, CAST(round(l_quantity / 4) AS BIGINT) AS quarter_lots,
       coalesce(round(l_extendedprice / nullif(l_tax, 0), 6), -1) AS price_per_tax,
       TRY_CAST(l_returnflag AS BIGINT) AS not_a_number
FROM lineitem""")
def clean_numbers(spark, sf):
    i = table(spark, sf, "lineitem")
    c = F.col
    out = i.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        c("l_extendedprice").try_cast("decimal(14,4)").cast("double").alias("price_fixed"),
        F.abs(c("l_discount") - c("l_tax")).alias("gap"), F.sqrt("l_quantity").alias("root"),
        F.least("l_discount", "l_tax").alias("low"), F.floor(c("l_partkey") / 7).alias("seventh"),
        F.round(c("l_quantity") / 4).cast("bigint").alias("quarter_lots"),
        F.coalesce(F.try_divide("l_extendedprice", "l_tax"), F.lit(-1.0)).alias("price_per_tax"),
        c("l_returnflag").try_cast("bigint").alias("not_a_number"),
    )
    return rounded(out)


# --- raw feeds derived from the tables -------------------------------------------------------


def raw_records(spark, sf):
    e = table(spark, sf, "events")
    v, ts = F.col("value"), F.col("ts")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.unix_millis(ts.cast("timestamp")).alias("record_timestamp"),
        F.when(v >= 1, F.concat(F.lit("P"), F.col("user_id") % 4)).alias("process_id"),
        F.when(v <= 200, F.concat(F.lit("C"), F.col("user_id") % 3)).alias("category_id"),
        F.when(~v.between(100, 110), F.concat(F.lit("L"), F.col("user_id") % 5)).alias("line_id"),
        F.lit("").alias("report_description"),
        F.concat(F.lit(" u"), "user_id", F.lit(" ")).alias("submitter"),
        F.unix_millis(ts.cast("timestamp")).alias("submission_datetime"),
        F.concat(F.lit(" "), shift(ts)).alias("shift"),
        F.concat(F.lit("a"), "user_id", F.lit("  ")).alias("analyst"),
        F.when((F.col("event_type") == "error") | (v > 120), " ng").otherwise("ok ").alias("overall_judgment"),
        F.concat("event_type", F.lit("/"), "user_id", F.lit(".xlsx")).alias("source_filename"),
        F.when((F.col("event_type") == "signup") & (v > 120), "bad").otherwise(iso(ts)).alias("business_datetime"),
        F.when(~v.between(60, 61), F.to_date(ts)).alias("business_date"),
        ts.alias(bronze.INGESTED),
        F.col("event_id").alias("offset"),
    )


RAW_RECORDS_SQL = f"""raw AS (
  SELECT event_id, user_id, event_type, value, ts, {SHIFT_SQL} AS shift,
         event_type || '/' || user_id || '.xlsx' AS source_filename,
         CASE WHEN NOT value BETWEEN 60 AND 61 THEN CAST(ts AS DATE) END AS business_date,
         CASE WHEN event_type = 'signup' AND value > 120 THEN 'MISSING_TIMESTAMP'
              WHEN value < 1 THEN 'MISSING_PROCESS' WHEN value > 200 THEN 'MISSING_CATEGORY'
              WHEN value BETWEEN 100 AND 110 THEN 'MISSING_LINE' ELSE 'VALID' END AS data_quality_status
  FROM events),
brz AS (SELECT * FROM raw WHERE business_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_filename ORDER BY ts DESC, event_id DESC) = 1)"""


@R.add(f"""WITH {RAW_RECORDS_SQL}
SELECT source_filename, CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS submitter, 'a' || user_id AS analyst, shift,
       CASE WHEN event_type = 'error' OR value > 120 THEN 'NG' ELSE 'OK' END AS overall_judgment,
       strftime(ts, '%Y%m%d') AS year_month_day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS submitted,
       data_quality_status FROM brz""")
def bronze_records(spark, sf):
    out = bronze.records(raw_records(spark, sf), now())
    return out.select(
        "source_filename", "id", "submitter", "analyst", "shift", "overall_judgment", "year_month_day",
        iso("submission_datetime").alias("submitted"), "data_quality_status",
    )


@R.add(f"""WITH {RAW_RECORDS_SQL}
SELECT data_quality_status, count(*) AS rows FROM brz GROUP BY ALL""")
def quality_status_records(spark, sf):
    from plumbline.operators.quality import status_distribution

    return status_distribution(bronze.records(raw_records(spark, sf), now()))


def raw_measurements(spark, sf):
    e = table(spark, sf, "events")
    v, ts = F.col("value"), F.col("ts")
    return e.select(
        F.concat_ws("-", "event_type", "user_id", F.hour(ts)).alias("id"),
        F.col("event_id").cast("string").alias("analysis_record_id"),
        F.when(v < 250, F.unix_date(F.to_date(ts))).alias("analysis_date"),
        F.when(~v.between(30, 31), F.concat(F.lit(" T"), F.col("user_id") % 3)).alias("tank_name"),
        F.when(v > 2, F.lit("value ")).alias("item_name"),
        F.lit("g/L").alias("item_unit"),
        F.lit(" A").alias("grade"),
        F.lit(1.0).alias("process_range_min"),
        F.lit(150.0).alias("process_range_max"),
        F.lit(50.0).alias("control_point"),
        F.lit(20.0).alias("control_range_min"),
        F.lit(80.0).alias("control_range_max"),
        (F.unix_millis(ts.cast("timestamp")) % 86_400_000).alias("analysis_time"),
        F.when(~v.between(90, 92), v).alias("result_value"),
        F.when(v.between(20, 80), " ok").otherwise("ng").alias("judgment"),
        F.to_date(ts).alias("business_date"),
        ts.alias(bronze.INGESTED),
        F.col("event_id").alias("offset"),
    )


RAW_MEASUREMENTS_SQL = """raw AS (
  SELECT event_type || '-' || user_id || '-' || hour(ts) AS id, event_id, ts, value,
         CASE WHEN NOT value BETWEEN 90 AND 92 THEN value END AS result_value,
         CASE WHEN NOT value BETWEEN 30 AND 31 THEN 'T' || (user_id % 3) END AS tank_name,
         CASE WHEN value > 2 THEN 'value' END AS item_name,
         CASE WHEN value < 250 THEN CAST(ts AS DATE) END AS analysis_date,
         CASE WHEN value BETWEEN 20 AND 80 THEN 'OK' ELSE 'NG' END AS judgment
  FROM events),
brz AS (SELECT *, CASE WHEN analysis_date IS NULL THEN 'MISSING_DATE' WHEN result_value IS NULL THEN 'MISSING_VALUE'
          WHEN tank_name IS NULL THEN 'MISSING_TANK' WHEN item_name IS NULL THEN 'MISSING_ITEM' ELSE 'VALID' END
          AS data_quality_status
  FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)"""


@R.add(f"""WITH {RAW_MEASUREMENTS_SQL}
SELECT id, CAST(event_id AS VARCHAR) AS analysis_record_id, tank_name, item_name, judgment,
       round(result_value, 4) AS result_value, strftime(ts, '%Y%m%d') AS year_month_day, data_quality_status
FROM brz""")
def bronze_measurements(spark, sf):
    out = bronze.measurements(raw_measurements(spark, sf), now())
    return rounded(out.select("id", "analysis_record_id", "tank_name", "item_name", "judgment",
                              "result_value", "year_month_day", "data_quality_status"))


@R.add(f"""WITH {RAW_MEASUREMENTS_SQL}
SELECT data_quality_status, count(*) AS rows FROM brz GROUP BY ALL""")
def quality_status_measurements(spark, sf):
    from plumbline.operators.quality import status_distribution

    return status_distribution(bronze.measurements(raw_measurements(spark, sf), now()))


def raw_members(spark, sf):
    """Every order is a change image of its customer's name."""
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderpriority").startswith("4"), "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return o.select(
        F.col("o_custkey").cast("string").alias("id"),
        name.alias("name"),
        F.when(F.col("o_orderstatus") == "P", "true").otherwise("false").alias("__deleted"),
        F.col("o_orderdate").alias(bronze.INGESTED),
        F.col("o_orderkey").alias("offset"),
    )


MEMBERS_SQL = """brz AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS name, o_orderstatus = 'P' AS deleted,
         o_orderdate, o_orderkey
  FROM orders WHERE NOT starts_with(o_orderpriority, '4')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@R.add(f"WITH {MEMBERS_SQL} SELECT id, name, 'VALID' AS data_quality_status FROM brz WHERE NOT deleted")
def bronze_dimension(spark, sf):
    out = bronze.dimension(raw_members(spark, sf), now())
    return upsert.live(out).select("id", "name", "data_quality_status")


@R.add(f"""WITH {MEMBERS_SQL} SELECT id, name, deleted, strftime(o_orderdate, '%Y-%m-%d') AS seen FROM brz""")
def incremental_load(spark, sf):
    """Three incremental loads give the same table as one full load."""
    raw = raw_members(spark, sf)
    stored, state = None, watermark.empty_state(spark)
    for cut in ("1997-01-01", "1999-06-30", "2100-01-01"):
        visible = raw.filter(F.col(bronze.INGESTED) <= F.lit(cut).cast("timestamp_ntz"))
        stored, state = bronze.load(
            visible, stored, state, "members", lambda df: bronze.dimension(df, now()), ["id"], NOW
        )
        stored, state = materialise(stored), materialise(state)
    seen = F.date_format(bronze.INGESTED, "yyyy-MM-dd")
    return stored.select("id", "name", (F.col("__deleted") == "true").alias("deleted"), seen.alias("seen"))


@R.add("""
WITH m AS (SELECT event_type AS partition_key, max(ts) AS max_ts, count(*) AS processed_records
           FROM events GROUP BY ALL)
SELECT 'events' AS table_name, partition_key, strftime(max_ts, '%Y-%m-%d %H:%M:%S') AS max_ts,
       CAST(processed_records AS BIGINT) AS processed_records,
       CASE WHEN partition_key = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM m WHERE partition_key <> 'signup'""")
def watermark_state(spark, sf):
    """Marks after two batches, one failed partition and one reset partition."""
    e = table(spark, sf, "events")
    state = watermark.empty_state(spark)
    first = e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    state = watermark.advance(state, watermark.marks_by(first, "ts", "events", "event_type", NOW))
    state = watermark.advance(state, watermark.marks_by(e, "ts", "events", "event_type", NOW))
    state = watermark.mark_failed(state, "events", "error", NOW)
    state = watermark.reset(state, "partition_key = 'signup'", confirm=True)
    return state.select("table_name", "partition_key", iso("max_ts").alias("max_ts"), "processed_records", "status")


# --- row-level changes -----------------------------------------------------------------------


@R.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
  l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
  l_returnflag DESC, l_linestatus DESC) = 1""")
def latest_version(spark, sf):
    last = upsert.newest(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return rounded(last.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                               F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")))


def orders_by_day(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("d"))


@R.add("""
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders
WHERE NOT o_orderdate BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'
UNION ALL
SELECT o_orderkey, 'R', round(o_totalprice * 1.1, 6), CAST(o_orderdate AS DATE) FROM orders
WHERE o_orderdate BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' AND o_orderstatus <> 'P'""")
def replace_range(spark, sf):
    old = orders_by_day(spark, sf).drop("o_custkey")
    new = old.filter("o_orderstatus <> 'P'").withColumns(
        {"o_orderstatus": F.lit("R"), "o_totalprice": F.col("o_totalprice") * 1.1}
    )
    return rounded(upsert.replace_dates(old, new, "d", "1997-03-01", "1998-02-28"))


@R.add("""
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders
WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 480000)
UNION ALL
SELECT o_orderkey, 'X', round(o_totalprice, 6), CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 480000""")
def replace_days(spark, sf):
    old = orders_by_day(spark, sf).drop("o_custkey")
    new = old.filter("o_totalprice > 480000").withColumn("o_orderstatus", F.lit("X"))
    return rounded(upsert.replace_days_present(old, new, "d"))


LINE_NEWEST = """inc AS (
  SELECT l_orderkey AS k, l_linestatus AS status, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS created_at,
         l_returnflag AS note
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC,
    l_partkey DESC, l_linestatus DESC, l_extendedprice DESC, l_returnflag DESC) = 1),
old AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(o_orderdate AS DATE) AS created_at,
               o_orderpriority AS note FROM orders WHERE o_orderdate < DATE '1999-01-01')"""


def order_state(spark, sf):
    old = table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    i = table(spark, sf, "lineitem")
    existing = old.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("note"),
    )
    incoming = i.select(
        F.col("l_orderkey").alias("k"), "l_shipdate", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"), F.to_date("l_shipdate").alias("created_at"),
        F.col("l_returnflag").alias("note"),
    )
    return existing, incoming


VERSION = ["l_shipdate", "l_linenumber", "l_partkey"]


@R.add(f"""WITH {LINE_NEWEST}
SELECT coalesce(old.k, inc.k) AS k, coalesce(inc.status, old.status) AS status,
       round(coalesce(inc.price, old.price), 6) AS price, coalesce(old.created_at, inc.created_at) AS created_at,
       coalesce(inc.note, old.note) AS note
FROM old FULL JOIN inc ON old.k = inc.k""")
def upsert_keyed(spark, sf):
    existing, incoming = order_state(spark, sf)
    return rounded(upsert.upsert(existing, incoming, ["k"], VERSION))


@R.add(f"""WITH {LINE_NEWEST}
SELECT coalesce(old.k, inc.k) AS k, coalesce(inc.status, old.status) AS status,
       round(coalesce(inc.price, old.price), 6) AS price, coalesce(inc.created_at, old.created_at) AS created_at,
       coalesce(CASE WHEN inc.note <> 'N' THEN inc.note END, old.note) AS note
FROM old FULL JOIN inc ON old.k = inc.k""")
def coalescing_upsert(spark, sf):
    existing, incoming = order_state(spark, sf)
    blank = incoming.withColumn("note", F.when(F.col("note") == "N", "").otherwise(F.col("note")))
    return rounded(upsert.coalescing_upsert(existing, blank, ["k"], VERSION))


@R.add(f"""WITH {LINE_NEWEST}
SELECT k, status, round(price, 6) AS price FROM old
UNION ALL SELECT l_orderkey, max(l_linestatus), round(max(l_extendedprice), 6) FROM lineitem
WHERE l_orderkey NOT IN (SELECT k FROM old) GROUP BY l_orderkey""")
def insert_absent(spark, sf):
    existing, incoming = order_state(spark, sf)
    offered = incoming.groupBy("k").agg(F.max("status").alias("status"), F.max("price").alias("price"))
    return rounded(upsert.insert_absent(existing.select("k", "status", "price"), offered, ["k"]))


@R.add("""
WITH span AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
m AS (SELECT lo, hi, CAST(unnest(generate_series(date_trunc('month', lo), hi::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m
      FROM span),
b AS (SELECT greatest(m, lo) AS batch_start, least(last_day(m), hi) AS batch_end FROM m)
SELECT batch_start, batch_end, count(*) AS orders FROM b JOIN orders
  ON CAST(o_orderdate AS DATE) BETWEEN batch_start AND batch_end GROUP BY ALL""")
def month_backfill(spark, sf):
    o = orders_by_day(spark, sf)
    batches = watermark.month_batch_frame(o, "d").withColumn("m", F.trunc("batch_start", "MM"))
    counts = o.groupBy(F.trunc("d", "MM").alias("m")).agg(F.count("*").alias("orders"))
    return batches.join(counts, "m").select("batch_start", "batch_end", "orders")


REPORTS = "map_concat(from_json(props, 'map<string,double>'), map('value', value))"


def reports(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("site"), "event_id", F.col("ts").alias("at"), F.expr(REPORTS).alias("metrics"))


ROLLUPS_SQL = """roll AS (
  SELECT event_type AS site, event_id, ts, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events
  UNION ALL SELECT event_type, event_id, ts, 'value', value FROM events)"""


@R.add(f"""WITH {ROLLUPS_SQL}
SELECT site, event_id, metric, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM roll""")
def explode_metrics(spark, sf):
    out = upsert.explode_metrics(reports(spark, sf), ["site", "event_id"], "metrics", "at")
    return rounded(out.withColumn("ts", iso("ts")))


@R.add(f"""WITH {ROLLUPS_SQL}
SELECT site, metric, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM roll
QUALIFY row_number() OVER (PARTITION BY site, metric ORDER BY ts DESC, event_id DESC) = 1""")
def latest_metric(spark, sf):
    from plumbline.operators.monitoring import latest_metric as newest_value

    rows = upsert.explode_metrics(reports(spark, sf), ["site", "event_id"], "metrics", "at")
    return rounded(newest_value(rows, ["event_id"]).select("site", "metric", "value", iso("ts").alias("ts")))


# --- change-data streams ---------------------------------------------------------------------

IMAGE = (
    "id string, user_id bigint, event_type string, value double, record_timestamp bigint, analysis_date int, "
    "__deleted string"
)


def envelope(spark, sf):
    """``events`` as change-data messages; one in fifty is a delete."""
    e = table(spark, sf, "events")
    image = F.struct(
        F.col("event_id").cast("string").alias("id"), "user_id", "event_type", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("record_timestamp"),
        F.when(F.col("value") < 250, F.unix_date(F.to_date("ts"))).alias("analysis_date"),
        F.when(F.col("event_id") % 50 == 0, "true").otherwise("false").alias("__deleted"),
    )
    return e.select(
        F.lit("plant.events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.to_json(image).alias("value"),
    )


@R.add("""
SELECT CAST(event_id AS VARCHAR) AS id, user_id, event_type, round(value, 6) AS value, event_id AS "offset",
       CAST(ts AS DATE) AS business_date, strftime(ts, '%Y%m%d') AS year_month_day,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS business_datetime,
       CASE WHEN event_id % 50 = 0 THEN 'true' ELSE 'false' END AS "__deleted", 'upsert' AS cdc_operation
FROM events""")
def cdc_decode(spark, sf):
    out = cdc.route_records(cdc.decode(envelope(spark, sf), IMAGE, now()))
    return rounded(out.select("id", "user_id", "event_type", "value", "offset", "business_date", "year_month_day",
                              "business_datetime", "__deleted", "cdc_operation"))


def replay(spark, sf):
    path = shared_dir(spark, "feed")
    envelope(spark, sf).write.json(path)
    return cdc.file_source(spark, path)


@R.add("""
SELECT strftime(ts, '%Y%m%d') AS year_month_day, count(*) AS messages, count(DISTINCT event_id) AS ids,
       round(sum(value), 4) AS total FROM events WHERE value < 250 GROUP BY ALL""")
def cdc_stream_append(spark, sf):
    """Raw table after the stream has drained; undated messages are skipped."""
    routed = cdc.route_measurements(cdc.decode(replay(spark, sf), IMAGE))
    raw, checkpoint = shared_dir(spark, "raw"), shared_dir(spark, "offsets")
    cdc.append_raw(routed, raw, checkpoint, ["year_month_day"], "raw_events", available_now=True).awaitTermination()
    back = scans.day_scan(spark, raw, routed.schema)
    return back.groupBy("year_month_day").agg(
        F.count("*").alias("messages"), F.count_distinct("id").alias("ids"), F.round(F.sum("value"), 4).alias("total")
    )


@R.add("""
SELECT strftime(ts, '%Y%m%d') AS year_month_day, count(*) AS messages, count(DISTINCT event_id) AS ids,
       round(sum(value), 4) AS total FROM events WHERE value < 250 GROUP BY ALL""")
def cdc_stream_once(spark, sf):
    """As ``cdc_stream_append``, with the whole feed delivered twice and a third of it once more after a restart."""
    feed, root, checkpoints = shared_dir(spark, "feed"), shared_dir(spark, "raw"), shared_dir(spark, "offsets")
    messages = envelope(spark, sf)
    messages.unionByName(messages).write.json(feed)
    for again in (True, False):
        topics = {"events": (cdc.file_source(spark, feed), IMAGE, cdc.route_measurements, "year_month_day")}
        for query in cdc.start_routes(spark, topics, root, checkpoints, True, repeats_within="60 days").values():
            query.awaitTermination()
        if again:
            messages.where("offset % 3 = 0").write.mode("append").json(feed)
    return spark.read.parquet(f"{root}/events").groupBy(F.col("year_month_day").cast("string").alias("year_month_day")).agg(
        F.count("*").alias("messages"), F.count_distinct("id").alias("ids"), F.round(F.sum("value"), 4).alias("total")
    )


@R.add("""
SELECT user_id, CAST(event_id AS VARCHAR) AS id, event_type, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def cdc_stream_upsert(spark, sf):
    """Newest message per user, kept by a merging stream."""
    decoded = cdc.decode(replay(spark, sf), IMAGE)
    path, keys, version = shared_dir(spark, "merged"), ["user_id"], ["offset"]
    cdc.merge_stream(decoded, path, shared_dir(spark, "offsets"), keys, version, available_now=True).awaitTermination()
    return rounded(cdc.current_rows(spark, path, keys, version).select("user_id", "id", "event_type", "value"))


@R.add("""
SELECT 'facts' AS topic, strftime(ts, '%Y%m%d') AS part, count(*) AS messages FROM events WHERE value < 250 GROUP BY ALL
UNION ALL SELECT 'members', 'today', count(*) FROM events""")
def cdc_all_routes(spark, sf):
    """A fact topic by business date and a dimension topic by ingestion day, drained, and drained again to no effect."""
    topics = {
        "facts": (replay(spark, sf), IMAGE, cdc.route_measurements, "year_month_day"),
        "members": (replay(spark, sf), IMAGE, cdc.route_dimension, "dt"),
    }
    root, checkpoints = shared_dir(spark, "raw"), shared_dir(spark, "offsets")
    for _ in range(2):
        for query in cdc.start_routes(spark, topics, root, checkpoints, available_now=True).values():
            query.awaitTermination()
    facts = spark.read.parquet(f"{root}/facts").groupBy(F.col("year_month_day").cast("string").alias("part"))
    members = spark.read.parquet(f"{root}/members").groupBy(F.lit("today").alias("part"))
    return (
        facts.agg(F.count("*").alias("messages")).withColumn("topic", F.lit("facts"))
        .unionByName(members.agg(F.count("*").alias("messages")).withColumn("topic", F.lit("members")))
    )


# --- silver ----------------------------------------------------------------------------------


def dimensions(spark, sf):
    """Members seen in the events; line L4 is not registered and processes have no dimension."""
    rec = records(spark, sf)

    def members(column, surrogate):
        key = F.substring(column, 2, 9).cast("int") + 100
        return rec.select(F.col(column), key.alias(surrogate)).distinct().withColumn("is_current", F.lit(True))

    lines = members("line_id", "line_sk")
    return {
        "categories": members("category_id", "category_sk"),
        "processes": None,
        "lines": lines.withColumn("is_current", F.col("line_id") != "L4"),
        "date": star.date_dimension(star.date_span(rec, "analysis_date")),
    }


def bronze_feed(spark, sf):
    raw = cl.tidy(raw_records(spark, sf), ["analyst", "submitter", "shift"], ["overall_judgment"])
    return raw.withColumn("submission_datetime", F.timestamp_millis("submission_datetime"))


FACT_SQL = f"""fact AS (
  SELECT CAST(event_id AS VARCHAR) AS analysis_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date_key,
         CAST(NULL AS BIGINT) AS process_key,
         CASE WHEN value <= 200 THEN user_id % 3 + 100 END AS category_key,
         CASE WHEN NOT value BETWEEN 100 AND 110 AND user_id % 5 <> 4 THEN user_id % 5 + 100 END AS line_key,
         CAST(ts AS DATE) AS analysis_date, {SHIFT_SQL} AS shift,
         CASE WHEN event_type = 'error' OR value > 120 THEN 'NG' ELSE 'OK' END AS overall_judgment,
         CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day
  FROM events)"""


@R.add(f"WITH {FACT_SQL} SELECT * FROM fact")
def fact_records(spark, sf):
    fact = silver.record_fact(bronze_feed(spark, sf), dimensions(spark, sf), now())
    return rounded(fact.select("analysis_id", "date_key", "process_key", "category_key", "line_key", "analysis_date",
                               "shift", "overall_judgment", "year", "month", "day"))


@R.add(f"""WITH {FACT_SQL}
SELECT unnest(['category_key', 'process_key', 'line_key', 'date_key']) AS dimension,
       unnest([count(category_key), count(process_key), count(line_key), count(date_key)]) AS hits,
       unnest([count(*) - count(category_key), count(*) - count(process_key), count(*) - count(line_key),
               count(*) - count(date_key)]) AS misses
FROM fact""")
def lookup_misses(spark, sf):
    fact = silver.record_fact(bronze_feed(spark, sf), dimensions(spark, sf), now())
    return star.lookup_misses(fact, ["category_key", "process_key", "line_key", "date_key"])


@R.add("""
SELECT CAST(event_id AS VARCHAR) AS analysis_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS analysed,
       CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date_key,
       CASE WHEN value <= 200 THEN user_id % 3 + 100 END AS category_key,
       round(CASE WHEN NOT value BETWEEN 90 AND 92 THEN value END, 4) AS result_value,
       CAST(year(ts) AS BIGINT) AS year
FROM events WHERE value < 250 AND value > 3""")
def fact_measurements(spark, sf):
    """Values of 3 or less get an analysis date far in the past and are rejected."""
    dims = dimensions(spark, sf)
    feed = raw_measurements(spark, sf)
    shifted = F.when(F.col("result_value") <= 3, F.col("analysis_date") - 10_000).otherwise(F.col("analysis_date"))
    keys = silver.record_fact(bronze_feed(spark, sf), dims, now())
    fact = silver.measurement_fact(feed.withColumn("analysis_date", shifted.cast("int")), dims, now(), keys)
    return rounded(fact.select("analysis_id", iso("analysis_datetime").alias("analysed"), "date_key", "category_key",
                               "result_value", "year"))


@R.add("""
SELECT count(*) FILTER (value >= 250) AS missing_date, count(*) FILTER (value <= 3) AS invalid_date_range
FROM events""")
def rejected_dates(spark, sf):
    feed = raw_measurements(spark, sf)
    shifted = F.when(F.col("result_value") <= 3, F.col("analysis_date") - 10_000).otherwise(F.col("analysis_date"))
    return silver.rejected_dates(feed.withColumn("analysis_date", shifted.cast("int")))


@R.add("""
WITH d AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)),
                              INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS full_date, CAST(year(d) AS BIGINT) AS year,
       CAST(quarter(d) AS BIGINT) AS quarter, CAST(month(d) AS BIGINT) AS month, CAST(day(d) AS BIGINT) AS day,
       CAST(weekofyear(d) AS BIGINT) AS iso_week, CAST(isodow(d) AS BIGINT) AS iso_weekday, isodow(d) >= 6 AS is_weekend
FROM d""")
def date_dim(spark, sf):
    return rounded(star.date_dimension(star.date_span(table(spark, sf, "orders"), "o_orderdate")))


@R.add(f"""
WITH t AS (SELECT CAST(unnest(range(0, 1440)) AS BIGINT) AS m),
e AS (SELECT hour(ts) * 60 + minute(ts) AS m, count(*) AS n FROM events GROUP BY ALL)
SELECT m // 60 * 100 + m % 60 AS time_key, printf('%02d:%02d', m // 60, m % 60) AS full_time,
       CASE WHEN m // 60 < 8 THEN 'A' WHEN m // 60 < 16 THEN 'B' ELSE 'C' END AS shift, coalesce(n, 0) AS events
FROM t LEFT JOIN e USING (m)""")
def time_dim(spark, sf):
    """Time of day with the number of events in each minute."""
    dim = star.time_dimension(spark, [(0, "A"), (8, "B"), (16, "C")])
    ts = F.col("ts")
    used = table(spark, sf, "events").groupBy((F.hour(ts) * 100 + F.minute(ts)).alias("time_key"))
    counts = used.agg(F.count("*").alias("events"))
    joined = dim.join(counts, "time_key", "left").fillna(0, ["events"])
    return rounded(joined.select("time_key", "full_time", "shift", "events"))


def sales_star(spark, sf):
    i, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    fact = i.select(
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key"),
        F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("date_key"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    dims = {
        "dim_part": p.select(F.col("p_partkey").alias("part_sk"), "p_brand"),
        "dim_supplier": s.select(F.col("s_suppkey").alias("supplier_sk"), "s_nationkey"),
        "dim_date": star.date_dimension(star.date_span(i, "l_shipdate")).select("date_key", "year"),
    }
    return fact, dims


@R.add("""
SELECT p_brand AS brand, CAST(s_nationkey AS BIGINT) AS nation, CAST(year(l_shipdate) AS BIGINT) AS year,
       count(*) AS rows, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def star_query(spark, sf):
    """Joins inferred from the column names of a fact and three dimensions."""
    fact, dims = sales_star(spark, sf)
    wide = star.star_join(fact, dims, star.infer_joins({"fact_sales": fact}, dims))
    out = wide.groupBy(
        F.col("dim_part_p_brand").alias("brand"),
        F.col("dim_supplier_s_nationkey").alias("nation"),
        F.col("dim_date_year").alias("year"),
    ).agg(F.count("*").alias("rows"), F.round(F.sum("revenue"), 4).alias("revenue"))
    return rounded(out)


@R.add("""
SELECT r_name AS region, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def federated_query(spark, sf):
    """One statement over Parquet, CSV and JSON sources."""
    csv, js = shared_dir(spark, "csv"), shared_dir(spark, "json")
    customers = table(spark, sf, "customer")
    sinks.write_csv(customers, csv)
    table(spark, sf, "nation").write.json(js)
    table(spark, sf, "orders").createOrReplaceTempView("lake_orders")
    spark.read.schema(customers.schema).option("header", True).csv(csv).createOrReplaceTempView("rdb_customer")
    spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(js).createOrReplaceTempView("ref_nation")
    table(spark, sf, "region").createOrReplaceTempView("lake_region")
    return spark.sql(
        """SELECT r_name AS region, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
           FROM lake_orders JOIN rdb_customer ON o_custkey = c_custkey JOIN ref_nation ON c_nationkey = n_nationkey
           JOIN lake_region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
    )


@R.add("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_export(spark, sf):
    path = shared_dir(spark, "export")
    customers = table(spark, sf, "customer")
    sinks.write_csv(customers, path)
    return rounded(spark.read.schema(customers.schema).option("header", True).csv(path))


def silver_measures(spark, sf):
    m = measurements(spark, sf)
    return m.select(
        "analysis_id", "tank_name", "item_name", "analysis_date", "analysis_datetime",
        F.col("x").alias("result_value"), F.col("lsl").alias("process_range_min"),
        F.col("usl").alias("process_range_max"), F.col("cl").alias("control_point"),
    )


def chart_rows(spark, sf):
    e = records(spark, sf)
    labels = F.create_map(F.lit("C0"), F.lit("药水"), F.lit("C1"), F.lit("产品"), F.lit("C2"), F.lit("流程"))
    categories = e.select("category_id").distinct().select(
        "category_id", labels[F.col("category_id")].alias("name"), F.lit(True).alias("is_current")
    )
    kinds = measurements(spark, sf).select("analysis_id", F.col("process_id").alias("_type"))
    rec = e.join(kinds, "analysis_id").withColumn("process_id", F.col("_type"))
    return gold.chart_input(silver_measures(spark, sf), rec, categories)


@R.add(f"""WITH {MEASUREMENTS_SQL}, {RECORDS_SQL}
SELECT analysis_id, m.process_id, r.category_id, r.line_id, r.shift, tank_name, item_name, m.analysis_date,
       round(x, 6) AS x, lsl, usl, cl, overall_judgment,
       CASE r.category_id WHEN 'C0' THEN 'chemical' WHEN 'C1' THEN 'product' ELSE 'process' END AS char_type,
       CASE r.category_id WHEN 'C1' THEN 'R0R1R2R3' ELSE 'R0R1' END AS rules_applied
FROM meas m JOIN rec r USING (analysis_id)""")
def spc_input(spark, sf):
    return rounded(chart_rows(spark, sf).drop("analysis_datetime"))


# --- dimensions with history -----------------------------------------------------------------


def customer_versions(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.col("c_acctbal")
    old = F.when(bal < 2000, "UNKNOWN").otherwise(F.col("c_mktsegment"))
    current = c.filter(bal >= 0).select(
        "c_custkey", F.when(bal < 8000, old).alias("segment"), F.lit("2024-01-01").cast("date").alias("effective_date"),
        F.lit(None).cast("date").alias("expiration_date"), F.lit(True).alias("is_current"),
    )
    history = c.filter(bal >= 5000).select(
        "c_custkey", F.lit("OLD").alias("segment"), F.lit("2023-01-01").cast("date").alias("effective_date"),
        F.lit("2024-01-01").cast("date").alias("expiration_date"), F.lit(False).alias("is_current"),
    )
    latest = c.filter(bal <= 9000).select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return current.unionByName(history), latest


VERSIONS_SQL = """cur AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 'UNKNOWN' WHEN c_acctbal < 8000 THEN c_mktsegment END AS segment
  FROM customer WHERE c_acctbal >= 0),
new AS (SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal <= 9000),
cmp AS (
  SELECT coalesce(cur.c_custkey, new.c_custkey) AS c_custkey, cur.segment AS old_segment, new.segment AS new_segment,
         CASE WHEN cur.c_custkey IS NULL THEN 'new' WHEN new.c_custkey IS NULL THEN 'missing'
              WHEN cur.segment IS NOT DISTINCT FROM new.segment THEN 'same' ELSE 'changed' END AS change
  FROM cur FULL JOIN new ON cur.c_custkey = new.c_custkey)"""


@R.add(f"""WITH {VERSIONS_SQL}
SELECT c_custkey, change, new_segment AS segment FROM cmp WHERE change IN ('new', 'changed')""")
def scd2_diff(spark, sf):
    return scd.scd2_diff(*customer_versions(spark, sf), ["c_custkey"], ["segment"])


@R.add(f"""WITH {VERSIONS_SQL}
SELECT c_custkey, old_segment AS segment, DATE '2024-01-01' AS effective_date,
       CASE WHEN change IN ('changed', 'missing') THEN DATE '2024-02-01' END AS expiration_date,
       change = 'same' AS is_current
FROM cmp WHERE change <> 'new'
UNION ALL SELECT c_custkey, new_segment, DATE '2024-02-01', NULL, true FROM cmp WHERE change IN ('new', 'changed')
UNION ALL SELECT c_custkey, 'OLD', DATE '2023-01-01', DATE '2024-01-01', false FROM customer WHERE c_acctbal >= 5000""")
def scd2_apply(spark, sf):
    dim, latest = customer_versions(spark, sf)
    return scd.scd2_apply(dim, latest, ["c_custkey"], ["segment"], "2024-02-01", close_missing=True)


@R.add(f"""WITH {VERSIONS_SQL}
SELECT count(*) FILTER (change = 'new') AS new_rows, count(*) FILTER (change = 'changed') AS changed_rows,
       count(*) FILTER (change = 'changed') AS expired_rows,
       round(count(*) FILTER (change = 'changed') * 100.0::DOUBLE / count(*) FILTER (change <> 'missing'), 2)
         AS change_rate
FROM cmp""")
def scd2_metrics(spark, sf):
    return scd.scd2_metrics(*customer_versions(spark, sf), ["c_custkey"], ["segment"])


@R.add(f"""WITH {VERSIONS_SQL}
SELECT c_custkey, old_segment AS segment, DATE '2024-01-01' AS _effective_from,
       CASE WHEN change = 'changed' THEN DATE '2024-02-01' END AS _effective_to, change <> 'changed' AS _is_current
FROM cmp WHERE change <> 'new'
UNION ALL SELECT c_custkey, new_segment, DATE '2024-02-01', NULL, true FROM cmp WHERE change IN ('new', 'changed')""")
def scd2_hash(spark, sf):
    dim, latest = customer_versions(spark, sf)
    stored = scd.hashed_versions(
        dim.filter("is_current").select("c_custkey", "segment"), ["c_custkey"], ["segment"], "2024-01-01"
    )
    incoming = scd.hashed_versions(latest, ["c_custkey"], ["segment"], "2024-02-01")
    older = incoming.withColumn("segment", F.lit("AAA")).withColumn("_hash", F.lit("older"))
    seen = incoming.withColumn("seen", F.lit(2)).unionByName(older.withColumn("seen", F.lit(1)))
    merged = scd.scd2_hash_merge(stored, seen, ["c_custkey"], "2024-02-01", ["seen"])
    return merged.select("c_custkey", "segment", "_effective_from", "_effective_to", "_is_current")


@R.add("""
WITH brz AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS name, o_orderstatus = 'P' AS deleted,
    o_orderdate, o_orderkey FROM orders WHERE NOT starts_with(o_orderpriority, '4')),
a AS (SELECT * FROM brz WHERE o_orderdate < DATE '1996-01-01'
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
b AS (SELECT * FROM brz WHERE o_orderdate >= DATE '1996-01-01'
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
j AS (SELECT coalesce(a.id, b.id) AS id, a.name AS old, b.name AS new, coalesce(NOT a.deleted, false) AS was,
             b.id IS NOT NULL AND NOT b.deleted AS now, coalesce(b.deleted, false) AS gone
      FROM a FULL JOIN b ON a.id = b.id)
SELECT id, old AS name, DATE '1996-01-01' AS effective_date,
       CASE WHEN gone OR (now AND old <> new) THEN DATE '1998-12-31' END AS expiration_date,
       NOT (gone OR (now AND old <> new)) AS is_current FROM j WHERE was
UNION ALL
SELECT id, new, DATE '1998-12-31', NULL, true FROM j WHERE now AND (NOT was OR old <> new)""")
def silver_dimension(spark, sf):
    """Two type-2 loads of a bronze dimension; deletes close a member or keep it out."""
    raw = raw_members(spark, sf)
    cut = F.col(bronze.INGESTED) < F.lit("1996-01-01").cast("timestamp_ntz")
    dim, state = None, watermark.empty_state(spark)
    for part, day in ((raw.filter(cut), "1996-01-01"), (raw.filter(~cut), "1998-12-31")):
        members = bronze.dimension(part, F.lit(day).cast("timestamp_ntz"))
        dim, state = silver.dimension_load(members, dim, state, "members", ["id"], ["name"], day, NOW)
        dim, state = materialise(dim), materialise(state)
    return dim


# --- writes ----------------------------------------------------------------------------------


def orders_by_year(spark, sf):
    return orders_by_day(spark, sf).withColumn("year", F.year("d"))


def per_year(df, label):
    total = F.round(F.sum("o_totalprice"), 2).alias("total")
    out = df.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("rows"), total)
    return out.withColumn("step", F.lit(label))


@R.add("""
WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice FROM orders)
SELECT 'created' AS step, year, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM o GROUP BY ALL
UNION ALL
SELECT 'appended', year, count(*) * 2, round(sum(o_totalprice) * 2, 2) FROM o GROUP BY ALL
UNION ALL
SELECT 'partitions', year, count(*) * CASE WHEN year = 1998 THEN 1 ELSE 2 END,
       round(sum(o_totalprice) * CASE WHEN year = 1998 THEN 1 ELSE 2 END, 2) FROM o GROUP BY year
UNION ALL
SELECT 'range', year, count(*) * CASE WHEN year = 1998 THEN 1 ELSE 2 END,
       round(sum(o_totalprice) * CASE WHEN year = 1998 THEN 1 ELSE 2 END, 2) FROM o WHERE year <> 1997 GROUP BY year
UNION ALL
SELECT 'replaced', year, count(*), round(sum(o_totalprice), 2) FROM o GROUP BY ALL""")
def write_modes(spark, sf):
    """Create, append, replace one partition, empty a range, replace everything; the table after each."""
    rows = orders_by_year(spark, sf)
    target = versions.VersionedTable(shared_dir(spark, "orders"), ("year",))
    steps = []

    def note(label):
        steps.append(materialise(per_year(target.read(spark), label)))

    assert sinks.create_if_absent(sinks.cluster_for_write(rows, target), target)
    assert not sinks.create_if_absent(rows, target)
    note("created")
    sinks.write_append(rows, target)
    note("appended")
    sinks.write_partitions(rows.filter("year = 1998"), target)
    note("partitions")
    sinks.replace_range(rows.filter("year <> 1997"), target, "d", "1997-01-01", "1997-12-31")
    note("range")
    sinks.write_replace(rows, target)
    note("replaced")
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


@R.add("""
WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice FROM orders)
SELECT t AS step, year, count(*) AS rows, round(sum(o_totalprice), 2) AS total
FROM o, (VALUES ('first'), ('second')) v(t) GROUP BY t, year""")
def dual_write(spark, sf):
    """Both copies after one good write and one write whose second half fails."""
    rows = orders_by_year(spark, sf)
    first = sinks.ParquetTable(shared_dir(spark, "first"), ("year",))
    second = sinks.ParquetTable(shared_dir(spark, "second"), ("year",))
    sinks.dual_write(rows, first, second)

    def fail(df, target):
        raise RuntimeError("second target is not available")

    try:
        sinks.dual_write(rows.withColumn("o_totalprice", F.lit(0.0)), first, second, fail)
    except RuntimeError:
        pass
    return per_year(first.read(spark), "first").unionByName(per_year(second.read(spark), "second"))


@R.add("""
WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice FROM orders)
SELECT t AS step, year, count(*) AS rows, round(sum(o_totalprice) * CASE WHEN year < 1995 THEN 2 ELSE 1 END, 2) AS total
FROM o, (VALUES ('first'), ('second')) v(t) GROUP BY t, year""")
def dual_commit(spark, sf):
    """Two versioned copies, by year and whole, after a writer was lost between their switches and another recovered."""
    rows = orders_by_year(spark, sf)
    first = versions.VersionedTable(shared_dir(spark, "first"), ("year",))
    second = versions.VersionedTable(shared_dir(spark, "second"))
    intents = shared_dir(spark, "intents")
    sinks.dual_write(rows, first, second, intents=intents)
    doubled = rows.withColumn("o_totalprice", F.when(F.col("year") < 1995, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    staged = [(first, first.stage_partitions(doubled.filter("year < 1995"))), (second, second.stage_partitions(doubled))]
    versions.declare(spark, staged, intents)
    name = versions.open_intents(spark, intents)[0]
    first.publish(spark, staged[0][1], name)
    assert versions.recover(spark, intents) == {name: "forward"}
    return per_year(first.read(spark), "first").unionByName(per_year(second.read(spark), "second"))


@R.add("""
SELECT strftime(ts, '%Y%m%d') AS year_month_day, count(*) AS events, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def partition_scan(spark, sf):
    """Events written by day and read back with a declared schema that includes the partition."""
    e = table(spark, sf, "events").withColumn("year_month_day", cl.day_key(F.to_date("ts")))
    target = sinks.ParquetTable(shared_dir(spark, "events"), ("year_month_day",))
    sinks.write_create(sinks.cluster_for_write(e, target), target)
    back = scans.day_scan(spark, target.path, e.schema)
    return back.groupBy("year_month_day").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")
    )


@R.add("""
SELECT event_type, count(*) AS events, round(sum(value), 4) AS total
FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY ALL""")
def partition_scan_day(spark, sf):
    """One day of events, read from that day's folder only."""
    e = table(spark, sf, "events").withColumn("year_month_day", cl.day_key(F.to_date("ts")))
    target = sinks.ParquetTable(shared_dir(spark, "events"), ("year_month_day",))
    sinks.write_create(sinks.cluster_for_write(e, target), target)
    day = scans.day_scan(spark, target.path, e.schema, "20240115")
    return day.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@R.add(f"""WITH ev AS (SELECT event_id, user_id, event_type, value,
    CASE WHEN event_id % 97 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts FROM events WHERE event_id % 89 <> 1),
fact AS (
  SELECT CAST(event_id AS VARCHAR) AS analysis_id,
         CASE WHEN value <= 200 THEN user_id % 3 + 100 END AS category_key,
         CASE WHEN NOT value BETWEEN 100 AND 110 AND user_id % 5 <> 4 THEN user_id % 5 + 100 END AS line_key,
         CAST(ts AS DATE) AS analysis_date, {SHIFT_SQL} AS shift,
         CASE WHEN event_type = 'error' OR value > 120 THEN 'NG' ELSE 'OK' END AS overall_judgment FROM ev)
SELECT t AS copy, fact.* FROM fact, (VALUES ('first'), ('second')) v(t)""")
def fact_run(spark, sf):
    """Three incremental fact loads into a copy by day and one by month.

    The second brings new and late rows, the third moves some records to the next day and deletes others.
    """
    at = F.lit("2024-03-01").cast("timestamp_ntz")

    def by_day(feed):
        return feed.withColumn("year_month_day", cl.day_key(F.timestamp_millis("record_timestamp")))

    feed = bronze_feed(spark, sf).withColumn(silver.PROCESSED, F.col(bronze.INGESTED)).withColumn("__deleted", F.lit("false"))
    moved, gone = F.col("id") % 97 == 0, F.col("id") % 89 == 1
    later = feed.withColumns(
        {
            "record_timestamp": F.when(moved, F.col("record_timestamp") + 86_400_000).otherwise(F.col("record_timestamp")),
            "__deleted": F.when(gone, F.lit("true")).otherwise(F.col("__deleted")),
            silver.PROCESSED: F.when(moved | gone, at).otherwise(F.col(silver.PROCESSED)),
        }
    )
    dims = dimensions(spark, sf)
    first = versions.VersionedTable(shared_dir(spark, "fact"), ("year_month_day",))
    second = versions.VersionedTable(shared_dir(spark, "copy"), ("year", "month"))

    def build(df):
        return silver.record_fact(df, dims, now()).withColumn("year_month_day", cl.day_key(F.col("analysis_date")))

    state = watermark.empty_state(spark)
    early = feed.filter(F.col(silver.PROCESSED) < F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    for rows in (early, feed, later):
        state = materialise(silver.fact_load(by_day(rows), state, "fact", build, first, second, NOW, key="analysis_id"))
    columns = ["analysis_id", "category_key", "line_key", "analysis_date", "shift", "overall_judgment"]
    copies = [t.read(spark).select(*columns).withColumn("copy", F.lit(n)) for n, t in (("first", first), ("second", second))]
    return rounded(copies[0].unionByName(copies[1]))


@R.add(f"""WITH {FACT_SQL}, {VERSIONS_SQL}
SELECT 'dim_customer' AS table_name, count(*) AS rows FROM cur
UNION ALL SELECT 'fact_records ' || strftime(analysis_date, '%Y-%m-%d'), count(*) FROM fact GROUP BY analysis_date""")
def load_validation(spark, sf):
    """Current dimension rows and fact rows per day after a load."""
    dim, _ = customer_versions(spark, sf)
    fact = silver.record_fact(bronze_feed(spark, sf), dimensions(spark, sf), now())
    per_day = fact.groupBy("analysis_date").agg(F.count("*").alias("rows"))
    label = F.concat(F.lit("fact_records "), F.date_format("analysis_date", "yyyy-MM-dd"))
    days = per_day.select(label.alias("table_name"), "rows")
    return gold.count_rows({"dim_customer": dim.filter("is_current")}).unionByName(days)


@R.add(f"""WITH {RECORDS_SQL},
g AS (SELECT process_id AS process_name, shift, analysis_date, count(*) AS total_analyses,
             count(*) FILTER (overall_judgment = 'NG') AS bad FROM rec GROUP BY ALL)
SELECT process_name, shift, analysis_date, total_analyses,
       bad + CASE WHEN analysis_date = DATE '2024-01-15' THEN 0 ELSE 1 END AS unqualified_count,
       CASE WHEN analysis_date = DATE '2024-01-15' THEN round(bad * 100.0::DOUBLE / total_analyses, 6) END
         AS unqualified_rate
FROM g""")
def serving_sync(spark, sf):
    """Outdated serving rows, one day synchronised anew; readers see the newest version of each key."""
    from plumbline.operators.daily import nonconformance_daily

    name = "agg_qualification_rate_daily"
    rows = nonconformance_daily(records(spark, sf))
    served = rows.withColumns(
        {
            "unqualified_count": F.col("unqualified_count") + 1,
            "unqualified_rate": F.lit(None).cast("double"),
            "updated_at": F.lit("2024-01-31").cast("timestamp"),
        }
    )
    synced = serving.sync(rows, served, name, "2024-01-15", now())
    return rounded(serving.final(synced, name).drop("updated_at"))


# --- modeled tables --------------------------------------------------------------------------

C = model.ModelColumn
PRODUCTS = model.ModelTable(
    "products", "bronze", "dim", "raw.part",
    [C("product_code", "string", "concat('P', p_partkey)"), C("product_name", "string", "trim(p_name)"),
     C("size", "bigint", "p_size"), C("p_brand", "string")],
)
DIM_PRODUCT = model.ModelTable(
    "dim_product", "silver", "dim", "products",
    [C("product_code", "string", role="business_key"), C("product_name", "string", tracked=True),
     C("brand", "string", "upper(p_brand)", tracked=True)], scd="scd2",
)
FACT_SALES = model.ModelTable(
    "fact_sales", "silver", "fact", "raw.lineitem",
    [C("product_code", "string", "concat('P', l_partkey)"), C("month", "date", "trunc(l_shipdate, 'MM')"),
     C("amount", "double", "l_extendedprice * (1 - l_discount)")],
)
AGG_SALES = model.ModelTable(
    "agg_sales_monthly", "gold", "agg", "fact_sales",
    [C("month", "date", role="attribute"), C("amount", "double", measure="sum"),
     C("sales", "bigint", "product_code", measure="count")],
)
LINKS = [model.Relationship("fact_sales", "dim_product", "product_code", "product_code")]
HOOKS = model.Hooks(transform={"fact_sales": lambda df: df.filter("amount > 1000")})


def modeled(spark, sf):
    tables = {"raw.part": table(spark, sf, "part"), "raw.lineitem": table(spark, sf, "lineitem")}
    for t in (PRODUCTS, DIM_PRODUCT, FACT_SALES, AGG_SALES):
        tables[t.name] = model.build(t, tables, now(), "2024-02-01", LINKS, HOOKS)
    return tables


@R.add("""SELECT 'P' || p_partkey AS product_code, trim(p_name) AS product_name, CAST(p_size AS BIGINT) AS size, p_brand,
  'raw.part' AS _source FROM part""")
def model_bronze(spark, sf):
    return modeled(spark, sf)["products"].drop("_ingested_at")


@R.add("""SELECT 'P' || p_partkey AS product_code, trim(p_name) AS product_name, upper(p_brand) AS brand,
  DATE '2024-02-01' AS _effective_from, CAST(NULL AS DATE) AS _effective_to, true AS _is_current FROM part""")
def model_dim(spark, sf):
    return modeled(spark, sf)["dim_product"].drop("_surrogate_key", "_hash")


@R.add("""SELECT 'P' || l_partkey AS product_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  round(l_extendedprice * (1 - l_discount), 6) AS amount, p_partkey IS NOT NULL AS has_key
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_extendedprice * (1 - l_discount) > 1000""")
def model_fact(spark, sf):
    fact = modeled(spark, sf)["fact_sales"]
    found = F.col("dim_product_key").isNotNull().alias("has_key")
    return rounded(fact.select("product_code", "month", "amount", found))


@R.add("""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount, count(*) AS sales
FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 1000 GROUP BY 1""")
def model_agg(spark, sf):
    return rounded(modeled(spark, sf)["agg_sales_monthly"].drop("_computed_at"), 4)
