"""Row-level changes, watermarks, dimensions with history, table operations."""

import datetime as dt

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.operators import scd, tableops, upsert, watermark
from plumbline.plans import bronze, gold, serving, silver

NOW = dt.datetime(2024, 2, 1)


def people(spark, *data):
    return spark.createDataFrame(list(data), "id int, name string, created_at int")


def test_newest_is_total_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c"), (1, 4, "z")], "k int, v int, x string")
    out = upsert.newest(df, ["k"], ["v"])
    text = plan(out)
    assert text.count("WindowGroupLimit") == 2 and ", Partial" in text
    assert rows(out) == [(1, 5, "b"), (2, 1, "c")]


def test_upsert_keeps_created_at_and_is_idempotent(spark):
    old, new = people(spark, (1, "a", 10), (2, "b", 10)), people(spark, (2, None, 20), (3, "c", 20), (3, "c", 20))
    once = upsert.upsert(old, new, ["id"])
    assert rows(once) == [(1, "a", 10), (2, None, 10), (3, "c", 20)]
    assert rows(upsert.upsert(once, new, ["id"])) == rows(once)


def test_coalescing_upsert(spark):
    old = people(spark, (1, "a", 10), (2, None, 10))
    new = people(spark, (1, "", 20), (2, "b", None), (3, "", 5))
    assert rows(upsert.coalescing_upsert(old, new, ["id"])) == [(1, "a", 20), (2, "b", 10), (3, None, 5)]


def test_replace_where_keeps_rows_with_unknown_predicate(spark):
    old = people(spark, (1, None, 1), (2, "x", 1))
    out = upsert.replace_where(old, people(spark, (9, "x", 2), (8, "y", 2)), "name = 'x'")
    assert rows(out) == [(1, None, 1), (9, "x", 2)]


def test_months_predicate(spark):
    df = spark.createDataFrame([(2023, 11), (2023, 12), (2024, 1), (2024, 2)], "year int, month int")
    assert rows(df.filter(upsert.months_predicate("2023-12-05", "2024-01-02"))) == [(2023, 12), (2024, 1)]


def test_deleted_rows_are_hidden(spark):
    df = spark.createDataFrame([(1, "true"), (2, "false"), (3, None)], "id int, __deleted string")
    assert rows(upsert.live(df), "id") == [(2,), (3,)]
    assert upsert.live(df, keep_deleted=True).count() == 3


# --- watermarks ------------------------------------------------------------------------------


def feed(spark, *data):
    return spark.createDataFrame(
        [(i, n, dt.datetime(2024, 1, d), d, x) for i, n, d, x in data],
        "id string, name string, raw_ingestion_timestamp timestamp_ntz, offset int, __deleted string",
    )


RAW = [("1", " a ", 1, "false"), ("2", "b", 2, "false"), ("2", "b2", 3, "false"), ("1", "a", 4, "true"), ("3", " ", 5, "false")]


def load(spark, raw, stored, state):
    clean = lambda df: bronze.dimension(df, F.lit(NOW).cast("timestamp"))
    return bronze.load(raw, stored, state, "t", clean, ["id"], NOW)


def test_increments_equal_a_full_load(spark):
    raw = feed(spark, *RAW)
    full, _ = load(spark, raw, None, watermark.empty_state(spark))
    stored, state = None, watermark.empty_state(spark)
    for day in (1, 2, 3, 5, 5):
        stored, state = load(spark, raw.filter(F.col("offset") <= day), stored, state)
    assert rows(stored, "id", "name", "__deleted") == rows(full, "id", "name", "__deleted")
    assert rows(upsert.live(stored), "id", "name") == [("2", "b2")]


def test_older_image_does_not_revive_a_deleted_row(spark):
    stored, state = load(spark, feed(spark, *RAW), None, watermark.empty_state(spark))
    again, _ = load(spark, feed(spark, *RAW[:3]), stored, state)
    assert rows(upsert.live(again), "id") == [("2",)]


def test_failed_mark_forces_a_full_load(spark):
    _, state = load(spark, feed(spark, *RAW), None, watermark.empty_state(spark))
    assert watermark.last_success(state, "t") == dt.datetime(2024, 1, 4)
    assert watermark.last_success(watermark.mark_failed(state, "t", "ALL", NOW), "t") is None
    assert watermark.last_success(state, "other") is None


def test_empty_batch_leaves_the_mark(spark):
    raw = feed(spark, *RAW)
    stored, state = load(spark, raw, None, watermark.empty_state(spark))
    _, after = load(spark, raw, stored, state)
    assert rows(after) == rows(state)


def test_reset_needs_confirmation(spark):
    _, state = load(spark, feed(spark, *RAW), None, watermark.empty_state(spark))
    with pytest.raises(SpecError):
        watermark.reset(state)
    assert watermark.reset(state, confirm=True).count() == 0
    assert watermark.reset(state, "table_name LIKE 'spc_%'", confirm=True).count() == 1


def test_mark_is_pushed_to_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(watermark.newer_than(events, "ts", dt.datetime(2024, 1, 15)))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in text


def test_month_batches_and_backfill():
    batches = watermark.month_batches(dt.date(2023, 12, 15), dt.date(2024, 2, 10))
    assert batches == [
        (dt.date(2023, 12, 15), dt.date(2023, 12, 31)),
        (dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
        (dt.date(2024, 2, 1), dt.date(2024, 2, 10)),
    ]

    def run(first, last):
        if first.month == 1:
            raise RuntimeError("boom")

    outcome = watermark.backfill(dt.date(2023, 12, 15), dt.date(2024, 2, 10), run)
    assert [o[2] for o in outcome] == ["SUCCESS", "FAILED: boom", "SUCCESS"]


# --- type 2 dimensions -----------------------------------------------------------------------


def dimension(spark, *data):
    return spark.createDataFrame(
        [(k, n, dt.date(2024, 1, 1), None, True) for k, n in data],
        "id int, name string, effective_date date, expiration_date date, is_current boolean",
    )


def latest(spark, *data):
    return spark.createDataFrame(list(data), "id int, name string")


def test_scd2_apply(spark):
    dim, new = dimension(spark, (1, "a"), (2, "b")), latest(spark, (1, "a"), (2, "c"), (3, "d"))
    out = scd.scd2_apply(dim, new, ["id"], ["name"], "2024-02-01")
    assert rows(out.filter("is_current"), "id", "name") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(out.filter("NOT is_current"), "id", "name", "expiration_date") == [(2, "b", dt.date(2024, 2, 1))]
    again = scd.scd2_apply(out, new, ["id"], ["name"], "2024-03-01")
    assert rows(again) == rows(out)


def test_scd2_null_changes_and_missing_keys(spark):
    dim, new = dimension(spark, (1, None), (2, "b"), (4, None)), latest(spark, (1, "x"), (4, None))
    assert rows(scd.scd2_diff(dim, new, ["id"], ["name"]), "id", "change") == [(1, "changed")]
    closed = scd.scd2_diff(dim, new, ["id"], ["name"], close_missing=True)
    assert rows(closed, "id", "change") == [(1, "changed"), (2, "missing")]


def test_scd2_one_current_row_and_no_overlap(spark):
    dim = dimension(spark, (1, "a"))
    for day, name in (("2024-02-01", "b"), ("2024-03-01", "c"), ("2024-03-01", "c"), ("2024-04-01", "a")):
        dim = scd.scd2_apply(dim, latest(spark, (1, name)), ["id"], ["name"], day)
    spans = sorted((r.effective_date, r.expiration_date or dt.date.max) for r in dim.collect())
    assert [s[1] for s in spans[:-1]] == [s[0] for s in spans[1:]]
    assert dim.filter("is_current").count() == 1


def test_scd2_metrics_and_first_load(spark):
    out = scd.scd2_metrics(dimension(spark, (1, "a"), (2, "b")), latest(spark, (1, "z"), (3, "c")), ["id"], ["name"])
    assert rows(out) == [(1, 1, 1, 50.0)]
    assert scd.first_load(latest(spark, (1, "a")), ["id"], ["name"], "2024-01-01").filter("is_current").count() == 1


def test_hash_merge_tells_null_from_empty_and_versions_apart(spark):
    def hashed(day, *data):
        return scd.hashed_versions(latest(spark, *data), ["id"], ["name"], day)

    first = hashed("2024-01-01", (1, None), (2, "b"))
    second = scd.scd2_hash_merge(first, hashed("2024-02-01", (1, ""), (2, "b")), ["id"], "2024-02-01")
    assert rows(second, "id", "name", "_is_current") == [(1, "", True), (1, None, False), (2, "b", True)]
    assert second.select("_surrogate_key").distinct().count() == 3
    third = scd.scd2_hash_merge(second, hashed("2024-03-01", (1, ""), (2, "b")), ["id"], "2024-03-01")
    assert rows(third) == rows(second)


# --- table operations ------------------------------------------------------------------------


def test_patch_needs_a_predicate_and_known_columns(spark):
    df = people(spark, (1, "a", 1), (2, None, 2))
    for bad in (lambda: tableops.patch(df, "delete", " "), lambda: tableops.patch(df, "update", "id = 1"),
                lambda: tableops.patch(df, "update", "id = 1", {"x;y": "1"}),
                lambda: tableops.patch(df, "truncate", "id = 1"), lambda: tableops.patch_preview(df, "")):
        with pytest.raises(SpecError):
            bad()
    assert rows(tableops.patch(df, "delete", "name = 'a'")) == [(2, None, 2)]
    both = tableops.patch(df, "update", "name = 'a'", {"id": "created_at + 9", "created_at": "id"})
    assert rows(both) == [(10, "a", 1), (2, None, 2)]


def test_schema_changes(spark):
    df = people(spark, (1, "a", 1))
    for op in ("drop", "narrow"):
        with pytest.raises(SpecError):
            tableops.alter(df, op, "id", data_type="smallint")
    for op, kind in (("widen", "string"), ("add", ""), ("rename", "")):
        with pytest.raises(SpecError):
            tableops.alter(df, op, "id", data_type=kind)
    assert tableops.alter(df, "widen", "id", data_type="bigint").schema["id"].dataType.simpleString() == "bigint"
    assert tableops.alter(df, "narrow", "name", data_type="int", approved=True).first().name is None
    assert tableops._wider_decimal("decimal(10,4)", "decimal(12,4)")
    assert not tableops._wider_decimal("decimal(10,4)", "decimal(10,6)")


def test_rollback_restores_touched_partitions(spark):
    df = people(spark, (1, "a", 1), (2, "b", 1), (3, "c", 2))
    image = tableops.pre_image(df, "id = 1", ["created_at"])
    patched = tableops.patch(df, "delete", "id = 1")
    assert rows(tableops.rollback(patched, image, ["created_at"])) == rows(df)


# --- jobs ------------------------------------------------------------------------------------


def test_gold_range_is_independent_of_the_split(spark, sf):
    """Two half-range runs give the rows of one full-range run."""
    from queries.layers import chart_rows
    from queries.roles import records

    wide, rec = chart_rows(spark, sf), records(spark, sf)
    run = lambda a, b: gold.gold_run(rec, wide, a, b, tie=["analysis_id"])
    whole, one, two = run("2024-01-01", "2024-01-31"), run("2024-01-01", "2024-01-15"), run("2024-01-16", "2024-01-31")
    for name in ("spc_capability_daily", "spc_trend_ma", "spc_p_chart", "agg_qualification_rate_daily"):
        keys = list(serving.SERVING_KEYS[name])
        assert rows(one[name].unionByName(two[name]), *keys) == rows(whole[name], *keys)
    # A narrow run still gives the alarm rate of the whole month.
    key = ["process_id", "tank_name", "total_points", "total_alarm_count"]
    assert rows(two["spc_monthly_alarm_rate"], *key) == rows(whole["spc_monthly_alarm_rate"], *key)


def test_serving_defaults(spark):
    gold_rows = spark.createDataFrame(
        [("p", None, dt.date(2024, 1, 1), 5, None), (None, "A", dt.date(2024, 1, 1), 1, 1.0)],
        "process_name string, shift string, analysis_date date, total_analyses bigint, unqualified_rate double",
    )
    name, keys = "agg_qualification_rate_daily", serving.SERVING_KEYS["agg_qualification_rate_daily"]
    now = F.lit(NOW).cast("timestamp")
    kept = serving.fill_defaults(gold_rows, keys, "2024-01-01", now)
    assert rows(kept, "process_name", "shift", "unqualified_rate") == [("p", "", None)]
    zero = serving.fill_defaults(gold_rows, keys, "2024-01-01", now, zero_numbers=True)
    assert zero.first().unqualified_rate == 0.0
    served = spark.createDataFrame([], serving.fill_defaults(gold_rows, keys, "2024-01-01", now).withColumn("updated_at", now).schema)
    once = serving.sync(gold_rows, served, name, "2024-01-01", now)
    twice = serving.sync(gold_rows, once, name, "2024-01-01", now)
    assert twice.count() == 2 and rows(serving.final(twice, name)) == rows(once)


def test_measurement_dates(spark):
    schema = "analysis_date int"
    df = spark.createDataFrame([(19723,), (None,), (1,)], schema)
    assert rows(silver.rejected_dates(df)) == [(1, 1)]
    text = spark.createDataFrame([("2024-01-01",), ("nonsense",)], "analysis_date string")
    from plumbline.functions.cleansing import as_date, day_key

    assert [r[0] for r in text.select(day_key(as_date(text, "analysis_date"))).collect()] == ["20240101", None]


def test_published_ranges_equal_one_full_run(spark, sf, tmp_path):
    """Two ranges, published in any order and one of them twice, give the tables of one full run."""
    from queries.layers import chart_rows
    from queries.roles import records

    wide, rec = chart_rows(spark, sf), records(spark, sf)

    def run(root, start, end):
        names = ("agg_qualification_rate_daily", "spc_capability_daily", "spc_baseline", "spc_monthly_alarm_rate")
        made = gold.gold_run(rec, wide, start, end, tie=["analysis_id"])
        gold.publish(spark, {n: made[n] for n in names}, str(tmp_path / root), start, end)

    run("whole", "2024-01-01", "2024-01-31")
    for start, end in (("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-15"), ("2024-01-01", "2024-01-15")):
        run("parts", start, end)
    keys = {**serving.SERVING_KEYS, "spc_baseline": ("process_id", "tank_name", "cl_x")}
    for name in ("agg_qualification_rate_daily", "spc_capability_daily", "spc_baseline", "spc_monthly_alarm_rate"):
        whole, parts = (gold.published(str(tmp_path / r), name).read(spark) for r in ("whole", "parts"))
        assert rows(parts, *keys[name]) == rows(whole, *keys[name])
        assert name == "spc_monthly_alarm_rate" or parts.count() > 0


def test_backfill_clears_chart_marks(spark):
    state = spark.createDataFrame(
        [(n, "ALL", NOW, 1, NOW, "SUCCESS") for n in ("spc_p_chart", "qualification_rate")], watermark.STATE_SCHEMA
    )
    months = []
    left, outcome = gold.backfill_spc(state, dt.date(2024, 1, 5), dt.date(2024, 2, 2), lambda a, b: months.append((a, b)))
    assert rows(left, "table_name") == [("qualification_rate",)]
    assert len(months) == 2 and {o[2] for o in outcome} == {"SUCCESS"}


def test_null_keys_are_found_again(spark):
    table = spark.createDataFrame([(None, "a", 1), (1, None, 2)], "k int, p string, v int")
    once = upsert.upsert(table, table.withColumn("v", F.col("v") + 10), ["k", "p"])
    assert rows(once) == rows(upsert.upsert(once, once, ["k", "p"])) and once.count() == 2
    assert {r.v for r in once.collect()} == {11, 12}
    assert upsert.insert_absent(table, table, ["k", "p"]).count() == 2


def test_limit_sets_of_a_day_are_served_apart(spark):
    from plumbline.plans import serving

    day = dt.date(2024, 1, 1)
    schema = "process_id string, tank_name string, item_name string, shift string, analysis_date date, lsl double, usl double, cl double, cpk double"
    chart = spark.createDataFrame([("p", "t", "i", "A", day, 1.0, 9.0, 5.0, 1.5), ("p", "t", "i", "A", day, 2.0, 8.0, None, 1.1)], schema)
    name = "spc_capability_daily"
    served = serving.sync(chart, chart.limit(0).withColumn("updated_at", F.current_timestamp()), name, "2024-01-01", F.current_timestamp())
    assert serving.final(served, name).count() == 2


def test_repeated_incoming_keys_make_one_version(spark):
    from plumbline.operators import scd

    stored = scd.hashed_versions(spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), ["k"], ["v"], "2024-01-01")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (None, "n", 1)], "k int, v string, seq int")
    merged = scd.scd2_hash_merge(stored, scd.hashed_versions(new, ["k"], ["v"], "2024-02-01"), ["k"], "2024-02-01", ["seq"])
    assert rows(merged.select("k", "v", "_is_current")) == rows(
        spark.createDataFrame([(1, "a", False), (1, "c", True), (None, "n", True)], "k int, v string, c boolean")
    )
