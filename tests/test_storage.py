"""Sources, sinks and streams on real folders."""

import datetime as dt
import json
import os

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from plumbline.operators import tableops
from plumbline.scale import materialise, shared_dir
from plumbline.sources import scans, sinks
from plumbline.sources.jdbc import JdbcTarget
from plumbline.sources.sinks import ParquetTable
from plumbline.streaming import cdc

SCHEMA = "id int, d date, v int, day string"


def frame(spark, *data):
    return spark.createDataFrame(
        [(i, dt.date(2024, 1, day), v, f"202401{day:02d}") for i, day, v in data], SCHEMA
    )


@pytest.fixture
def target(tmp_path):
    return ParquetTable(str(tmp_path / "t"), ("day",))


def stored(spark, target):
    return rows(spark.read.parquet(target.path), "id", F.dayofmonth("d"), "v")


def test_write_modes(spark, target):
    assert sinks.create_if_absent(frame(spark, (1, 1, 1), (2, 2, 1)), target)
    assert not sinks.create_if_absent(frame(spark, (9, 9, 9)), target)
    sinks.write_partitions(frame(spark, (3, 2, 7)), target)
    assert stored(spark, target) == [(1, 1, 1), (3, 2, 7)]
    sinks.write_append(frame(spark, (4, 2, 8)), target)
    assert stored(spark, target) == [(1, 1, 1), (3, 2, 7), (4, 2, 8)]
    sinks.rewrite(target, lambda df: df.filter("id > 1"), spark)
    assert stored(spark, target) == [(3, 2, 7), (4, 2, 8)]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_create(frame(spark, (1, 1, 1)), target)


def test_replace_range_rewrites_only_touched_days(spark, target):
    sinks.write_create(frame(spark, (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1)), target)
    folder = os.path.join(target.path, "day=20240101")
    before = sorted(os.listdir(folder))
    new = frame(spark, (2, 2, 5), (9, 9, 9))
    for _ in range(2):
        sinks.replace_range(new, target, "d", "2024-01-02", "2024-01-03")
        assert stored(spark, target) == [(1, 1, 1), (2, 2, 5), (4, 4, 1)]
    assert sorted(os.listdir(folder)) == before
    assert not os.path.exists(os.path.join(target.path, "day=20240103"))


def test_dual_write_restores_the_first_copy(spark, tmp_path):
    first, second = ParquetTable(str(tmp_path / "a"), ("day",)), ParquetTable(str(tmp_path / "b"), ("day",))

    def fail(df, target):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        sinks.dual_write(frame(spark, (1, 1, 1)), first, second, fail)
    assert not first.exists(spark)
    sinks.dual_write(frame(spark, (1, 1, 1), (2, 2, 2)), first, second)
    with pytest.raises(RuntimeError):
        sinks.dual_write(frame(spark, (1, 1, 50), (3, 3, 3)), first, second, fail)
    assert stored(spark, first) == stored(spark, second) == [(1, 1, 1), (2, 2, 2)]


def test_dual_write_of_unpartitioned_tables(spark, tmp_path):
    first, second = ParquetTable(str(tmp_path / "a")), ParquetTable(str(tmp_path / "b"))

    def half(df, target):
        sinks.write_replace(df.limit(0), target)
        raise RuntimeError("down")

    sinks.dual_write(frame(spark, (1, 1, 1)), first, second)
    sinks.dual_write(frame(spark, (2, 2, 2)), first, second)
    with pytest.raises(RuntimeError):
        sinks.dual_write(frame(spark, (3, 3, 3)), first, second, half)
    assert stored(spark, first) == stored(spark, second) == [(2, 2, 2)]


def test_null_and_escaped_partitions_are_replaced(spark, tmp_path):
    target = ParquetTable(str(tmp_path / "t"), ("k",))
    day = dt.date(2024, 1, 1)
    rows = [(i, k, day) for i, k in enumerate(["a:b", None, "x y", "50%", "p", "007"])]
    data = spark.createDataFrame(rows, "id int, k string, d date")
    sinks.write_create(data, target)
    sinks.replace_range(data.filter("k = '007'"), target, "d", "2024-01-01", "2024-01-02")
    left = target.typed(data.schema).read(spark).collect()
    assert [(r.id, r.k) for r in left] == [(5, "007")]
    assert [f for f in os.listdir(target.path) if f.startswith("k=")] == ["k=007"]


def test_partition_filter_prunes(spark, target):
    sinks.write_create(frame(spark, (1, 1, 1), (2, 2, 1)), target)
    day = scans.day_scan(spark, target.path, SCHEMA.replace("day", "year_month_day"), None)
    assert "year_month_day" in day.columns
    one = scans.parquet_scan(spark, target.path, columns=["id"], partition={"day": "20240102"}, where="v >= 0")
    text = plan(one)
    assert "PartitionFilters: [isnotnull(day" in text and "GreaterThanOrEqual(v,0)" in text
    assert "ReadSchema: struct<id:int,v:int>" in text
    assert rows(one) == [(2,)]


def test_compaction_keeps_rows_and_reduces_files(spark, target):
    data = frame(spark, *[(i, 1 + i % 2, i) for i in range(40)])
    sinks.write_create(data.repartition(8), target)
    before = tableops.table_files(spark, target.path).first()
    sinks.compact(target, spark)
    after = tableops.table_files(spark, target.path).first()
    assert after.file_count == 2 < before.file_count
    assert after.small_files == 2
    assert rows(spark.read.schema(SCHEMA).parquet(target.path)) == rows(data)


def test_hot_partition_is_split_over_files(spark, target):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4096")
    try:
        hot = spark.range(20_000).select(F.col("id").cast("int"), F.xxhash64("id").alias("v"), F.lit("20240101").alias("day"))
        rest = spark.range(50).select(F.col("id").cast("int"), F.lit(1).cast("bigint").alias("v"), F.lit("20240102").alias("day"))
        sinks.write_create(sinks.cluster_for_write(hot.unionByName(rest), target), target)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d: [f for f in os.listdir(os.path.join(target.path, d)) if f.endswith(".parquet")] for d in ("day=20240101", "day=20240102")}
    assert len(files["day=20240101"]) > 1 and len(files["day=20240102"]) == 1


def test_missing_sources_are_empty(spark, tmp_path):
    assert scans.table_or_empty(spark, "no_such_table", "id int").count() == 0
    assert scans.path_or_empty(spark, str(tmp_path / "none"), "id int").columns == ["id"]
    frame(spark, (1, 1, 1)).createOrReplaceTempView("some_view")
    assert scans.table_or_empty(spark, "some_view", "id int").count() == 1


def test_jdbc_options():
    target = JdbcTarget("jdbc:x://h/db", "gold.t", (("user", "u"),), "id", "0", "100", 4)
    assert target.read_options() == {
        "url": "jdbc:x://h/db", "dbtable": "gold.t", "fetchsize": "1000", "user": "u",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4",
    }
    assert target.write_options()["truncate"] == "true"


def test_shared_directory_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base)
    cut = materialise(spark.range(5).toDF("id"))
    assert "FileScan parquet" in plan(cut) and cut.count() == 5


# --- streams ---------------------------------------------------------------------------------

IMAGE = "id string, record_timestamp bigint, analysis_date int, value double"


def put(folder, name, *messages):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        for offset, image in messages:
            text = image if isinstance(image, str) else json.dumps(image)
            out.write(json.dumps({"topic": "t", "partition": 0, "offset": offset, "value": text,
                                  "timestamp": "2024-01-01T00:00:00Z"}) + "\n")


JAN1 = 1704067200000


def test_decode_drops_unreadable_and_unidentified_messages(spark):
    data = [("t", 0, i, None, v) for i, v in enumerate(['{"id":"1","value":2.5}', "not json", '{"value":1}', None])]
    out = cdc.decode(spark.createDataFrame(data, cdc.ENVELOPE), IMAGE)
    assert rows(out, "id", "value", "offset") == [("1", 2.5, 0)]
    assert plan(out).count("from_json") == 1


def test_routes(spark):
    data = [("a", JAN1 + 3_600_000, 19723, 1.0), ("b", None, None, 1.0)]
    df = spark.createDataFrame(data, IMAGE).withColumn("raw_ingestion_timestamp", F.lit("2024-05-06").cast("timestamp"))
    assert rows(cdc.route_records(df), "id", "business_datetime", "year_month_day") == [("a", "2024-01-01 01:00:00", "20240101")]
    assert rows(cdc.route_measurements(df), "id", "year_month_day") == [("a", "20240101")]
    assert rows(cdc.route_dimension(df), "id", "dt") == [("a", dt.date(2024, 5, 6)), ("b", dt.date(2024, 5, 6))]


def test_append_stream_survives_a_restart(spark, tmp_path):
    source, raw, checkpoint = (str(tmp_path / n) for n in ("in", "raw", "ck"))

    def drain():
        routed = cdc.route_records(cdc.decode(cdc.file_source(spark, source, max_files=1), IMAGE))
        cdc.append_raw(routed, raw, checkpoint, ["year_month_day"], "restart", available_now=True).awaitTermination()
        return rows(spark.read.parquet(raw), "id", F.col("year_month_day").cast("string"))

    put(source, "1.json", (0, {"id": "a", "record_timestamp": JAN1}), (1, {"id": "late"}))
    assert drain() == [("a", "20240101")]
    put(source, "2.json", (2, {"id": "b", "record_timestamp": JAN1 - 86_400_000}))
    put(source, "3.json", (3, {"id": "c", "record_timestamp": JAN1}))
    expected = [("a", "20240101"), ("b", "20231231"), ("c", "20240101")]
    assert drain() == expected
    assert drain() == expected


def test_merging_stream_equals_a_batch(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    path = str(tmp_path / "merged")

    def drain():
        decoded = cdc.decode(cdc.file_source(spark, source, max_files=1), IMAGE)
        cdc.merge_stream(decoded, path, checkpoint, ["id"], ["offset"], available_now=True).awaitTermination()
        return rows(cdc.current_rows(spark, path, ["id"], ["offset"]), "id", "value")

    put(source, "1.json", *[(i, {"id": str(i % 5), "value": float(i)}) for i in range(20)])
    assert drain() == [(str(k), 15.0 + k) for k in range(5)]
    put(source, "2.json", (30, {"id": "1", "value": 99.0}), (7, {"id": "2", "value": -1.0}), (31, {"id": "9", "value": 1.0}))
    assert drain() == [("0", 15.0), ("1", 99.0), ("2", 17.0), ("3", 18.0), ("4", 19.0), ("9", 1.0)]
    for _ in range(2):
        cdc.fold_versions(spark, path, ["id"], ["offset"])
        assert os.listdir(path).count("batch=-1") == 1 and not os.path.exists(f"{path}/batch=0")
        assert drain() == [("0", 15.0), ("1", 99.0), ("2", 17.0), ("3", 18.0), ("4", 19.0), ("9", 1.0)]
    put(source, "3.json", (40, {"id": "0", "value": 5.0}))
    assert drain()[0] == ("0", 5.0)


def test_replays_and_restarts_leave_one_row_per_offset(spark, tmp_path):
    """Each file repeats messages of the file before; the stream is started anew in between."""
    source, raw, checkpoint = (str(tmp_path / n) for n in ("in", "raw", "ck"))
    for i in range(12):
        put(source, f"{i:02d}.json", *[(o, {"id": str(o), "record_timestamp": JAN1}) for o in range(max(0, 3 * i - 2), 3 * i + 3)])
        if i % 4 == 3:
            once = cdc.once_per_offset(cdc.file_source(spark, source, max_files=1), "1 day")
            routed = cdc.route_records(cdc.decode(once, IMAGE))
            cdc.append_raw(routed, raw, checkpoint, ["year_month_day"], "once", available_now=True).awaitTermination()
    assert sorted(int(r.id) for r in spark.read.parquet(raw).collect()) == list(range(36))


def test_a_merging_stream_folds_itself(spark, tmp_path):
    """Over fifty batches the number of files stays under a bound, and the rows are those of a batch."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "merged", "ck"))
    most = []
    fold = cdc.fold_versions

    def counted(*args):
        most.append(sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names))
        fold(*args)

    for i in range(50):
        put(source, f"{i:02d}.json", (i, {"id": str(i % 7), "value": float(i)}))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cdc, "fold_versions", counted)
        decoded = cdc.decode(cdc.file_source(spark, source, max_files=1), IMAGE)
        cdc.merge_stream(decoded, path, checkpoint, ["id"], ["offset"], available_now=True, fold_every=5).awaitTermination()
    assert len(most) == 10 and max(most) <= 5 * 2 + 8 and cdc.open_versions(spark, path) < 5
    assert rows(cdc.current_rows(spark, path, ["id"], ["offset"]), "id", "value") == [(str(k), 49.0 - (49 - k) % 7) for k in range(7)]
