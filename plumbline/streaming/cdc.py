"""Change-data streams: decode, route by business date, append to raw or merge into a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.cleansing import day_key, days_to_date
from plumbline.operators.upsert import newest
from plumbline.scale import keyset_join, materialise
from plumbline.sources.sinks import ParquetTable, drop_partitions, write_partitions

DATA_VERSION = "2.0"
ENVELOPE = "topic string, partition int, offset bigint, timestamp timestamp, value string"


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """One topic from its beginning; offsets that the broker has dropped do not stop the stream.

    A trigger takes all that has arrived, or at most ``max_offsets`` if that is given.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets))
    return reader.load()


def file_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same envelope from JSON files, for replays and tests."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


POSITION = ("topic", "partition", "offset")


def once_per_offset(envelope: DataFrame, within: str = "1 day") -> DataFrame:
    """Messages that a broker or a replay delivers again, by up to ``within`` of their time, are taken once.

    The state holds the positions of that span only, and survives a restart in the stream's checkpoint. A message that
    is further behind the newest one is taken to be a repeat, so the span has to cover how late messages may come.
    """
    return envelope.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(list(POSITION))


def decode(envelope: DataFrame, schema: T.StructType | str, ingested: Column | None = None) -> DataFrame:
    """Typed columns of the row image with the broker's position; rows without an id are dropped."""
    schema = schema if isinstance(schema, str) else schema.simpleString()
    # As a generator's output the text is parsed once; filters on the fields cannot repeat the parse.
    image = F.from_json(F.col("value").cast("string"), schema)
    parsed = envelope.select(
        "topic", "partition", "offset", F.col("timestamp").alias("kafka_timestamp"), F.inline(F.array(image))
    )
    return parsed.withColumns(
        {
            "cdc_operation": F.lit("upsert"),
            "raw_ingestion_timestamp": F.current_timestamp() if ingested is None else ingested,
            "raw_data_version": F.lit(DATA_VERSION),
        }
    ).filter(F.col("id").isNotNull())


def route_dimension(df: DataFrame) -> DataFrame:
    """Partition by the day of ingestion."""
    return df.withColumn("dt", F.to_date("raw_ingestion_timestamp"))


def route_records(df: DataFrame, millis: str = "record_timestamp") -> DataFrame:
    """Business date from epoch milliseconds; undated rows are dropped."""
    moment = F.timestamp_millis(F.col(millis).cast("long"))
    dated = df.withColumns(
        {"business_datetime": moment.cast("timestamp").cast("string").substr(1, 19), "business_date": F.to_date(moment)}
    )
    return _with_day(dated)


def route_measurements(df: DataFrame, days: str = "analysis_date") -> DataFrame:
    """Business date from days since the epoch; undated rows are dropped."""
    return _with_day(df.withColumn("business_date", days_to_date(F.col(days))))


def _with_day(df: DataFrame) -> DataFrame:
    return df.filter("business_date IS NOT NULL").withColumn("year_month_day", day_key(F.col("business_date")))


def append_raw(
    df: DataFrame, path: str, checkpoint: str, by: Sequence[str], name: str, available_now: bool = False
) -> StreamingQuery:
    """Append to partitioned Parquet every ten seconds, or once over all that is available.

    The file sink's log and the checkpoint together give every input row exactly once.
    """
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .queryName(name)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*by)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


BATCH = "batch"
FOLDED = -1


def merge_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Sequence[str],
    available_now: bool = False,
    fold_every: int | None = None,
) -> StreamingQuery:
    """Append the newest version per key of each micro-batch to a table of versions.

    A batch writes only what it brings, into a partition of its own, and a repeated batch replaces that partition.
    ``current_rows`` reads the newest version of every key. With ``fold_every`` the batch that makes so many partitions
    folds them, so reads and file counts stay bounded however long the stream runs; a batch that is repeated after its
    fold brings versions that are stored already.
    """
    table = ParquetTable(path, (BATCH,))

    def merge(batch: DataFrame, number: int) -> None:
        write_partitions(newest(batch, keys, version).withColumn(BATCH, F.lit(number)), table)
        if fold_every and open_versions(batch.sparkSession, path) >= fold_every:
            fold_versions(batch.sparkSession, path, keys, version)

    writer = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def open_versions(spark: SparkSession, path: str) -> int:
    """How many batches of a table of versions are not folded, by the names of their folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return sum(n.startswith(f"{BATCH}=") and n != f"{BATCH}={FOLDED}" for n in names)


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest version of every key of a table of versions."""
    return newest(spark.read.parquet(path).drop(BATCH), keys, version)


def fold_versions(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str]) -> None:
    """Compact a table of versions: the newest ones in one partition, the batches that they came from removed.

    The folded partition is complete before any batch goes, so a reader, or a restart in between, sees every key; a
    batch that a running stream adds meanwhile isn't touched.
    """
    stored = spark.read.parquet(path)
    table = ParquetTable(path, (BATCH,))
    batches = materialise(stored.filter(F.col(BATCH) != FOLDED).select(BATCH).distinct(), "batches")
    rows = keyset_join(stored, batches, [BATCH], "left_semi").unionByName(stored.filter(F.col(BATCH) == FOLDED))
    folded = newest(rows.drop(BATCH), keys, version).withColumn(BATCH, F.lit(FOLDED))
    write_partitions(materialise(folded, "folded"), table)
    drop_partitions(batches, table)


def start_routes(
    spark: SparkSession,
    topics: Mapping[str, tuple[DataFrame, T.StructType | str, Callable[[DataFrame], DataFrame], str]],
    root: str,
    checkpoints: str,
    available_now: bool = False,
    repeats_within: str | None = None,
) -> dict[str, StreamingQuery]:
    """Start the raw append of every topic: (envelope, schema, route, partition column), each with its own checkpoint.

    ``repeats_within`` is the span in which a message that comes again is left out.
    """

    def once(envelope: DataFrame) -> DataFrame:
        return envelope if repeats_within is None else once_per_offset(envelope, repeats_within)

    return {
        name: append_raw(
            route(decode(once(envelope), schema)), f"{root}/{name}", f"{checkpoints}/{name}", [by], f"raw_{name}", available_now
        )
        for name, (envelope, schema, route, by) in topics.items()
    }
