"""Token ids in binary files: frequency-ranked, byte-aligned, with the control bytes apart from the data.

An id is stored as its rank by frequency in the whole corpus, so the common ones take one byte. A file is a run of
blocks, each ended by a line feed and holding whole documents::

    b"PLIB", u32 task, u32 block, u64 documents, u64 tokens, u64 data bytes      little-endian, as all numbers
    i64 key per document, u8 per document (1: the key is null), u64 tokens per document
    control: two bits per token, its width in bytes less one, four tokens to a byte from the low bits up
    data: the ranks in their widths

A second folder holds the table of ranks: ``b"PLIR"``, u32 number of ids, then the ids from the most frequent one on,
u32 each. The files are written and read by Spark's own readers and writers, so they can lie in any store. Blocks are in
ascending order of the key within a file, and the files of a lower task come first.

Decoding is by table: a control byte looks up the widths of its four tokens, running sums give their places, the bytes
there are put together, and the rank looks up the id. Nothing loops over tokens.

Documents are encoded where they are read, chunk by chunk between single spaces, which changes no id; so memory is
bounded by the texts at hand and a cache of stated size, which a worker keeps from task to task of that job. Ids are staged with two bytes each if the vocabulary allows. The sort is by range of key,
and rows of one key are told apart by their place in the staged table, so a key with a third of all rows is dealt over
several tasks. The table of ranks has at most one entry per id of the vocabulary, and is all that is sent to the tasks.

Defined results: a null or empty text is the closing id alone; null keys come first; repeated rows are documents of
their own, in the order in which they are read; an empty table gives no blocks and no rows; other columns are ignored.
Keys are whole numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bytetokens import byte_encoder
from plumbline.scale import materialise, shared_dir

END_ID = 2
BLOCK_TOKENS = 1 << 18
#: Blocks in one file; with blocks of half a megabyte a file is read as one row of a few megabytes.
FILE_BLOCKS = 16
#: Ids counted together.
COUNTED = 1 << 20
HEADER = struct.Struct("<4sIIQQQ")
MAGIC, RANKS_MAGIC = b"PLIB", b"PLIR"
#: For each control byte the widths of its four tokens, a byte each, as one number.
WIDTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8).view(np.uint32).reshape(-1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    less_one = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = less_one
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    # only as many bytes of each number are looked at as the widest has
    widest = int(less_one.max(initial=0)) + 1
    held = np.empty((len(ranks), widest), bool)
    for k in range(widest):
        held[:, k] = less_one >= k
    parts = np.ascontiguousarray(ranks.view(np.uint8).reshape(-1, 4)[:, :widest])
    return control.tobytes(), parts.reshape(-1)[held.reshape(-1)].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    widths = WIDTHS[control].view(np.uint8)[:n]
    wide = widths.astype(np.int64)
    starts = np.cumsum(wide) - wide
    ranks = data[starts].astype(np.uint32)
    for k in range(1, int(widths.max(initial=1))):
        more = np.flatnonzero(widths > k)
        ranks[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_block(task: int, block: int, keys: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join(
        [
            HEADER.pack(MAGIC, task, block, len(keys), len(ranks), len(data)),
            np.asarray([k or 0 for k in keys], "<i8").tobytes(),
            bytes(k is None for k in keys),
            np.asarray(counts, "<u8").tobytes(),
            control,
            data,
        ]
    )


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(task, block, keys, tokens per document, all ranks) of each block of a file. Raises on a damaged file."""
    at = 0
    while at < len(content):
        magic, task, block, n_docs, n_tokens, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at += HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(content, kind, n, at)
            at += got.nbytes
            return got

        keys, nulls, counts = take("<i8", n_docs).tolist(), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
        control = take("u1", -(-n_tokens // 4))
        ranks = decode_ranks(control, take("u1", n_data), n_tokens)
        if content[at : at + 1] != b"\n" or counts.sum() != n_tokens:
            raise ValueError("a block of token ids is cut short")
        at += 1
        yield task, block, [None if z else k for k, z in zip(keys, nulls, strict=True)], counts, ranks


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``_key``, ``_n`` and ``_ids`` of every row, written. Ids have two bytes if all of them fit, else four."""
    kind = "<u2" if max(byte_encoder(tokenizer).largest, end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bytetokens import byte_encoder
        from plumbline.llm.wordcache import give_back

        encoder = byte_encoder(tokenizer)
        try:
            for batch in batches:
                at = 0
                for ids, stops in encoder.columns(batch.column(1), end_id):
                    data, starts = ids.astype(kind), np.append(0, stops)
                    buffers = [None, pa.py_buffer(starts * data.itemsize), pa.py_buffer(data)]
                    made = pa.Array.from_buffers(pa.large_binary(), len(stops), buffers).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(stops)), pa.array(np.diff(starts), pa.int64()), made],
                        names=["_key", "_n", "_ids"],
                    )
                    at += len(stops)
        finally:
            # the words stay for the worker's next task of this job; the jobs that follow drop them
            give_back()

    read = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    made = read.mapInArrow(run, "_key bigint, _n bigint, _ids binary")
    path = shared_dir(docs.sparkSession, "ids")
    # common ids have equal bytes, so this codec shrinks them by an eighth; the usual one does not
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def id_kind(n_bytes: int, n: int) -> str:
    return "<u2" if n_bytes == 2 * n else "<u4"


def staged_ids(n: pa.Array, ids: pa.Array) -> np.ndarray:
    """Ids of all rows of a batch, one after the other, as they are staged."""
    ids = ids.cast(pa.large_binary())
    if not len(ids):
        return np.zeros(0, np.uint16)
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
    data = memoryview(ids.buffers()[2])[ends[0] : ends[-1]]
    return np.frombuffer(data, id_kind(len(data), int(n.to_numpy().sum())))


def frequencies(staged: DataFrame) -> DataFrame:
    """``id`` and ``n`` over all documents; each task counts its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bytetokens import drop_words
        from plumbline.llm.idfiles import COUNTED, staged_ids

        drop_words()
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = staged_ids(batch.column(0), batch.column(1))
            for lo in range(0, len(ids), COUNTED):
                here = np.bincount(ids[lo : lo + COUNTED], minlength=len(total))
                here[: len(total)] += total
                total = here
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["id", "n"])

    counted = staged.select("_n", "_ids").mapInArrow(run, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def save_bytes(rows: DataFrame, column: str, path: str, **options) -> None:
    """Write a binary column as files, a line feed behind each row."""
    rows.select(F.col(column).cast("string").alias("value")).write.options(**options).text(path)


def load_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def save(staged: DataFrame, path: str) -> None:
    """Write staged ids as ``path/ranks`` and ``path/blocks``."""
    spark = staged.sparkSession
    # at most as many rows as the vocabulary has ids
    order = np.asarray([r.id for r in frequencies(staged).orderBy(F.desc("n"), "id").select("id").collect()], "<u4")
    table = RANKS_MAGIC + struct.pack("<I", len(order)) + order.tobytes()
    save_bytes(spark.range(0, 1, 1, 1).select(F.lit(table).alias("table")), "table", f"{path}/ranks")
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from plumbline.llm.bytetokens import drop_words
        from plumbline.llm.idfiles import BLOCK_TOKENS, staged_ids, write_block

        drop_words()
        task, block = TaskContext.get().partitionId(), 0
        keys, counts, ranks, tokens = [], [], [], 0

        def close() -> pa.RecordBatch:
            made = write_block(task, block, keys, counts, np.concatenate(ranks))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["block"])

        for batch in batches:
            own, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = staged_ids(batch.column(1), batch.column(2))
            ends = np.append(0, np.cumsum(n, dtype=np.int64))
            lo = 0
            while lo < len(own):
                # up to the document with which the block is full
                hi = min(int(np.searchsorted(ends, ends[lo] + BLOCK_TOKENS - tokens)), len(own))
                keys += own[lo:hi]
                counts += n[lo:hi]
                ranks.append(sent.value[ids[ends[lo] : ends[hi]]])
                tokens += int(ends[hi] - ends[lo])
                lo = hi
                if tokens >= BLOCK_TOKENS:
                    yield close()
                    keys, counts, ranks, tokens = [], [], [], 0
                    block += 1
        if keys:
            yield close()

    placed = staged.withColumn("_tie", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie")
    save_bytes(dealt.select("_key", "_n", "_ids").mapInArrow(run, "block binary"), "block", f"{path}/blocks", maxRecordsPerFile=FILE_BLOCKS)


def load(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Every document of the files: key, ``start`` (tokens before it), ``n_tokens`` and ``ids_crc32``."""
    decoded = materialise(decode(spark, path, digest_only=True), "decoded")
    blocks = decoded.groupBy("task", "block").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("task").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task that wrote
    tasks = blocks.groupBy("task").agg(F.sum("n").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    starts = blocks.select("task", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_block")).join(firsts, "task")
    placed = decoded.join(starts, ["task", "block"])
    start = (F.col("_first") + F.col("_block") + F.col("offset")).alias("start")
    return placed.select(F.col("_key").alias(key), start, "n_tokens", "ids_crc32")


def decode(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Documents as read from the files: ``_key, task, block, offset`` in the block, ``n_tokens``, ``ids_crc32``, ``ids``.

    ``ids`` are unsigned 32-bit numbers as bytes, or null with ``digest_only``.
    """
    tables = [bytes(r.content) for r in load_bytes(spark, f"{path}/ranks").collect()]
    if len(tables) != 1 or tables[0][:4] != RANKS_MAGIC:
        raise ValueError("the table of ranks is missing")
    (n,) = struct.unpack_from("<I", tables[0], 4)
    sent = spark.sparkContext.broadcast(np.frombuffer(tables[0], "<u4", n, 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bytetokens import drop_words
        from plumbline.llm.idfiles import read_blocks

        drop_words()
        names = ["_key", "task", "block", "offset", "n_tokens", "ids_crc32", "ids"]
        kinds = [*[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                for task, block, keys, counts, ranks in read_blocks(content.as_buffer().to_pybytes()):
                    data = sent.value[ranks].astype("<u4").tobytes()
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    own = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(keys)
                    columns = [keys, [task] * n, [block] * n, starts, counts, [zlib.crc32(d) for d in own]]
                    columns.append([None] * n if digest_only else own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                    )

    schema = "_key bigint, task bigint, block bigint, offset bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    read = load_bytes(spark, f"{path}/blocks").mapInArrow(run, schema)
    return read.drop("ids") if digest_only else read


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all rows to new files in the shared folder and read them back."""
    path = shared_dir(docs.sparkSession, "idfiles")
    save(encode(docs, tokenizer, key, text, end_id), path)
    return load(docs.sparkSession, path, key)
