"""Cost-balanced packing of token ids into sequences.

Documents are cut into whole sequences and a remainder. Remainders are gathered in pools of bounded size. A pool of T
tokens gets T // capacity full sequences, and for the rest one sequence per bit of T % capacity, whose lengths are
powers of two; so its capacities add up to T and nothing needs padding. A remainder's cost is estimated as
``linear * n + quadratic * n * n``, for attention within a document. Remainders go, in descending cost, to the
sequence of lowest cost that still has room for them; when none has, the remainder is cut and fills the roomiest
sequences.

A task packs what it reads, so nothing is shuffled, a lost task is packed again in the same way, and memory is bounded
by the pool and the longest text. Equal costs are broken by the order of reading.

Defined results: a null or empty text is the closing id alone; null keys, repeated rows and other columns do no harm,
each row is packed as a document of its own; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
POOL_TOKENS = 1 << 20
#: Documents whose ids are held at once, besides the pool.
TEXTS = 128
END_ID = 1
#: Share of the quadratic term: attention over this many tokens costs as much as their linear work.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

PIECE = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint"
)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a pool's sequences: full ones, then powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(index of the remainder, start in it, length, sequence, offset there) for a pool of remainders.

    The sequences stand in a heap by cost. Those without room for the remainder at hand are set aside in a heap by
    room, and come back as soon as a remainder is short enough for them.
    """
    room = capacities(sum(lengths), capacity)
    spent = [0.0] * len(room)
    used = [0] * len(room)
    lowest = [(0.0, s) for s in range(len(room))]
    aside: list[tuple[int, int]] = []  # (-room, sequence)
    pieces = []

    def put(s: int, i: int, start: int, n: int) -> None:
        pieces.append((i, start, n, s, used[s]))
        used[s] += n
        room[s] -= n
        spent[s] += cost(n)

    for i in sorted(range(len(lengths)), key=lambda k: (-cost(lengths[k]), k)):
        start, n = 0, lengths[i]
        while aside and -aside[0][0] >= n:
            s = heapq.heappop(aside)[1]
            heapq.heappush(lowest, (spent[s], s))
        while lowest and room[lowest[0][1]] < n:
            s = heapq.heappop(lowest)[1]
            heapq.heappush(aside, (-room[s], s))
        if lowest:
            s = heapq.heappop(lowest)[1]
            put(s, i, start, n)
            if room[s]:
                heapq.heappush(lowest, (spent[s], s))
            continue
        while n:
            s = heapq.heappop(aside)[1]
            part = min(n, room[s])
            put(s, i, start, part)
            start, n = start + part, n - part
            if room[s]:
                heapq.heappush(aside, (-room[s], s))
    return pieces


def pack_batches(batches: Iterator[pa.RecordBatch], encode, key_type: pa.DataType, partition: int, capacity: int):
    """Pieces of all documents of a task, a pool at a time."""
    names = ["_key", *(c.split()[0] for c in PIECE.split(", "))]
    sequence = partition << 40

    def rows(columns: list[list]) -> pa.RecordBatch:
        kinds = [key_type] + [pa.int64()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def close(pool: list, sequence: int) -> tuple[pa.RecordBatch, int]:
        placed = assign([len(ids) for _, ids, _, _ in pool], capacity)
        held: dict[int, int] = {}
        for _, _, n, s, _ in placed:
            held[s] = held.get(s, 0) + n
        out = [
            (pool[i][0], pool[i][2] + a, n, zlib.crc32(pool[i][1][a : a + n]), pool[i][3], sequence + s, o, held[s])
            for i, a, n, s, o in placed
        ]
        return rows([list(c) for c in zip(*out, strict=True)]), sequence + len(held)

    pool, tokens = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            part = batch.slice(lo, TEXTS)
            full = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                whole = len(ids) // capacity * capacity
                for a in range(0, whole, capacity):
                    crc = zlib.crc32(ids[a : a + capacity])
                    full.append((key, a, capacity, crc, len(ids), sequence, 0, capacity))
                    sequence += 1
                if whole < len(ids):
                    pool.append((key, ids[whole:].copy(), whole, len(ids)))
                    tokens += len(ids) - whole
            if full:
                yield rows([list(c) for c in zip(*full, strict=True)])
            if tokens >= POOL_TOKENS:
                out, sequence = close(pool, sequence)
                pool, tokens = [], 0
                yield out
    if pool:
        yield close(pool, sequence)[0]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of ``docs``: key, place in the document, place in the sequence, checksum of the ids.

    ``tokenizer`` is the path of a tokenizer file that every executor has. ``capacity`` is a power of two.
    Sequence numbers are unique within one result; their upper bits name the task.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity of a sequence must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from plumbline.llm.tokens import word_encoder

        encoder = word_encoder(tokenizer)
        try:
            yield from pack_batches(batches, encoder.batch, to_arrow_type(kind), TaskContext.get().partitionId(), capacity)
        finally:
            # a worker may go on to other tasks; it keeps the tokenizer, not the words
            encoder.forget()

    read = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    pieces = read.mapInArrow(run, f"_key {kind.simpleString()}, {PIECE}")
    return pieces.withColumnRenamed("_key", key)
