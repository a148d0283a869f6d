"""A blocked Bloom filter as a table: one row of 256 bits per block, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rowkeys import fresh

BITS_PER_KEY = 16
PROBES = 4
WORDS = 4
#: A filter of up to this many blocks (32 bytes of bits and a key each) is broadcast: under 16 MB. A larger one is
#: joined by shuffling the keys that are asked for.
BROADCAST_BLOCKS = 1 << 17


def block_count(n_keys: int) -> int:
    return n_keys * BITS_PER_KEY // (64 * WORDS) + 1


def block_and_bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bits it sets in each of the block's words."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")
    mark = F.xxhash64(key, F.lit(1))
    probes = [F.shiftrightunsigned(mark, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]
    one = F.lit(1).cast("long")
    words = []
    for w in range(WORDS):
        bits = F.lit(0).cast("long")
        for p in probes:
            at = p.bitwiseAND(F.lit(63)).cast("int")
            here = F.call_function("shiftleft", one, at)
            bits = bits.bitwiseOR(F.when(F.shiftright(p, 6) == w, here).otherwise(F.lit(0).cast("long")))
        words.append(bits)
    return block, words


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    block, words = block_and_bits(F.col("key"), n_blocks)
    bits = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(asked: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``asked`` whose ``key`` the filter doesn't rule out. It may have any other columns."""
    block, words = block_and_bits(F.col("key"), n_blocks)
    names = [fresh(n, asked.columns) for n in ("_block", *(f"_word{i}" for i in range(WORDS)))]
    marks = [fresh(f"_mark{i}", asked.columns) for i in range(WORDS)]
    marked = asked.withColumns({names[0]: block, **dict(zip(marks, words, strict=True))})
    named = blocks.select("block", *[f"w{i}" for i in range(WORDS)]).toDF(*names)
    filter_side = F.broadcast(named) if n_blocks <= BROADCAST_BLOCKS else named
    held = F.lit(True)
    for w, m in zip(names[1:], marks, strict=True):
        held = held & (F.col(w).bitwiseAND(F.col(m)) == F.col(m))
    return marked.join(filter_side, names[0]).where(held).select(*asked.columns)


def split_by(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows that hold none of ``keys`` for certain, the others), by a filter of bounded size.

    ``keys`` is a written frame whose one column ``on`` has no nulls; rows without a key are certain.
    """
    n_blocks = min(block_count(keys.count()), BROADCAST_BLOCKS)
    block, words = block_and_bits(F.xxhash64(on), n_blocks)
    names = [fresh(n, rows.columns) for n in ("_block", *(f"_bits{i}" for i in range(WORDS)))]
    blocks = bloom_blocks(keys.select(F.xxhash64(on).alias("key")), n_blocks).toDF(*names)
    marked = rows.withColumn(names[0], block).join(F.broadcast(blocks), names[0], "left")
    held = F.lit(True)
    for name, w in zip(names[1:], words, strict=True):
        held = held & (F.col(name).bitwiseAND(w) == w)
    maybe = F.coalesce(held, F.lit(False)) & F.col(on).isNotNull()
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Anti-join of wide rows with a written set of keys: only rows that may hold a key are shuffled."""
    certain, others = split_by(rows, keys, on)
    return certain.unionByName(others.join(keys, on, "left_anti").select(*rows.columns))
