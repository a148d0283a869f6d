"""Spelling variants: words one edit apart, found by generated edits behind length-sharded blocked Bloom filters.

Words are counted where they are read and summed by word. The vocabulary (words of a stated length and count) is hashed
into blocked Bloom filters, one shard per word length (the last shard for all longer words), which are broadcast. Every
word then generates its edits: each deletion asks the shard of the next shorter words, each replacement by a later
letter the shard of its own length. An insertion is the other word's deletion and a replacement by an earlier letter the
other word's, so each pair comes up exactly once. Only edits that a filter lets through are spelled out and shuffled to
the exact join with the vocabulary, which removes the false positives.

Edits are never spelled out to be asked: with ``H = sum(c[i] * B**i)`` modulo 2**64 the hash of a word without its i-th
letter, or with another one there, follows from H and a running sum, for all words of one length in a few array
operations. Long words cost their length times the alphabet, not its square.

The filters take ``BITS_PER_WORD`` bits a word but never more than ``MAX_FILTER_BYTES``; beyond that they let more edits
pass, and the exact join still decides. Counts, candidates and joins cover all words; no word has a limit of partners.

A word's form is its commonest near word if that is at least ``ratio`` times as common. Forms lead strictly upwards in
count, by that factor a step, so chains are short; roots come from doubling steps.

Defined results: a null or empty text has no words; a null key counts as the empty text; repeated rows count each;
other columns are ignored; an empty table, or one whose words are all rare or short, gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.scale import materialise

LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One letter in so many runs is dropped, by the checksum of key and run.
DROP_ONE_IN = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: A task's counts are handed on when they hold so many words or characters.
HELD_WORDS, HELD_CHARS = 1 << 18, 1 << 23

SHARDS = 64
BLOCK_WORDS = 8
BITS_PER_WORD = 24
PROBES = 6
MAX_FILTER_BYTES = 64 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Edits that are hashed at once.
CHUNK = 1 << 20


def words_of(key: object, text: str, pattern: re.Pattern, min_length: int) -> Counter:
    """Words of one text. All occurrences of a run in a text are altered alike, so each run is hashed once."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    found: Counter = Counter()
    for run, n in Counter(pattern.findall(text.translate(LOWER) if not text.isascii() else text.lower())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP_ONE_IN:
            found[run] += n
        elif len(run) > min_length:
            at = h % len(run)
            found[run[:at] + run[at + 1 :]] += n
    return found


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``word`` and ``n`` over all texts, for words of at least ``min_length`` code points."""
    # a shorter run stays shorter, and a longest match is a whole run
    pattern = f"[{LETTERS}]{{{min_length},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.spelling import HELD_CHARS, HELD_WORDS, words_of

        compiled = re.compile(pattern)
        held: Counter = Counter()
        chars = 0

        def rows() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            lo = 0
            while lo < len(words):
                hi = lo + 1
                size = len(words[lo])
                while hi < len(words) and hi - lo < 1 << 16 and size < HELD_CHARS:
                    size += len(words[hi])
                    hi += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[lo:hi], pa.string()), pa.array(counts[lo:hi], pa.int64())], names=["word", "n"]
                )
                lo = hi

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words_of(k, t.as_py() or "", compiled, min_length)
                chars += sum(map(len, own))
                held.update(own)
                if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                    # repeats of a known word need no more memory
                    chars = sum(map(len, held))
                    if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                        yield from rows()
                        held.clear()
                        chars = 0
        yield from rows()

    read = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return read.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def codes_by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, matrix of code points) for the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        per = max(1, CHUNK // int(length))
        for lo in range(0, len(at), per):
            some = at[lo : lo + per]
            joined = "".join([words[i] for i in some]).encode("utf-32-le")
            yield some, np.frombuffer(joined, "<u4").reshape(len(some), length).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    out = np.ones(length, np.uint64)
    out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all its bits."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def shard_of(length: int) -> int:
    return min(length, SHARDS - 1)


class Layout:
    """Where the shards lie among the blocks: first block and number of blocks by shard."""

    def __init__(self, sizes: dict[int, int], bits_per_word: int = BITS_PER_WORD, max_bytes: int = MAX_FILTER_BYTES):
        per_block = 64 * BLOCK_WORDS
        total = sum(sizes.values())
        bits = min(bits_per_word, max(1.0, (max_bytes // (per_block // 8) - SHARDS) * per_block / max(total, 1)))
        self.blocks = np.zeros(SHARDS, np.int64)
        for shard, n in sizes.items():
            self.blocks[shard] = math.ceil(n * bits / per_block) if n else 0
        while self.blocks.sum() * per_block // 8 > max_bytes:
            self.blocks = np.where(self.blocks > 1, self.blocks // 2, self.blocks)
        self.first = np.cumsum(self.blocks) - self.blocks

    def block(self, mixed: np.ndarray, shard: int) -> np.ndarray:
        return self.first[shard] + ((mixed >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)).astype(np.int64)


def probe(mixed: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(word in the block, bit) of the i-th probe; five of them come from the low half, the rest from a second mix."""
    bits = mixed if i < 3 else mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(37)
    at = bits >> np.uint64(9 * (i % 3)) & np.uint64(511)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def held_by(mixed: np.ndarray, shard: int, layout: Layout, bits: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the shard's filter doesn't rule out. Each probe looks at what the last one left."""
    left = np.arange(len(mixed))
    if not layout.blocks[shard]:
        return left[:0]
    block = layout.block(mixed, shard)
    for i in range(PROBES):
        word, bit = probe(mixed, i)
        ok = bits[block, word] & bit != 0
        left, mixed, block = left[ok], mixed[ok], block[ok]
    return left


def edits(words: list[str], layout: Layout, bits: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of the word, an edit that may be a word): deletions, and replacements by a later letter."""
    for at, codes in codes_by_length(words):
        k, length = codes.shape
        power = powers(length)
        terms = codes * power
        h = terms.sum(1, dtype=np.uint64)
        shorter, own = shard_of(length - 1), shard_of(length)
        if layout.blocks[shorter] and length > 1:
            before = np.cumsum(terms, 1, dtype=np.uint64)
            without = before - terms + (h[:, None] - before) * INVERSE
            # in a run of equal letters only the first one is dropped
            keep = np.ones(codes.shape, bool)
            keep[:, 1:] = codes[:, 1:] != codes[:, :-1]
            rows, places = np.nonzero(keep)
            for f in held_by(mix(without[keep]), shorter, layout, bits).tolist():
                w = words[at[rows[f]]]
                yield int(at[rows[f]]), w[: places[f]] + w[places[f] + 1 :]
        if layout.blocks[own]:
            for letter in alphabet:
                rows, places = np.nonzero(codes < letter)
                if len(rows):
                    changed = h[rows] + (letter - codes[rows, places]) * power[places]
                    for f in held_by(mix(changed), own, layout, bits).tolist():
                        w = words[at[rows[f]]]
                        yield int(at[rows[f]]), w[: places[f]] + chr(int(letter)) + w[places[f] + 1 :]


def bloom_filters(vocabulary: DataFrame) -> tuple[Layout, np.ndarray, np.ndarray]:
    """(layout, bits by block, letters in use) of a written vocabulary. The bits are at most ``MAX_FILTER_BYTES``."""
    shard = F.least(F.length("word"), F.lit(SHARDS - 1))
    layout = Layout({r.shard: r.n for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.spelling import BLOCK_WORDS, PROBES, codes_by_length, mix, powers, probe, shard_of

        names = ["block", *(f"w{i}" for i in range(BLOCK_WORDS))]
        letters = np.zeros(256, bool)
        for batch in batches:
            for _, codes in codes_by_length(batch.column(0).to_pylist()):
                letters[np.unique(codes).astype(np.int64)] = True
                mixed = mix((codes * powers(codes.shape[1])).sum(1, dtype=np.uint64))
                block, slot = np.unique(layout.block(mixed, shard_of(codes.shape[1])), return_inverse=True)
                held = np.zeros((len(block), BLOCK_WORDS), np.uint64)
                for i in range(PROBES):
                    word, bit = probe(mixed, i)
                    np.bitwise_or.at(held, (slot, word), bit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), *[pa.array(c.view(np.int64)) for c in np.ascontiguousarray(held.T)]], names=names
                )
        # the letters in use ride along as one more block
        marks = np.packbits(letters, bitorder="little").view(np.uint64).view(np.int64)
        spread = [*marks.tolist(), *[0] * (BLOCK_WORDS - len(marks))]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *[pa.array([v], pa.int64()) for v in spread]], names=names)

    columns = [f"w{i}" for i in range(BLOCK_WORDS)]
    made = vocabulary.select("word").mapInArrow(run, f"block bigint, {', '.join(f'{c} bigint' for c in columns)}")
    rows = made.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in columns]).toArrow()
    block = rows.column("block").to_numpy()
    bits = np.zeros((max(int(layout.blocks.sum()), 1), BLOCK_WORDS), np.uint64)
    values = np.stack([rows.column(c).to_numpy() for c in columns], axis=1).view(np.uint64) if len(block) else bits[:0]
    real = block >= 0
    bits[block[real]] = values[real]
    marks = np.bitwise_or.reduce(values[~real], axis=0) if (~real).any() else np.zeros(BLOCK_WORDS, np.uint64)
    letters = np.flatnonzero(np.unpackbits(marks[:4].view(np.uint8), bitorder="little")).astype(np.uint64)
    return layout, bits, letters


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, once, for a written vocabulary ``word, n``."""
    layout, bits, letters = bloom_filters(vocabulary)
    sent = vocabulary.sparkSession.sparkContext.broadcast((layout, bits, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.spelling import edits

        def rows(found: list[tuple[str, int, str]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n", "near"]
            )

        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, chars = [], 0
            for i, near in edits(words, *sent.value):
                found.append((words[i], counts[i], near))
                chars += 2 * len(near)
                if chars > 1 << 22:
                    yield rows(found)
                    found, chars = [], 0
            if found:
                yield rows(found)

    # the vocabulary is dealt out anew, as words that are alike in length cost alike
    asked = vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, near string")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return asked.join(known, "near").select("word", "n", "near", "near_n")


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word with ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    both = pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    shown = vocabulary.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    written = materialise(shown, "forms")
    return written.join(roots(written, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(words: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` of the words that have a form. A step doubles the length of the chains that are followed."""
    led = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top, low = words.agg(F.max("n"), F.min("n")).first()
    longest, rest = 0, (top or 0) // max(low or 1, 1)
    while rest >= ratio:
        longest, rest = longest + 1, rest // ratio
    reach = 1
    while reach < longest:
        led = materialise(led, "roots")
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        led = led.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return led


def group_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """All words of ``docs`` that are long and common enough, with their near words, form and root."""
    counted = count_words(docs, key, text, min_length).where(F.col("n") >= min_count)
    vocabulary = materialise(counted, "vocabulary")
    return forms(vocabulary, materialise(near_words(vocabulary), "pairs"), ratio)
