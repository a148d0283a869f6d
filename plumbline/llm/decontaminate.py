"""Benchmark decontamination by template canonicalisation.

Both sides become templates: a number is ``<num>``, a unit behind a number or grown together with it ``<unit>``, a
capitalised word inside a sentence ``<name>``, and every other word its lower-case core without punctuation. A capitalised
word that opens a sentence is read both ways, as a plain word and as a name. Windows of template tokens are hash-joined,
so a question whose numbers, names or units were exchanged still meets its original; so are windows of the plain
lower-case cores, which find verbatim copies whatever their case. Along each diagonal
(document place minus item place) the values that stand in equal slots are then compared: an exchange must be a
one-to-one renaming. Windows that hold a value for which another stands elsewhere on the diagonal are dropped, as
coincidences of templates; windows whose values equal the item's always count.

A document is contaminated by an item if consistent matches cover at least ``min_cover`` of the item's tokens, added up
over the diagonals that lie near each other in the document, or a run of at least ``min_run`` tokens on one diagonal.

The benchmark's window hashes are first marked at two places each in a bitmap of fixed size (2 MB), which every task gets; only a text's
windows that hit it are emitted, and the exact hash join decides. The bitmap's size does not depend on the data.

Defined results: a null or empty text, or one with fewer tokens than a window, has no windows and is never
contaminated; items shorter than a window are compared as one window of their own length; an empty benchmark
contaminates nothing; repeated rows have equal results, and rows of one key and different texts are judged each; a null
document key is a key like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plumbline.llm.bloom import without
from plumbline.llm.rowkeys import fresh, row_key
from plumbline.llm.wordcache import WordCache
from plumbline.scale import materialise

WINDOW = 8
MIN_COVER = 0.5
MIN_RUN = 20
BITMAP_BITS = 24
#: Where in a window's hash its two places in the bitmap begin.
PROBES = (64 - BITMAP_BITS, 64 - 2 * BITMAP_BITS)
#: Texts that are looked at together, so that the work on arrays outweighs the calls.
TEXTS = 128
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years percent % € $ £ usd eur dollar dollars cent cents euro euros "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters "
    "litre litres mile miles foot feet inch inches pound pounds degree degrees °c °f hz khz mhz w kw mph kmh".split()
)
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
EDGES = re.compile(r"^\W+|\W+$")
#: A number with a unit grown to it, and what follows the unit.
GLUED = re.compile(r"(\W*\d+(?:[.,:/]\d+)*)([^\W\d_].*)", re.S)
MARKS = 6
PLAIN = ~np.uint64((1 << MARKS) - 1)
NUM, UNIT, NAME = (np.uint64(x << MARKS) for x in (1, 2, 3))
#: Marks in the lower bits of what is known of a word; a line feed becomes a token that is empty and ends a sentence.
CAPITAL, NUMERIC, AS_UNIT, ENDS, EMPTY, TWO = (1 << k for k in range(MARKS))
LINE = "\x00"


def split_unit(word: str) -> tuple[str, str] | None:
    """Number and unit of a word that holds both, each with the punctuation on its side."""
    m = GLUED.fullmatch(word)
    return (m[1], m[2]) if m and EDGES.sub("", m[2]).lower() in UNITS else None


def word_mark(word: str) -> int:
    """Hash of a word's lower-case core, with the marks in the lower bits; never 0."""
    if word == LINE:
        return EMPTY | ENDS
    marks = 0
    if word.isalpha():
        core = word
    elif word[-1] in ".," and word[:-1].isalpha():
        core = word[:-1]
        marks = ENDS * (word[-1] == ".")
    else:
        core = EDGES.sub("", word)
        shown = word.strip("()[]\"'.,;:!?").lower()
        marks |= ENDS * word.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
        marks |= NUMERIC * bool(NUMBER.fullmatch(core))
        marks |= AS_UNIT * (shown in UNITS)
        marks |= EMPTY * (not core and shown not in UNITS)
        marks |= TWO * (split_unit(word) is not None)
        core = core or shown
    lower = core.lower()
    marks |= AS_UNIT * (lower in UNITS) | CAPITAL * core[:1].isupper()
    return (xxh64_intdigest(lower.encode(), 7) & int(PLAIN)) | marks


class Templater:
    """Templates of several texts at once. Words' marks are kept in a bounded cache."""

    def __init__(self):
        self.words = WordCache()

    def marks(self, words: list[str]) -> list[int]:
        known = self.words.known
        marks = list(map(known.get, words))
        if missing := [i for i, m in enumerate(marks) if m is None]:
            new = self.words.recall({words[i] for i in missing})
            self.words.note(new)
            known.update({w: word_mark(w) for w in new})
            for i in missing:
                marks[i] = known[words[i]]
        return marks

    def __call__(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[str], np.ndarray]:
        """The readings and the text number of each token; all words, and the tokens' places among them.

        A reading is the tokens' hashes and slot marks: opening words plain, opening words as names, no slots at all.
        """
        self.words.make_room()
        parts = [f"{t or ''}\n".replace("\n", f" {LINE} ").split() for t in texts]
        words = list(chain.from_iterable(parts))
        values = np.fromiter(self.marks(words), np.uint64, len(words))
        number = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        two = np.flatnonzero(values & np.uint64(TWO))
        if len(two):
            halves = [split_unit(words[i]) for i in two.tolist()]
            places = np.repeat(np.arange(len(words)), 1 + ((values & np.uint64(TWO)) != 0))
            values, number, words = values[places], number[places], [words[i] for i in places.tolist()]
            for i, pair in zip((two + np.arange(len(two))).tolist(), halves, strict=True):
                words[i : i + 2] = pair
                values[i : i + 2] = self.marks(list(pair))
        has = lambda mark: (values & np.uint64(mark)) != 0
        # every text ends with a line, so a sentence opens at the first word of each
        opens = np.concatenate([[True], has(ENDS)[:-1]])
        numeric = has(NUMERIC)
        unit = np.concatenate([[False], numeric[:-1]]) & has(AS_UNIT)
        capital = has(CAPITAL) & ~unit & ~numeric
        kept = np.flatnonzero(~has(EMPTY))
        plain = values & PLAIN

        def reading(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h = np.where(numeric, NUM, np.where(unit, UNIT, np.where(name, NAME, plain)))
            return h[kept], (numeric | unit | name)[kept]

        readings = [reading(capital & ~opens), reading(capital), (plain[kept], np.zeros(len(kept), bool))]
        return readings, number[kept], words, kept


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def slots_of(slot: np.ndarray, words: list[str], places: np.ndarray, at: int, width: int) -> str:
    """The values in a window's slots, each behind its place in the window."""
    shown = ((k, words[places[at + k]]) for k in range(width) if slot[at + k])
    return "\t".join(f"{k}={(EDGES.sub('', w) or w).lower()}" for k, w in shown)


WINDOWS = "key {key}, row bigint, wh bigint, at bigint, width bigint, tokens bigint, slots string"
NAMES = ["key", "row", "wh", "at", "width", "tokens", "slots"]


def windows(rows: DataFrame, key: str, text: str, width: int, bitmap=None, widths: tuple[int, ...] = ()) -> DataFrame:
    """Windows of every text in all readings: hash, place, width, tokens of the text, slot values.

    ``row`` is a hash of the text, which tells rows of one key apart.

    With ``bitmap``, a broadcast array of bits, only the windows that hit it, of ``width`` and of all ``widths``.
    Without one, a text shorter than ``width`` is one window of its own length. Windows shorter than ``width`` say too
    little to have their opening word exchanged, so they are not read with it as a name.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType
    types = [to_arrow_type(kind), *[pa.int64()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.wordcache import give_back

        template = Templater()
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                keys = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True))
                out = list(found(keys, *template(part.column(1).to_pylist()), bits))
                for at in range(0, len(out), 20_000):
                    yield batch_of(out[at : at + 20_000])
        template.words.forget()
        give_back()

    def found(keys, readings, number, words, places, bits):
        firsts = np.searchsorted(number, np.arange(len(keys) + 1))
        lengths = np.diff(firsts)
        # with a bitmap all widths of the items; without one the texts' own, which are shorter only in short texts
        for w in {width, *widths} if bits is not None else set(np.minimum(lengths, width).tolist()) - {0}:
            n = len(number) - w + 1
            if n <= 0:
                continue
            within = number[:n] == number[w - 1 :]
            if bits is None:
                within &= np.minimum(lengths, width)[number[:n]] == w
            first = None
            for k, (h, slot) in enumerate(readings):
                if k == 1 and w < width:
                    continue
                hashes = window_hashes(h, w)
                # a reading that differs from the first in no token of the window is the same window
                inside = within if first is None else within & (hashes != first)
                first = hashes if first is None else first
                at = np.flatnonzero(inside)
                if bits is not None:
                    for shift in PROBES:
                        place = (hashes[at] >> np.uint64(shift)).astype(np.int64) & (1 << BITMAP_BITS) - 1
                        at = at[(bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)) != 0]
                signed = hashes.view(np.int64)
                for i in at.tolist():
                    t = number[i]
                    yield *keys[t], int(signed[i]), int(i - firsts[t]), w, int(lengths[t]), slots_of(slot, words, places, i, w)

    def batch_of(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=NAMES)

    read = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    return read.mapInArrow(run, WINDOWS.format(key=kind.simpleString()))


def bitmap_of(items: DataFrame) -> np.ndarray:
    """Bits of the items' window hashes: 2 to the ``BITMAP_BITS`` bits however many windows there are."""
    probes = F.array(*[F.shiftrightunsigned("wh", k).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) for k in PROBES])
    places = items.select(F.explode(probes).alias("place"))
    word, bit = F.shiftright("place", 6), F.col("place").bitwiseAND(F.lit(63)).cast("int")
    marks = places.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    bits = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    for r in marks.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return bits


MET = ("diagonal", "at", "width", "slots", "other")
VERDICT = "struct<covered:bigint,longest:bigint,exact:boolean>"


def slot_pairs(slots: str, other: str | None) -> list[tuple[str, str]]:
    """(item value, document value) for each slot of a window, both sides having the same slots; ``other`` None: equal."""
    values = [x.partition("=")[2] for x in slots.split("\t")] if slots else []
    return list(zip(values, values if other is None else [x.partition("=")[2] for x in other.split("\t")], strict=True))


def consistent(met: list[tuple]) -> list[tuple]:
    """The windows of one diagonal whose slots are a one-to-one renaming there; windows with equal values always."""
    ahead, back = {}, {}
    pairs = [slot_pairs(slots, other) for _, _, _, slots, other in met]
    for a, b in chain.from_iterable(pairs):
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    single = lambda p: all(len(ahead[a]) == 1 == len(back[b]) for a, b in p)
    return [m for m, p in zip(met, pairs, strict=True) if m[4] is None or single(p)]


def longest_run(places: int) -> int:
    n = 0
    while places:
        places &= places << 1
        n += 1
    return n


def places_of(met: list[tuple]) -> int:
    """Item places that the windows cover, as bits."""
    out = 0
    for _, at, width, _, _ in met:
        out |= ((1 << width) - 1) << at
    return out


def verdict(met: list[tuple], tokens: int, min_cover: float, min_run: int) -> tuple[int, int, bool] | None:
    """(covered, longest run, exact) of the best match of an item in a document, or None. ``met`` is by diagonal.

    Every inserted or removed word shifts the diagonal, so the item places are added up over all diagonals in a stretch
    of the document of three times the item's length; a stretch starts at every multiple of that length. Diagonals join
    by their number of windows, and their windows must not contradict the renaming of those before.
    """
    stretches: dict[int, dict[int, list[tuple]]] = {}
    for diagonal, part in groupby(met, key=lambda m: m[0]):
        for m in consistent(list(part)):
            k = (diagonal + m[1]) // tokens
            for first in (k - 2, k - 1, k):
                stretches.setdefault(first, {}).setdefault(diagonal, []).append(m)
    best = None
    for by_diagonal in stretches.values():
        ahead, back = {}, {}
        places = own = longest = 0
        for _, part in sorted(by_diagonal.items(), key=lambda x: (-len(x[1]), x[0])):
            fits = lambda p: all(ahead.get(a, b) == b and back.get(b, a) == a for a, b in p)
            taken = [m for m in part if m[4] is None or fits(slot_pairs(m[3], m[4]))]
            for a, b in chain.from_iterable(slot_pairs(m[3], m[4]) for m in taken):
                ahead.setdefault(a, b)
                back.setdefault(b, a)
            here = places_of(taken)
            places |= here
            own |= places_of([m for m in taken if m[4] is None])
            longest = max(longest, longest_run(here))
        covered = places.bit_count()
        if covered >= min_cover * tokens or longest >= min_run:
            found = covered, longest, own == places
            best = found if best is None else tuple(map(max, best, found))
    return best


def _verdicts(min_cover: float, min_run: int):
    kind = pa.struct([("covered", pa.int64()), ("longest", pa.int64()), ("exact", pa.bool_())])

    def run(tokens: pa.Array, met: pa.Array) -> pa.Array:
        out = []
        for n, windows_met in zip(tokens.to_pylist(), met.to_pylist(), strict=True):
            v = verdict([tuple(m[k] for k in MET) for m in windows_met], n, min_cover, min_run)
            out.append(v and dict(zip(("covered", "longest", "exact"), v, strict=True)))
        return pa.array(out, kind)

    return run


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_cover: float = MIN_COVER,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """(key, item, covered, item_tokens, longest_run, exact) for each document and item that it contains.

    ``exact`` says that all that is covered is so with the item's own values. Windows of a passage that very many documents share meet
    few item rows each; the document side is not gathered by window, so adaptive execution can split it.
    """
    spark = docs.sparkSession
    items = materialise(windows(benchmark, item, item_text, window).withColumnsRenamed({"key": "item", "row": "item_row"}), "item-windows")
    short = [r["width"] for r in items.where(F.col("width") < window).select("width").distinct().collect()]
    bits = spark.sparkContext.broadcast(bitmap_of(items))
    found = windows(docs, key, text, window, bits, tuple(short))
    met = found.alias("d").join(items.alias("i"), (F.col("d.wh") == F.col("i.wh")) & (F.col("d.width") == F.col("i.width")))
    same = F.col("i.slots") == F.col("d.slots")
    met = met.select(
        F.col("d.key").alias("key"), "d.row", "i.item", "i.item_row", F.col("i.tokens").alias("item_tokens"), (F.col("d.at") - F.col("i.at")).alias("diagonal"),
        F.col("i.at").alias("at"), "i.width", F.col("i.slots").alias("slots"), F.when(~same, F.col("d.slots")).alias("other"),
    )
    # an equal row brings the same windows again; a set of windows is as long as the text times the item's repeats at most
    gathered = met.groupBy("key", "row", "item", "item_row", "item_tokens").agg(F.sort_array(F.collect_set(F.struct(*MET))).alias("met"))
    verdict = F.arrow_udf(_verdicts(min_cover, min_run), VERDICT)(F.col("item_tokens"), F.col("met"))
    judged = gathered.select("key", "item", "item_tokens", verdict.alias("v")).where(F.col("v").isNotNull())
    # each row of a key is judged by itself, and the best of them shown
    return judged.groupBy(F.col("key").alias(key), F.col("item").alias(item)).agg(
        F.max("v.covered").alias("covered"), F.max("item_tokens").alias("item_tokens"),
        F.max("v.longest").alias("longest_run"), F.max("v.exact").alias("exact"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item. Each is judged by itself, also where several share a key."""
    row = fresh("_row", docs.columns)
    named = docs.withColumn(row, row_key(key, text))
    bad = contaminations(named, benchmark, key=row, text=text, **how).select(row).distinct()
    return without(named, materialise(bad, "contaminated"), row).select(*docs.columns)
