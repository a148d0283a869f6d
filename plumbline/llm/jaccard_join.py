"""Set-similarity join of texts by their word n-grams: a grouped prefix join, as connected components.

1. A text becomes the sorted set of its n-gram hashes. Texts with equal sets are one class, and only a class's first
   row goes on.
2. All n-grams have one global order: first the *pool* (the n-grams whose hash falls in a fixed share of all values) by
   how many classes hold them, then the others by hash. Only pool n-grams are counted, so the counts are exact and shuffle
   a fixed share of the n-grams. Two sets with a Jaccard similarity of at least t share one of the first
   n - ceil(t * n) + 1 n-grams of that order, their prefixes. An n-gram held by a single class can't be shared and is
   never posted.
3. Classes of equal size and prefix are one group. Groups that share a prefix n-gram stand in that n-gram's list.
   Long lists (near copies, passages that many texts share) are not paired: their texts are ordered anew, with *all*
   n-grams in the pool, so that whatever is rare in a text fills its prefix, and posted again.
4. Entries of a list are candidates if their sizes and the n-gram's places in both prefixes allow the threshold. They are
   expanded to members, filtered by 1024-bit parity maps (the bits in which two maps differ are a lower bound of the
   sets' difference), and verified on the whole sets.

What is asked for are components, so a pair that is already connected needs no test. In lists of some length a few hubs
are tried first; afterwards pairs are formed only between entries of *different* components. A cluster of n near copies
thus costs a multiple of n and no link between components is ever lost: whatever the hubs leave is enumerated.

Defined results: a null or empty text, or one of white space, has no n-grams and is linked with nothing; fewer words
than n are one n-gram; repeated rows are classes of equal sets; a null key is linked like any other, and is a
component's name only if no other row of it has a key; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import BROADCAST_BLOCKS, block_count, bloom_blocks, possible_hits, split_by, without
from plumbline.llm.components import components
from plumbline.llm.rowkeys import fresh
from plumbline.llm.wordcache import WordCache
from plumbline.scale import materialise, split_join

MAP_WORDS = 16
HUBS = 4
#: Longer lists try hubs first, and still longer ones are first ordered anew. All ways find the same components.
SHORT_LIST = 16
LONG_LIST = 64
#: Texts whose sets a task holds at once.
TEXTS = 256


class Shingler:
    """Sorted arrays of distinct 64-bit n-gram hashes. Word hashes are kept in a bounded cache."""

    def __init__(self, n: int):
        self.n = n
        self.words = WordCache()

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII spaces part
        if not words:
            return np.empty(0, np.uint64)
        self.words.make_room()
        known = self.words.known
        if new := self.words.recall(set(words).difference(known)):
            self.words.note(new)
            for w in new:
                known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(ids))
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def pool_limit(percent: int) -> int:
    """The pool takes hashes below this: so many sixteenths of all that it has nearly twice the length of a prefix."""
    return max(1, min(7, round(16 * 1.9 * (100 - percent) / 100))) << 60


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_map(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


SKETCH = "key {key}, n bigint, sig binary, pool_size bigint, head array<bigint>, map array<bigint>"
WHOLE = "sig binary, grams array<bigint>"


def _per_batch(make, names, kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.wordcache import give_back

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                rows = [make(k, t) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return run


def sketches(docs: DataFrame, key: str, text: str, n: int, percent: int, all_in_pool: bool = False) -> DataFrame:
    """Per row: key, size and signature of its set, and the first n-grams of the global order that may be needed."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    arrow_key = to_arrow_type(kind)

    def run(batches):
        import xxhash

        shingle, limit = Shingler(n), np.uint64(pool_limit(percent))

        def make(k, t):
            h = shingle(t)
            pool = len(h) if all_in_pool else int(np.searchsorted(h, limit))
            head = h[: max(pool, prefix_length(len(h), percent))] if len(h) else h
            sig = xxhash.xxh3_128_digest(h.tobytes())
            return k, len(h), sig, pool, head.view(np.int64), parity_map(h)

        kinds = [arrow_key, pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield from _per_batch(make, ["key", "n", "sig", "pool_size", "head", "map"], kinds)(batches)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, SKETCH.format(key=kind.simpleString())
    )


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """Signature and whole set of each row of ``docs`` (key, text)."""

    def run(batches):
        import xxhash

        shingle = Shingler(n)

        def make(_, t):
            h = shingle(t)
            return xxhash.xxh3_128_digest(h.tobytes()), h.view(np.int64)

        yield from _per_batch(make, ["sig", "grams"], [pa.binary(), pa.list_(pa.int64())])(batches)

    return docs.select("key", "text").mapInArrow(run, WHOLE)


def prefixes(classes: DataFrame, sizes: DataFrame, percent: int, all_in_pool: bool = False) -> DataFrame:
    """Per class that shares a prefix n-gram: node, size, whether all of the prefix is shared, (n-gram, place) array.

    ``classes`` has (node, head), ``sizes`` (node, n, pool_size). A pool n-gram's place counts the pool n-grams that
    no other class has, which come first, and the rarer ones; one outside the pool comes after the whole pool.
    """
    posted = classes.select("node", F.explode("head").alias("gram"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = split_join(posted, counts, "gram")
    gathered = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    sized = gathered.join(sizes.select("node", "n", "pool_size"), "node")
    limit = pool_limit(percent)
    in_pool = lambda g: F.lit(True) if all_in_pool else (g.gram >= 0) & (g.gram < limit)
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    sized = sized.select(
        "node", "n", "pool_size", length.alias("length"),
        F.filter("grams", in_pool).alias("pool"), F.filter("grams", lambda g: ~in_pool(g)).alias("beyond"),
    )
    alone = F.col("pool_size") - F.size("pool")
    taken = F.greatest(F.least("length", "pool_size") - alone, F.lit(0)).cast("int")
    first = F.transform(
        F.slice("pool", F.lit(1), taken), lambda g, i: F.struct(g.gram.alias("gram"), (alone + i).alias("place"))
    )
    after = F.transform("beyond", lambda g: F.struct(g.gram.alias("gram"), F.col("pool_size").alias("place")))
    made = sized.select("node", "n", "length", F.concat(first, after).alias("prefix"))
    return made.where(F.size("prefix") > 0).withColumn("all_shared", F.size("prefix") == F.col("length"))


def posted_groups(prefixed: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Lists (list, entry, node, n, place) of a set of prefixes, and the members (entry, node) of their entries.

    Classes of equal size and prefix are one entry, represented by its smallest node. The members of a group are a
    list of their own, in which each stands for itself.
    """
    same = F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix.gram").cast("array<string>")), 256)
    keyed = materialise(prefixed.withColumn("same", F.when(F.col("all_shared"), same)), f"prefixes-{level}")
    groups = keyed.where("all_shared").groupBy("same").agg(F.min("node").alias("first"), F.count("*").alias("k"))
    joined = split_join(keyed, groups, "same", "left").withColumn("first", F.coalesce("first", "node"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}{level}:"), F.col(c))
    joined = materialise(joined.select("node", "n", "prefix", "first", "k"), f"grouped-{level}")
    across = joined.where("node = first").select(name("g", "first").alias("entry"), "node", "n", F.explode("prefix").alias("p"))
    across = across.select(name("s", "p.gram").alias("list"), "entry", "node", "n", "p.place")
    several = joined.where("k > 1")
    inner = several.select(
        name("m", "first").alias("list"), name("n", "node").alias("entry"), "node", "n", F.lit(0).cast("long").alias("place")
    )
    held = joined.select(name("g", "first").alias("entry"), "node").unionByName(several.select(name("n", "node").alias("entry"), "node"))
    return across.unionByName(inner), held


def sizes_allow(n1: Column, n2: Column, percent: int) -> Column:
    return (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))


def places_allow(a: str, b: str, percent: int) -> Column:
    """Even if all n-grams from the shared one on agree, the overlap must reach what the threshold asks for."""
    most = F.least(F.expr(f"{a}.n - {a}.place"), F.expr(f"{b}.n - {b}.place"))
    return most * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def near_maps(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose maps allow the threshold, with ``apart``, the bits in which they differ."""
    m = members.select("node", F.struct("n", "map").alias("s"))
    both = (
        pairs.join(m.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        .join(m.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    )
    apart = F.aggregate(
        F.zip_with("sa.map", "sb.map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    n1, n2 = F.col("sa.n"), F.col("sb.n")
    kept = both.withColumn("apart", apart).where(
        sizes_allow(n1, n2, percent) & (F.col("apart") * (100 + percent) <= (100 - percent) * (n1 + n2))
    )
    return kept.select(*pairs.columns, "apart")


def texts_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of some nodes, perhaps with a few others, and (node, sig) to join what is made of them.

    A Bloom filter of bounded size picks the rows to read; the exact join by signature has to follow.
    """
    wanted = materialise(rows.select("node", "key", "sig").join(nodes, "node"), "wanted")
    ids = wanted.select(F.xxhash64("key").alias("key"))
    n_blocks = min(block_count(wanted.count()), BROADCAST_BLOCKS)
    hashed = docs.withColumn("_id", F.col("key")).withColumn("key", F.xxhash64("key"))
    texts = possible_hits(hashed, bloom_blocks(ids, n_blocks), n_blocks).select(F.col("_id").alias("key"), "text")
    return texts, wanted.select("node", "sig")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose texts a and b link. Whole sets are made anew for the texts that are asked for only."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts, wanted = texts_of(asked, rows, docs)
    found = whole_sets(texts, n).join(wanted, "sig").select("node", "grams")
    sets = materialise(found.dropDuplicates(["node"]), "whole-sets")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    met = two.select(*pairs.columns, common.alias("i"), (F.size("ga") + F.size("gb") - common).alias("u"))
    return met.where(100 * F.col("i") >= percent * F.col("u")).select(*pairs.columns)


def hub_pairs(lists: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """For each node in a longer list the one hub of its lists that looks nearest.

    Half of the hubs have least before the shared n-gram, hence least of their own, as an original has among its near
    copies; the others are drawn by hash.
    """
    seed = [F.xxhash64("node", F.lit(k)) for k in range(HUBS)]
    first = [F.struct("place", seed[k], "node") if k % 2 == 0 else F.struct(seed[k], "node") for k in range(HUBS)]
    pick = [F.min(c)["node"].alias(f"h{k}") for k, c in enumerate(first)]
    hubs = lists.groupBy("list").agg(F.count("*").alias("size"), *pick).where(F.col("size") > SHORT_LIST)
    hubs = hubs.select("list", F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hubs"))
    met = split_join(lists.select("list", F.col("node").alias("a")), hubs, "list").select("a", F.explode("hubs").alias("b"))
    near = near_maps(met.where("a != b").distinct(), rows, percent)
    return near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))


def open_pairs(lists: DataFrame, held: DataFrame, rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of nodes in different components (a, b, ca, cb, apart), from all lists.

    In each list the component with most entries needs no pairs of its own: the others are joined with all. An entry
    whose members are in several components belongs to none and is joined with all.
    """
    named = split_join(held, labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    spread = named.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    spread = spread.select("entry", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("c"))
    entries = materialise(split_join(lists, spread, "entry"), "entries")
    sizes = entries.groupBy("list", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("list").agg(
        F.max(F.when(F.col("c").isNotNull(), F.struct("k", "c")))["c"].alias("main"),
        F.count("*").alias("kinds"),
        F.count_if(F.col("c").isNull()).alias("mixed"),
    )
    live = split_join(entries, main.where("kinds > 1 or mixed > 0"), "list")
    major = F.col("c").eqNullSafe(F.coalesce(F.col("main"), F.lit(-1)))
    live = materialise(live.select(*entries.columns, major.alias("major")), "live-entries")
    minor, other = live.where("not major").alias("x"), live.alias("y")
    differ = F.col("x.c").isNull() | F.col("y.c").isNull() | (F.col("x.c") != F.col("y.c"))
    fits = sizes_allow(F.col("x.n"), F.col("y.n"), percent) & places_allow("x", "y", percent)
    met = minor.join(other, (F.col("x.list") == F.col("y.list")) & (F.col("x.entry") != F.col("y.entry")) & differ & fits)
    one, two = F.least("x.entry", "y.entry").alias("one"), F.greatest("x.entry", "y.entry").alias("two")
    met = met.select(one, two).distinct()
    pairs = met.join(named.select(F.col("entry").alias("one"), F.col("node").alias("a"), F.col("component").alias("ca")), "one")
    pairs = pairs.join(named.select(F.col("entry").alias("two"), F.col("node").alias("b"), F.col("component").alias("cb")), "two")
    return near_maps(pairs.where("ca != cb").select("a", "b", "ca", "cb").distinct(), rows, percent)


def candidate_lists(rows: DataFrame, docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All lists and the members of their entries; long lists are replaced by those of a finer order of their texts."""
    classes = rows.where("n > 0").groupBy("sig").agg(F.min_by(F.struct("node", "head"), "node").alias("c")).select("c.*")
    lists, held = posted_groups(prefixes(classes, rows, percent), "1")
    lists = materialise(lists, "lists")
    long = lists.groupBy("list").agg(F.count("*").alias("k")).where(F.col("k") > LONG_LIST).select("list")
    long = materialise(long, "long-lists")
    if long.isEmpty():
        return lists, held
    crowded = split_join(lists, long, "list").select("entry").distinct().join(held, "entry").select("node").distinct()
    texts, wanted = texts_of(crowded, rows, docs)
    again = sketches(texts, "key", "text", n, percent, all_in_pool=True).drop("key").join(wanted, "sig")
    again = materialise(again.dropDuplicates(["node"]), "sketches-again")
    finer, more = posted_groups(prefixes(again.select("node", "head"), again, percent, all_in_pool=True), "2")
    rest = split_join(lists, long, "list", "left_anti")
    return materialise(rest.unionByName(finer), "lists"), held.unionByName(more)


def row_components(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """One written row per row of ``docs``: ``key, n, sig``, the signature of its set, and ``component``."""
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = sketches(read, "key", "text", n, percent).withColumn("node", F.monotonically_increasing_id())
    rows = materialise(made, "sketches")
    lists, held = candidate_lists(rows, read, n, percent)
    hubs = materialise(hub_pairs(lists, rows, percent), "hub-pairs")
    labels = components(verified(hubs, rows, read, n, percent))
    left = materialise(open_pairs(lists, held, rows, labels, percent), "open-pairs")
    for test_all in (False, True):
        if left.isEmpty():
            break
        # one pair for each text and component that it may join, and after that whatever is still open
        best = F.min_by(F.struct("b", "ca"), F.struct("apart", "b")).alias("p")
        tested = left if test_all else materialise(left.groupBy("a", "cb").agg(best).select("a", "p.*", "cb"), "tested")
        merged = components(verified(tested.select("a", "b", "ca", "cb"), rows, read, n, percent), "ca", "cb")
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = split_join(labels, to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        alone = split_join(merged, labels.select("node"), "node", "left_anti")
        labels = materialise(labels.unionByName(alone.select("node", "component")), "labels")
        if not test_all:
            rest = left.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            for c in ("ca", "cb"):
                to = merged.select(F.col("node").alias(c), F.col("component").alias("to"))
                rest = split_join(rest, to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
            left = materialise(rest.where("ca != cb"), "still-open")
    return _placed(rows, labels)


def linked_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links."""
    mine = row_components(docs, key, text, n, percent)
    names = mine.groupBy("component").agg(F.min("key").alias("component_id"))
    return split_join(mine, names, "component").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of classes carried to their rows."""
    slim = rows.select("key", "n", "sig", "node")
    classes = slim.where("n > 0").groupBy("sig").agg(F.min("node").alias("first"))
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("node"))
    placed = split_join(slim, classes, "sig", "left").withColumn("first", first)
    mine = split_join(placed, labels.select(F.col("node").alias("first"), "component"), "first", "left")
    return materialise(mine.select("key", "n", "sig", F.coalesce("component", "first").alias("component")), "placed")


def signature(text: Column, n: int) -> Column:
    """The signature of a text's set, as in ``row_components``."""

    def made(texts: pa.Array) -> pa.Array:
        import xxhash

        from plumbline.llm.jaccard_join import Shingler

        shingle = Shingler(n)
        return pa.array([xxhash.xxh3_128_digest(shingle(t).tobytes()) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(made, "binary")(text)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one document of each group of near duplicates.

    The row with the smallest key stays; of several with that key, the one whose set has the smallest signature, and of
    rows with equal key and set, one. Rows are judged one by one: a key may name several texts, of which some stay and
    some go. Rows without a key are kept as they are, and don't stand for others. Texts are not shuffled but for rows
    whose key may be among those that go or repeat.
    """
    named = row_components(docs, key, text, n, percent).where(F.col("key").isNotNull())
    first = named.groupBy("component").agg(F.min(F.struct("key", "sig")).alias("first"))
    stays = (F.col("key") == F.col("first.key")) & (F.col("sig") == F.col("first.sig"))
    judged = materialise(split_join(named, first, "component").select("key", "sig", stays.alias("stays")), "judged")
    by_key = judged.groupBy("key").agg(F.count("*").alias("k"), F.max("stays").alias("any"))
    gone = materialise(by_key.where(~F.col("any")).select(F.col("key").alias(key)), "gone")
    repeated = materialise(by_key.where(F.col("any") & (F.col("k") > 1)).select(F.col("key").alias(key)), "repeated")
    once, several = split_by(without(docs, gone, key), repeated, key)
    sig = fresh("_sig", docs.columns)
    standing = judged.where("stays").select(F.col("key").alias(key), F.col("sig").alias(sig)).distinct()
    told = several.withColumn(sig, signature(F.col(text), n))
    kept = split_join(told, standing, [key, sig], "left_semi").dropDuplicates([key, sig])
    return once.unionByName(kept.select(*docs.columns))
