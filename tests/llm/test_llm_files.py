"""Spelling variants, files of token ids and the Merkle manifest against plain Python versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_fixtures import hostile, llm, none  # noqa: F401
from oracle import connect
from plumbline.llm import bytetokens, idfiles, merkle, spelling
from plumbline.llm.queries import QUERIES
from plumbline.scale import shared_dir
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(BYTES)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants


def plain_words(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def variants(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_variants_of_chains_and_edges(llm):
    """Edits at both ends and in runs of equal letters, ties, chains of forms, accents, and long words."""
    base = ["letters", "letterss", "lettters", "etters", "metters", "lettere", "életters", "letterz", "lettez", "straße", "strasse", "strabe"]
    counts = [700, 5, 7, 130, 26, 25, 5, 25, 5, 30, 9, 6]
    long = "abc" * 700
    words = [*zip(base, counts), (long, 40), (long[:-1], 8), ("x" + long[1:], 5), (long[:999] + "é" + long[1000:], 6)]
    texts = [" ".join([w] * n) for w, n in words] + ["Letters LETTERS. rarely", "short words only"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = plain_variants(plain_words(enumerate(texts)))
    assert variants(spelling.group_variants(docs)) == want
    assert any(w != root and form != root for w, _, _, form, _, root in want)


def test_variants_of_hostile_rows(llm, hostile, none):
    docs = [(r.doc_id, r.text) for r in hostile.collect()]
    assert variants(spelling.group_variants(hostile)) == plain_variants(plain_words(docs))
    assert spelling.group_variants(none).count() == 0
    assert spelling.group_variants(none.unionByName(llm.createDataFrame([(1, "one two", "", "", 0)], none.schema))).count() == 0


def test_a_full_filter_only_costs_time(llm, monkeypatch):
    """With one block per shard nearly all edits pass, and the exact join still gives the same."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcdé"), rng.integers(6, 9))): int(rng.integers(5, 60)) for _ in range(250)}
    vocabulary = llm.createDataFrame(list(words.items()), "word string, n bigint")
    pairs = lambda: {(frozenset((r.word, r.near)), r.n + r.near_n) for r in spelling.near_words(vocabulary).collect()}
    want = {(frozenset((a, b)), words[a] + words[b]) for a in words for b in words if one_edit(a, b)}
    assert want and pairs() == want and spelling.near_words(vocabulary).count() == len(want)
    small = spelling.Layout({6: 10**7, 7: 10**7}, max_bytes=spelling.SHARDS * 64 * 2)
    assert small.blocks.sum() * 64 <= spelling.SHARDS * 64 * 2
    monkeypatch.setattr(spelling.Layout.__init__, "__defaults__", (0.5, 64 * 80))
    assert pairs() == want


def test_filters_pass_every_word():
    rng = np.random.default_rng(5)
    words = list({"".join(rng.choice(list("abcdefghij"), 8)) for _ in range(5_000)})
    layout = spelling.Layout({8: len(words)})
    bits = np.zeros((int(layout.blocks.sum()), spelling.BLOCK_WORDS), np.uint64)

    def mixed(some):
        ((_, codes),) = spelling.codes_by_length(some)
        return spelling.mix((codes * spelling.powers(8)).sum(1, dtype=np.uint64))

    m = mixed(words)
    for i in range(spelling.PROBES):
        word, bit = spelling.probe(m, i)
        np.bitwise_or.at(bits, (layout.block(m, 8), word), bit)
    assert len(spelling.held_by(m, 8, layout, bits)) == len(words)
    others = [w[::-1] for w in words if w[::-1] not in set(words)]
    assert len(spelling.held_by(mixed(others), 8, layout, bits)) < len(others) // 100


# --- files of token ids


def test_ranks_of_all_widths():
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (np.random.default_rng(n).random(n) ** 6 * 2**32).astype(np.uint32)
        control, data = idfiles.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        got = idfiles.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert got.tolist() == ranks.tolist()
    edges = np.asarray([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    control, data = idfiles.encode_ranks(edges)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert idfiles.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 8).tolist() == edges.tolist()


def test_blocks():
    ranks = np.arange(10, dtype=np.uint32) * 100
    block = idfiles.write_block(3, 1, [None, 5, 5], [1, 0, 9], ranks) + b"\n"
    (a, b) = idfiles.read_blocks(block * 2)
    assert a[:3] == b[:3] == (3, 1, [None, 5, 5]) and a[3].tolist() == [1, 0, 9] and a[4].tolist() == ranks.tolist()
    for damaged in (b"?" + block[1:], block[:-1], block[:-4] + block[-3:]):
        with pytest.raises(ValueError):
            list(idfiles.read_blocks(damaged + block))


def test_chunks_have_the_ids_of_whole_texts():
    e = bytetokens.ByteEncoder(BYTES)
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\nb c", "a \n b", "a\tb c\x1cd e", "it's don't 'tis x's y", "a\u00a0b c\u3000d e",
           "\n", "\n\n", "\na\n", "<|endoftext|> x <|endoftext|>y", "a\r\nb c", "x\x85y z", "12 3 4.5,6 - -- b", " \n\n a  \n", "Ġa ĠĠ",
           "\U0001f600 b\u200bc d", "  lead", "tail  ", "don't, (don't) 'we'll' \"we'll\". e\u0301 é ŉ", "x" * 5_000, "word.)word word'. word's, 一二 ١٢"]
    for t in [*odd, "\n".join(odd), " ".join(odd), " ".join(odd * 40)]:
        assert e.batch([t])[0].tolist() == e.whole(t).tolist(), t
    assert [i.tolist() for i in e.batch(odd)] == [e.whole(t).tolist() for t in odd]
    e.words.max_bytes = 1 << 16
    for k in range(30):
        text = " ".join(f"w{k}x{i}, {chr(97 + k % 26)}b" for i in range(500))
        assert e.batch([text])[0].tolist() == e.whole(text).tolist() and len(e.words.known) + len(e.words.older) < 3_000
    other = bytetokens.ByteEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_chunk and other.batch(["It's A b", ""])[0].tolist() == other.whole("It's A b").tolist()


def test_words_are_learnt_without_the_sign_behind_them():
    """And once for all texts: a word with four signs behind it is looked up as itself, in any text."""
    e = bytetokens.ByteEncoder(BYTES)
    texts = ["say word, word. word; word", "é, ŉ. word!? word. \tx", "", "word, on\nword, x: y", "3, 4. a-, b\u00a0c, d", "one word."]
    assert [i.tolist() for i in e.batch(texts)] == [e.whole(t).tolist() for t in texts]
    assert "word" in e.words.known and not {"word,", "word.", "word;"} & e.words.known.keys()
    assert [e.batch([t])[0].tolist() for t in texts] == [e.whole(t).tolist() for t in texts]


def test_texts_are_cut_between_letters_and_signs():
    """Whatever stands behind the sign, so that a word is learnt once; added tokens and apostrophes stay whole."""
    e = bytetokens.ByteEncoder(BYTES)
    texts = ["see word-x word$$$ word.x@word.y (word)", "word<|endoftext|>word|> don't word'; word×word÷é·ŗ", None, "word"]
    got = [(ids.tolist(), stops.tolist()) for ids, stops in e.columns(pa.array(["gone", *texts, "word"]).slice(1, 4), end=2)]
    want = [[*e.whole(t or "").tolist(), 2] for t in texts]
    assert got == [(sum(want, []), np.cumsum(list(map(len, want))).tolist())]
    assert "word" in e.words.known and not {"word-x", "word$$$", "word.x@word.y"} & e.words.known.keys()


def test_white_space_in_one_chunk_moves_no_ids_to_another():
    for t in ["b .\nwordx \n b", "\n word\na", "\n\t\n \na\n.\na."]:
        e = bytetokens.ByteEncoder(BYTES)
        for _ in range(2):
            assert e.batch([t])[0].tolist() == e.whole(t).tolist(), t


def test_chunks_of_texts_of_all_kinds_of_white_space(monkeypatch):
    e = bytetokens.ByteEncoder(BYTES)
    white = "\t\r\x0b\x1c\x1f\x85\xa0\u1680\u2000\u200a\u2028\u202f\u205f\u3000"
    some = [*"    \n\n", *white, *"aZéŉɏ×÷ĳ12٣।あ”\u200b\u0301\U0001f600.,;'-_|<>\"", "'s", "'ll", "word", "<|endoftext|>", "<|"]
    rng = np.random.default_rng(7)
    texts = [" \nx", "\nx", "x", " x", *("".join(rng.choice(some, rng.integers(0, 30))) for _ in range(3_000))]
    want = [e.whole(t).tolist() for t in texts]
    assert [i.tolist() for i in e.batch(texts)] == want
    monkeypatch.setattr(bytetokens, "CUT_BYTES", 50)
    assert [i.tolist() for i in bytetokens.ByteEncoder(BYTES).batch(texts)] == want


def test_the_words_of_a_worker_are_dropped():
    first = bytetokens.byte_encoder(BYTES)
    first.batch(["some words"])
    assert bytetokens.byte_encoder(BYTES) is first
    bytetokens.drop_words()
    assert bytetokens.byte_encoder.cache_info().currsize == 0 and not bytetokens.byte_encoder(BYTES).words.known


def plain_files(docs):
    ids = [(k, [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in docs]
    out, at = [], 0
    for k, i in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((k, at, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())))
        at += len(i)
    return out


def test_files_of_whole_tables(spark, sf):
    docs = connect(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf).collect())
    assert got == plain_files(docs)


def test_files_of_hostile_rows(llm, hostile, none, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_BLOCKS", 2)
    got = sorted(idfiles.round_trip(hostile.repartition(5), BYTES).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = plain_files([(r.doc_id, r.text) for r in hostile.collect()])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, n, c) for k, _, n, c in want)
    assert idfiles.round_trip(none, BYTES).count() == 0


def test_ids_come_back_and_common_ids_are_short(llm, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = shared_dir(spark, "test-ids")
    idfiles.save(idfiles.encode(docs, BYTES), path)
    read = {r._key: np.frombuffer(r.ids, "<u4").tolist() for r in idfiles.decode(spark, path).collect()}
    for r in docs.limit(20).collect():
        assert read[r.doc_id] == [*WHOLE.encode(r.text, add_special_tokens=False).ids, 2]
    n = sum(map(len, read.values()))
    size = sum(len(r.content) for r in idfiles.load_bytes(spark, f"{path}/blocks").collect())
    assert size < 1.8 * n


# --- Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, tampered=False):
    values = list(row)
    if tampered and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
        values[4] = row[4].translate(LOW)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """(last node, siblings of each node from below up as [(before, after)])"""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            paths[i].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        at = [a // 8 for a in at]
        level = [H("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = own, *plain_tree([plain_leaf(r) for r in own])
    root, above = plain_tree([trees[lang][1] for lang in order])
    out = []
    for lang, up in zip(order, above, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            node = plain_leaf(r, tampered=True)
            for before, after in path + up:
                node = H(before + node + after)
            out.append((r[0], plain_leaf(r), subroot, root, H("".join(a + b for a, b in path + up)), node, node == root))
    return out


def manifest_of(docs):
    written = merkle.leaves_of(docs, keep=["doc_id", "lang"], _presented=merkle.tampered())
    made = merkle.build(written, "lang", "doc_id")
    return made, merkle.digest(merkle.proofs(made), made.root)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 65, 1], [513, 3, 512, 1, 2, 8, 1, 9, 1, 700]])
def test_manifest_of_many_shapes(llm, sizes):
    """Lone leaves and subroots, full and broken runs, more than eight groups, and heights that differ."""
    langs = [None, "", "z", "é", "Z", "a", "ab", "\U0001f600", "￿", "b"]
    rows = [(i * 7 % 10_007, "s", langs[g], None if i % 5 else i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = llm.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    _, got = manifest_of(docs)
    assert sorted(map(tuple, got.collect())) == sorted(plain_manifest(rows))


def test_manifest_of_hostile_rows(llm, hostile, none):
    _, got = manifest_of(hostile)
    want = plain_manifest([tuple(r) for r in hostile.select(*FIELDS).collect()])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    made, got = manifest_of(none)
    assert made.root is None and got.count() == 0
    same = llm.createDataFrame([(1, "A")] * 600 + [(2, "B")], "doc_id bigint, text string").select(
        "doc_id", F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), "text"
    )
    _, got = manifest_of(same)
    assert Counter(map(tuple, got.collect())) == Counter(plain_manifest([(r.doc_id, "s", "en", 1, r.text) for r in same.collect()]))


def test_proofs_of_some_leaves(llm, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made, _ = manifest_of(docs)
    some = merkle.proofs(made, made.leaves.where("doc_id % 41 = 3"))
    folded = some.select("doc_id", merkle.fold(F.col("_leaf"), F.col("_path")).alias("r"), F.size("_path").alias("n")).collect()
    assert {r.doc_id for r in folded} == {r.doc_id for r in docs.where("doc_id % 41 = 3").collect()}
    assert {r.r for r in folded} == {made.root} and len(folded) > 1
    wrong = some.select(merkle.fold(F.sha2(F.col("_leaf"), 256), F.col("_path")).alias("r")).collect()
    assert made.root not in {r.r for r in wrong}
