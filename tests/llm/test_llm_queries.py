"""Registered queries against their SQL or a plain Python version, over whole tables."""

import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from oracle import connect, difference
from plumbline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


def test_secrets(spark, sf, docs):
    got = {r[0]: list(r[1:5]) for r in QUERIES["op1_secret_scan"](spark, sf).collect()}
    assert got == {i: brute.spans(t, brute.SECRETS) for i, t in docs}


def test_token_counts(spark, sf, docs):
    from plumbline.llm.token_counts import byte_encoder

    encoding, _ = byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in docs}


def plain_sections(text, encoding):
    """Sections and their tokens, a token at a time: the section with most of a token's characters gets it, the earlier
    one of equals. A character belongs to the token with its first byte; a token that only continues one lies there."""
    cuts = [m.end() for m in re.finditer(r"[.!?] |\n", text)]
    starts = [0, *cuts] if not cuts or cuts[-1] < len(text) else [0, *cuts[:-1]]
    stops = [*starts[1:], len(text)]
    of_byte = [i for i, c in enumerate(text) for _ in range(len(c.encode()))]
    tokens, crossing, at, end = [0] * len(starts), [0] * len(starts), 0, 0
    for token in encoding.encode_ordinary(text):
        at += len(encoding.decode_single_token_bytes(token))
        first, end = end, of_byte[at - 1] + 1
        first = min(first, end - 1)
        parts = [max(0, min(b, end) - max(a, first)) for a, b in zip(starts, stops)]
        tokens[parts.index(max(parts))] += 1
        held = [k for k, p in enumerate(parts) if p]
        for k in held if len(held) > 1 else ():
            crossing[k] += 1
    return list(zip(starts, stops, tokens, crossing))


def test_sections_and_their_tokens(spark, sf, docs):
    """Every section's count, the crossing tokens and the checksum, over the whole table."""
    import hashlib

    from plumbline.llm.token_counts import byte_encoder

    encoding, _ = byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    crossed = 0
    for i, t in docs:
        want = plain_sections(t, encoding) if t else []
        r = got[i]
        digest = hashlib.sha256(",".join(f"{a}:{b}:{n}" for a, b, n, _ in want).encode()).hexdigest()
        assert (r.n_sections, r.n_tokens, r.n_crossing) == (len(want), sum(w[2] for w in want), sum(w[3] for w in want)), i
        assert r.sections_sha256 == digest and r.largest_section == max((w[2] for w in want), default=0)
        crossed += r.n_crossing > 0
    assert crossed > 10


def test_owners_and_repositories_of_secrets(spark, sf):
    """Both frequencies and the verdict of every value, counted anew, over the whole table with planted values."""
    from plumbline.llm import secret_scan
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = F.concat(F.lit(" token = Zk3bQ9xLm2VtR7"), (F.col("doc_id") % 12).cast("string"), F.lit(" and Zq8hX2mVb5KjW4tRc7YpL0dGs9NfA1eUoQ"), F.col("doc_id"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), planted)).otherwise(F.col("text")))
    rows = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs).collect()}
    owners, repositories = defaultdict(set), defaultdict(set)
    for i, r in rows.items():
        for _, _, _, digest, _ in secret_scan.scan(r.text):
            owners[digest].add(r.source)
            repositories[digest].add((r.source, r.lang))
    kinds, verdicts = set(), set()
    for i, r in rows.items():
        want = []
        for kind, a, b, digest, random in secret_scan.scan(r.text):
            live = random and len(owners[digest]) <= 2 and len(repositories[digest]) <= 4
            if kind < 3 or live:
                want.append((kind, a, b, digest, len(repositories[digest]), len(owners[digest]), live))
        got = sorted((s.kind, s.start, s.stop, s.hash, s.n_repositories, s.n_owners, s.live) for s in found[i])
        assert got == sorted(want), i
        kinds |= {w[0] for w in want}
        verdicts |= {w[6] for w in want}
    assert kinds >= {0, 3} and verdicts == {True, False}


def check_packing(pieces, texts):
    """Every id in one piece, sequences gapless, at most 2048 tokens, little padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(parts) == set(texts)
    for i, text in texts.items():
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and all(p.sequence_tokens == at for p in held)
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= total // 100


def test_packing(spark, sf, docs):
    check_packing(QUERIES["op4_cost_balanced_packing"](spark, sf).collect(), dict(docs))


def test_contaminated_documents(spark, sf, con, docs):
    core = lambda t: " ".join(filter(None, (re.sub(r"^\W+|\W+$", "", w).lower() for w in (t or "").split())))
    items = [(i, core(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in docs for i, b in items if f" {b} " in f" {core(t)} "}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    assert want and got == want


def test_main_text(spark, sf, con):
    import html

    def article(source):
        inside = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts)
        return "\n".join(filter(None, blocks))

    got = {r.page_id: r.text for r in QUERIES["op8_html_extract"](spark, sf).collect()}
    assert got == {i: article(h) for i, h in con.execute("SELECT page_id, html FROM pages").fetchall()}


def test_linked_documents(spark, sf, docs):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op9_jaccard_join"](spark, sf).collect()}
    assert got == brute.components(docs, 3, 90)


def test_personal_data(spark, sf, docs):
    got = {r[0]: list(r[1:6]) for r in QUERIES["op10_personal_data"](spark, sf).collect()}
    assert got == {i: brute.spans(t, brute.PERSONAL) for i, t in docs}
