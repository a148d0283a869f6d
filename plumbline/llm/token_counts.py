"""Token counts of a text's sections, from offsets of one encoding of the whole text.

A document is encoded once. Each token's character span is joined with the spans of the sections; a token belongs to
the section that holds most of its characters, and to the earlier one if two hold as many. So the counts of the
sections always add up to the tokens of the document, which counting the sections apart would not give: a token that
crosses a boundary would become two.

Sections are non-overlapping spans in ascending order that cover the text; by default each sentence and each line is one,
with the space or line feed behind it, which tokens that begin with a space then cross. A section of no characters gets
no tokens. Tokens that hold part of a character only (bytes of one
character) lie where that character lies.

Defined results: a null or empty text has no tokens and no sections; a null key, repeated rows and extra columns do no
harm, as each row is counted by itself; an empty table gives an empty result. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A section ends behind a line feed and behind the space that follows a sentence.
SENTENCE = re.compile(r"[.!?] |\n")
SECTION = "struct<start:bigint,stop:bigint,n_tokens:bigint,n_crossing:bigint>"


@functools.lru_cache(2)
def byte_encoder(path: str, pattern: str):
    """An encoding from a file of ranks, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def section_starts(text: str, boundary: re.Pattern = SENTENCE) -> np.ndarray:
    """Where the sections of a text start, in characters; one of no characters at the end is none."""
    starts = [0, *(m.end() for m in boundary.finditer(text))]
    return np.asarray(starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts, np.int64)


def allocate(token_ends: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens shared with a neighbour) of each section; all positions on one scale.

    The interval join: a token's first and last section come from two searches in the sorted starts. For a token that
    lies in several, the widths of its parts are compared; the widest wins, the first of equals.
    """
    # a token that only continues a character lies where that character does
    token_starts = np.minimum(np.concatenate([[0], token_ends[:-1]]), np.maximum(token_ends - 1, 0))
    first = np.searchsorted(starts, token_starts, "right") - 1
    last = np.searchsorted(starts, np.maximum(token_ends - 1, token_starts), "right") - 1
    owner = first.copy()
    two = np.flatnonzero(last == first + 1)
    cut = starts[last[two]]
    owner[two] = np.where(token_ends[two] - cut > cut - token_starts[two], last[two], first[two])
    crossing = np.bincount(first[two], minlength=len(starts)) + np.bincount(last[two], minlength=len(starts))
    stops = np.append(starts[1:], end)
    for t in np.flatnonzero(last > first + 1):
        held = np.arange(first[t], last[t] + 1)
        parts = np.minimum(stops[held], token_ends[t]) - np.maximum(starts[held], token_starts[t])
        owner[t] = held[np.argmax(parts)]
        crossing[held] += 1
    return np.bincount(owner, minlength=len(starts)), crossing


def count_sections(text: str, encoding, widths: np.ndarray, starts: np.ndarray | None = None) -> list[tuple]:
    """(start, stop, tokens, crossing tokens) of every section of one text, in characters."""
    if not text:
        return []
    starts = section_starts(text) if starts is None else starts
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths[np.asarray(encoding.encode_ordinary(text), np.int64)])
    # a byte belongs to the character that it begins or continues
    character = np.cumsum((data & 0xC0) != 0x80)
    tokens, crossing = allocate(character[ends - 1], starts, len(text))
    stops = np.append(starts[1:], len(text))
    return list(zip(starts.tolist(), stops.tolist(), tokens.tolist(), crossing.tolist(), strict=True))


def sections(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text") -> Column:
    """Array of the sections of the text with their token counts.

    ``tokenizer`` is the path of a file of token ranks that every executor has, ``pattern`` its pre-tokenizer's.
    """
    kind = pa.struct([(n, pa.int64()) for n in ("start", "stop", "n_tokens", "n_crossing")])

    def counted(texts: pa.Array) -> pa.Array:
        from plumbline.llm.token_counts import byte_encoder, count_sections

        encoding, widths = byte_encoder(tokenizer, pattern)
        offsets, rows = [0], []
        for t in texts.to_pylist():
            rows += count_sections(t or "", encoding, widths)
            offsets.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(counted, f"array<{SECTION}>")(F.col(text))


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``sections`` for every row of ``docs``. Nothing is shuffled."""
    return docs.select(key, sections(docs, tokenizer, pattern, text).alias("sections"))


def digest(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sums over the sections, and a checksum of ``start:stop:tokens`` of all of them."""
    total = lambda name: F.aggregate(
        "sections", F.lit(0).cast("long"), lambda s, x: s + x[name]
    )
    rows = F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s.start, s.stop, s.n_tokens)), ",")
    return counted.select(
        key,
        total("n_tokens").alias("n_tokens"),
        F.size("sections").cast("long").alias("n_sections"),
        total("n_crossing").alias("n_crossing"),
        F.coalesce(F.array_max(F.transform("sections", lambda s: s.n_tokens)), F.lit(0)).alias("largest_section"),
        F.sha2(rows, 256).alias("sections_sha256"),
    )
