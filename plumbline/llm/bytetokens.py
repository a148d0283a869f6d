"""Whole-text ids of a byte-level tokenizer, looked up by what stands between single spaces.

The usual pattern of byte-level tokenizers always cuts before a space that stands between two other characters, on both
sides of a line feed that does, and between a letter and a sign other than an apostrophe, and no merge crosses a cut. So a
text's ids are those of its chunks, one after the other, and chunks come back. Ids of chunks are kept in a cache bounded
in bytes; chunks that it lacks are encoded together by the tokenizers library, with line feeds between them, whose own ids
tell them apart. The cuts of many texts are found in their UTF-8 bytes at once and the chunks told apart in Arrow, so each
is looked up once for all of them, and no text is handled by itself. Where in doubt a cut is left out, which makes a chunk
longer and changes no id.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.wordcache import WordCache, give_back

#: Words that are one pre-token behind a space, and signs that are one behind a word.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands before a chunk that has no space before it; no other chunk begins with it.
BARE = "\n"
TOGETHER = 1024
#: Bytes of texts that are cut together, so that a chunk that comes back is looked up once; a longer text is cut alone.
CUT_BYTES = 1 << 22
#: Ids are dear to make again, and the files of ids are written by a job of its own.
ID_CACHE_BYTES = 192 << 20


def letters_of_bytes() -> dict[str, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {**{chr(b): chr(b) for b in shown}, **{chr(b): chr(256 + k) for k, b in enumerate(others)}}


LETTERS = letters_of_bytes()
#: A line feed stays, to part the words.
LETTERS_OF = str.maketrans({k: v for k, v in LETTERS.items() if k != "\n"})


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer is byte-level with the usual pattern, and changes nothing before or after."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or [])
    )


def classes(members: Iterable[int]) -> np.ndarray:
    """For each byte whether it is one of ``members``."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: White space of one byte, with some that only Python takes for it; first bytes of longer white space.
WHITE, WHITE_FIRST = classes([*range(9, 14), *range(28, 33)]), classes([0xC2, 0xE1, 0xE2, 0xE3])
LONG_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Letters of one byte, and first bytes of U+00C0 to U+023F, which are letters but for two that end in these bytes.
LETTER, LETTER_FIRST, NO_LETTER_LAST = classes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), classes(range(0xC3, 0xC9)), (0x97, 0xB7)


def white_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts whether it belongs to white space."""
    white = WHITE[data]
    firsts = np.flatnonzero(WHITE_FIRST[data])
    if len(firsts):
        padded = np.append(data[: firsts[-1] + 3], np.zeros(2, np.uint8))
        for c in LONG_WHITE:
            at = firsts
            for k, byte in enumerate(c):
                at = at[padded[at + k] == byte]
            for k in range(len(c)):
                white[at + k] = True
    return white


def chunk_starts(data: np.ndarray, starts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Places where chunks begin, ascending, in the UTF-8 bytes of texts that begin at ``starts``, none of them empty."""
    white = white_bytes(data)
    feed = data == 10
    cut = feed | (data == 32)
    cut[1:] &= ~white[:-1]
    cut[:-1] &= ~white[1:]
    cut[starts] = False
    cut[starts[1:] - 1] = False
    cut[-1:] = False
    feed &= cut
    letter = LETTER[data]
    letter[1:] |= LETTER_FIRST[data[:-1]] & (data[1:] != NO_LETTER_LAST[0]) & (data[1:] != NO_LETTER_LAST[1])
    cut[1:] |= feed[:-1] | letter[:-1] & signs[data[1:]]
    cut[starts] = True
    return np.flatnonzero(cut)


def told_apart(data: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct chunks, as they are behind a space and with ``BARE`` before them otherwise, and the one at each place."""
    offsets = np.append(starts, len(data))
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    told = flat.dictionary_encode()
    distinct = told.dictionary
    spaced = pc.and_not(pc.starts_with(distinct, " "), pc.starts_with(distinct, f" {BARE}"))
    names = pc.if_else(spaced, pc.binary_replace_slice(distinct, 0, 1, ""), pc.binary_replace_slice(distinct, 0, 0, BARE))
    return names.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy()  # much faster than to_pylist


def bounded(names: list[str]) -> Iterator[list[str]]:
    """Names in portions of a bounded number, which are small unless a name is long itself."""
    for at in range(0, len(names), TOGETHER):
        yield names[at : at + TOGETHER]


def as_it_stands(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == BARE else " " + chunk


class ByteEncoder:
    """Ids as unsigned 32-bit numbers. Texts of a tokenizer that reads in another way are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = cuts_at_spaces(spec)
        # an added token is one piece, whatever it holds
        kept = "'" + "".join(t["content"] for t in spec.get("added_tokens") or [])
        self.signs = classes(ord(c) for c in SIGNS if c not in kept)
        self.feed = self.whole("\n")
        self.by_chunk = self.by_chunk and len(self.feed) == 1
        self.words = WordCache(ID_CACHE_BYTES)
        self.usual = self.tokenizer.pre_tokenizer
        #: For words that are one pre-token each and are written in the letters of bytes beforehand.
        self.plain = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values())
        self.begins = np.zeros(self.largest + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(LETTERS[" "])]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def remember(self, names: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bool:
        """Put the parts of ``ids`` into the cache, if there are as many as names."""
        if len(starts) != len(names) or len(stops) != len(names):
            return False
        data = ids.tobytes()
        cut = map(slice, (4 * starts).tolist(), (4 * stops).tolist())
        self.words.known.update(zip(names, map(data.__getitem__, cut), strict=True))
        return True

    def learn(self, missing: set[str]) -> None:
        """Put chunks into the cache: words many at once, words with signs behind them in two parts, others as they are."""
        known = self.words.known
        parts, rest = {}, set()
        words = set(filter(WORD.fullmatch, missing))
        for c in missing - words:
            bare = c[:1] == BARE
            core = c.rstrip(SIGNS)
            if not WORD.fullmatch(core, bare):
                rest.add(c)
                continue
            if len(core) < len(c):
                tail = BARE + c[len(core) :]
                parts[c] = core, tail
                if tail not in known:
                    rest.add(tail)
            if core not in known:
                (rest if bare else words).add(core)
        self.words.note(missing)
        self.words.note(words - missing)
        self.tokenizer.pre_tokenizer = self.plain
        # words of ASCII letters are their own letters of bytes
        for some in bounded(sorted(words, key=str.isascii)):
            shown = f"\n{LETTERS[' ']}".join(some)
            if not shown.isascii():
                shown = "\n ".join(some)
                shown = shown if shown.isascii() else shown.encode().decode("latin-1")
                shown = shown.translate(LETTERS_OF)
            ids = self.whole(LETTERS[" "] + shown)
            starts = np.flatnonzero(self.begins[ids])
            if not self.remember(some, ids, starts, np.append(starts[1:], len(ids))):
                rest.update(some)
        self.tokenizer.pre_tokenizer = self.usual
        # white space inside may swallow a line feed between chunks, or hold one
        apart = [c for c in rest if not c or re.search(r"\s", c[c[:1] == BARE :])]
        for names in bounded(list(rest.difference(apart))):
            ids = self.whole("\n".join(map(as_it_stands, names)))
            cuts = np.flatnonzero(ids == self.feed[0])
            if not self.remember(names, ids, np.append(0, cuts + 1), np.append(cuts, len(ids))):
                apart += names
        for names in bounded(apart):
            made = self.tokenizer.encode_batch_fast(list(map(as_it_stands, names)), add_special_tokens=False)
            known.update((c, np.asarray(m.ids, np.uint32).tobytes()) for c, m in zip(names, made, strict=True))
        for c, (core, tail) in parts.items():
            known[c] = known[core] + known[tail]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for ids, stops in self.columns(pa.array(texts, pa.large_string())):
            out += map(ids.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist()))
        return out

    def columns(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of texts, one after the other, and where those of each text end; null is empty. ``end`` goes behind each text.

        A bounded number of bytes is looked at together.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        closing = np.asarray([] if end is None else [end], np.uint32)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CUT_BYTES, "right")) - 1)
            if self.by_chunk:
                yield self.some(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], closing)
            else:
                made = [np.append(self.whole(t), closing) for t in texts[lo:hi].to_pylist()]
                yield np.concatenate(made).astype(np.uint32), np.cumsum(list(map(len, made)))
            lo = hi

    def some(self, data: np.ndarray, offsets: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends for ``columns``, of texts that lie side by side in ``data``."""
        self.words.make_room()
        known = self.words.known
        starts = chunk_starts(data, offsets[:-1][np.diff(offsets) > 0], self.signs)
        names, which = told_apart(data, starts)
        made = list(map(known.get, names))
        gaps = [k for k, m in enumerate(made) if m is None]
        if missing := self.words.recall({names[k] for k in gaps}):
            self.learn(missing)
        for k in gaps:
            made[k] = known[names[k]]
        stops = np.searchsorted(starts, offsets[1:])
        if len(closing):
            made.append(closing.tobytes())
            which = np.insert(which, stops, len(names))
            stops = stops + np.arange(1, len(stops) + 1)
        taken = pa.array(made, pa.large_binary()).take(pa.array(which, pa.int32()))
        if not len(taken):
            return np.zeros(0, np.uint32), stops
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
        return np.frombuffer(taken.buffers()[2] or b"", np.uint32, int(ends[-1])), ends[stops]


@functools.lru_cache(1)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def drop_words() -> None:
    """Drop this worker's encoder and its words, if it has one."""
    if byte_encoder.cache_info().currsize:
        byte_encoder.cache_clear()
        give_back()
