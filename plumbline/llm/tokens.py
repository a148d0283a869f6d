"""Whole-text token ids, made inside tasks. Tokenizer files are named by a path and loaded once per worker."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from plumbline.llm.wordcache import WordCache, give_back

#: Characters that keep a text from being cut at its spaces or lower-cased beforehand: other spaces and separators,
#: the dotted capital I, anything past the Latin blocks (it may combine or depend on its neighbours), and the opening
#: of special tokens.
ENTANGLED = re.compile("[\x1c-\x1f\x85\xa0İɐ-\U0010ffff]|<\\|")
SIMPLE = re.compile("[a-zß-öø-ÿ]+")
#: Words whose pre-tokens are runs of letters, single digits and runs of other signs; an apostrophe may do otherwise.
PLAIN = re.compile("[!-&(-~ß-öø-ÿ]+")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: How a tokenizer must read for its texts to be cut at spaces and looked up word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ids are dear to make again, so their cache is larger than others.
ID_CACHE_BYTES = 192 << 20
#: Texts encoded in one call, and the characters after which a call ends.
TEXTS, CHARS = 128, 1 << 20


def reads_word_by_word(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space, cuts by ``PATTERN`` and ends words with a mark of their own."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model = spec.get("model") or {}
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(pre) == 2
        and pre[0].get("pattern") == {"Regex": PATTERN}
        and pre[0].get("behavior") == "Removed"
        and pre[0].get("invert") is True
        and pre[1].get("type") == "ByteLevel"
        and not pre[1].get("add_prefix_space", True)
        and pre[1].get("use_regex") is False
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and not spec.get("post_processor")
        and all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in spec.get("added_tokens") or [])
    )


class WordEncoder:
    """Ids of a tokenizer whose pieces never span white space, word by word from a cache bounded in bytes.

    The ids are those of encoding the whole text; words that the cache lacks are encoded together, and any text that
    can't safely be cut at spaces is encoded as it stands. So is every text of a tokenizer that reads in another way.
    Ids are kept and returned as unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            self.by_word = reads_word_by_word(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.usual = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        #: For simple words in lower case, on which the normalizer and the pattern of pre-tokens change nothing.
        self.plain = None, pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = WordCache(ID_CACHE_BYTES)

    def read_as(self, way: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = way

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: simple ones many at once, plain ones piece by piece, others one by one."""
        cache = self.words.known
        self.words.note(words)
        pieces = {w: PIECE.findall(w) for w in words if not SIMPLE.fullmatch(w) and PLAIN.fullmatch(w)}
        alone = {p for parts in pieces.values() for p in parts if p not in cache}
        alone.update(words.difference(pieces))
        self.words.note(alone)
        simple = [w for w in alone if SIMPLE.fullmatch(w)]
        self.read_as(self.plain)
        for lo in range(0, len(simple), 512):
            some = simple[lo : lo + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            # each simple word is one pre-token, so its ids end where a token ends a word
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                cache.update(zip(some, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        self.read_as(self.usual)
        rest = [w for w in alone if w not in cache]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            cache[w] = np.asarray(e.ids, np.uint32).tobytes()
        for w, parts in pieces.items():
            cache[w] = b"".join([cache[p] for p in parts])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a bounded number of texts and characters is looked at together."""
        out, lo = [], 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and hi - lo < TEXTS and chars < CHARS:
                chars += len(texts[hi])
                hi += 1
            out += self.some(texts[lo:hi])
            lo = hi
        return out

    def some(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        self.words.make_room()
        cache = self.words.known
        words = [None if ENTANGLED.search(t) else t.lower().split() for t in texts]
        known = [None if ws is None else list(map(cache.get, ws)) for ws in words]
        gaps = [[i for i, k in enumerate(ks) if k is None] if ks and None in ks else () for ks in known]
        if missing := {ws[i] for ws, at in zip(words, gaps, strict=True) for i in at}:
            if new := self.words.recall(missing):
                self.learn(new)
            for ws, ks, at in zip(words, known, gaps, strict=True):
                for i in at:
                    ks[i] = cache[ws[i]]
        return [
            self.whole(t) if ks is None else np.frombuffer(b"".join(ks), np.uint32) for t, ks in zip(texts, known, strict=True)
        ]

    def forget(self) -> None:
        self.words.forget()
        give_back()


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
