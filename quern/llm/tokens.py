"""Token ids of whole texts from a public tokenizer file, with words encoded once per worker.

The word-level BPE file splits at white space before anything else, so a
text's ids are the ids of its words in order. Distinct words are encoded by
the library and kept; texts become gathers into the kept ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from . import textscan

#: Distinct words kept by a worker, and the longest word that is kept, in bytes.
KEPT_WORDS, KEPT_BYTES = 1 << 20, 64
#: ASCII signs that end a run of letters in the tokenizer's own rules (the apostrophe may begin a contraction).
SIGNS = ~textscan.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


class WordEncoder:
    """``encode(texts)`` gives flat ids and n + 1 offsets, equal to the library's on each whole text.

    Null counts as empty. Only for tokenizers that drop white space, as
    ``word_bpe_49k.json`` does. ``ordinary`` treats special tokens' strings in
    a text as ordinary text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = not ordinary
        if ordinary:
            self.tokenizer.encode_special_tokens = True
        self._reset()

    def _reset(self) -> None:
        self.kept = np.zeros(0, np.uint64)  # sorted hashes of words, and the words' slots
        self.slot = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each word that is kept, or -1."""
        if not len(self.kept):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.kept, keys), len(self.kept) - 1)
        return np.where(self.kept[at] == keys, self.slot[at], -1).astype(np.int64)

    def _new(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, _ = textscan.string_bytes(texts)
        if self.special and b"<|" in data.tobytes():  # a special token's string must reach the library as it is
            words = textscan.scan(texts)
        else:
            words = textscan.scan(texts, lower=True, cut=SIGNS)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(words.first), np.int64)
        codes, distinct = pd.factorize(words.hashes())
        first = np.full(len(distinct), -1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.kept) + len(distinct) > KEPT_WORDS:
            self._reset()
        slot = self._slots(distinct)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            at = first[missing]
            got = self._new([words.word(i).decode("utf-8", "replace") for i in at])
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            slot[missing] = len(self.size) + np.arange(len(missing))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, *got])
            short = missing[words.ends[at] - words.starts[at] <= KEPT_BYTES]
            short = short[np.argsort(distinct[short])]
            to = np.searchsorted(self.kept, distinct[short])
            self.kept, self.slot = np.insert(self.kept, to, distinct[short]), np.insert(self.slot, to, slot[short])
        which = slot[codes]
        sizes = self.size[which].astype(np.int64)
        ends = np.cumsum(sizes)
        out = self.ids[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        offsets = np.concatenate([[0], ends])[words.first]
        if len(self.ids) > 6 * KEPT_WORDS:
            self._reset()
        return out, offsets


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, ordinary: bool = False) -> WordEncoder:
    """This worker's encoder for the file."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = WordEncoder(path, ordinary)
    return _encoders[path, ordinary]


def encoded(texts: pa.Array, path: str, ordinary: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of ``texts`` with their flat ids and offsets, a few MB of text at a time."""
    enc = encoder(path, ordinary)
    for i, j in textscan.pieces(texts):
        yield i, j, *enc.encode(texts.slice(i, j - i))
