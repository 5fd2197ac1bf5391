"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes of a byte class; classes here exclude ASCII
bytes only, so byte runs and character runs are the same thing in UTF-8. Words
get 64-bit polynomial hashes computed with whole-array numpy operations; a
second, independent hash makes 128 bits where equality has to be trusted.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes hashed at a time; words beyond LONG bytes are hashed one by one.
BLOCK, LONG = 1 << 19, 4096


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class _Poly:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
        base = int(rng.integers(1, 1 << 62)) * 2 + 1
        inverse = pow(base, -1, 1 << 64)
        self.power = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK + LONG, base, np.uint64)]), dtype=np.uint64)
        self.undo = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK + LONG, inverse, np.uint64)]), dtype=np.uint64)
        self.seed = seed


_polys: dict[int, _Poly] = {}


def _poly(seed: int) -> _Poly:
    if seed not in _polys:
        _polys[seed] = _Poly(seed)
    return _polys[seed]


@dataclass
class Words:
    """Words of several texts, in order: byte spans in ``data``, and for text i the words first[i]:first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit hashes; equal words have equal hashes on every machine."""
        p, out, n = _poly(seed), np.empty(len(self), np.uint64), len(self)
        sizes = self.ends - self.starts
        long = np.flatnonzero(sizes > LONG)
        i = 0
        while i < n:
            j = int(np.searchsorted(self.starts, self.starts[i] + BLOCK - LONG, "left"))
            j = max(j, i + 1)
            at, to = self.starts[i:j], np.minimum(self.ends[i:j], self.starts[i:j] + LONG)
            lo, hi = int(at[0]), int(to[-1])
            terms = p.byte[self.data[lo:hi]]
            terms *= p.power[: hi - lo]
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            h = sums[to - lo]
            h -= sums[at - lo]
            h *= p.undo[at - lo]
            out[i:j] = mix(h ^ (sizes[i:j].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
            i = j
        for k in long:
            out[k] = xxhash.xxh3_64_intdigest(self.word(k), seed=p.seed)
        return out


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    if len(texts) == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _trim = None


def release() -> None:
    """Gives the memory of freed arrays back to the system; workers are kept between tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with memory released behind each."""
    for batch in batches:
        yield batch
        del batch
        release()


def by_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` with memory released behind each group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run


def pieces(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text, one row at least."""
    _, offsets = string_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def scan(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False, cut: np.ndarray | None = None) -> Words:
    """Words of each text. ``cut``: a class of bytes; a word also ends before one that follows a letter a-z."""
    data, offsets = string_bytes(texts)
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    is_in = inside[data]
    edge = np.empty(len(data), bool)  # a word starts here
    edge[0] = is_in[0]
    np.greater(is_in[1:], is_in[:-1], out=edge[1:])
    head = offsets[:-1][(np.diff(offsets) > 0)]
    edge[head] = is_in[head]
    inner = None
    if cut is not None:
        inner = np.flatnonzero(cut[data[1:]] & _LETTER[data[:-1]]) + 1
        inner = inner[~edge[inner]]
        edge[inner] = True
    starts = np.flatnonzero(edge)
    last = np.empty(len(data), bool)  # a word's last byte
    last[-1] = is_in[-1]
    np.greater(is_in[:-1], is_in[1:], out=last[:-1])
    tail = head[1:] - 1
    last[tail] = is_in[tail]
    if inner is not None:
        last[inner - 1] = True
    ends = np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words of one text, and the index of each window's first word."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = U(0x9E3779B97F4A7C15 + 2 * seed)
    out = hashes[: n - size + 1].copy()
    for j in range(1, size):
        out *= k
        out ^= out >> U(29)
        out += hashes[j : n - size + 1 + j]
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.repeat(first[:-1], counts)
    at = begin + (np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts))
    return mix(out[at]), at
