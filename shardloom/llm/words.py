"""Words of many texts at once, as byte ranges and 64-bit hashes, with numpy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _bytes_table(keep: bytes, lower: bool) -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for b in keep:
        lut[b] = b + 32 if lower and 65 <= b <= 90 else b
    return lut


#: Bytes of text hashed at once.
HASHED_BYTES = 1 << 18
#: What a byte becomes; 0 parts words. All bytes of characters beyond ASCII belong to words.
ALNUM = _bytes_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), True)
SPACED = _bytes_table(bytes(b for b in range(256) if b not in b" \t\n\x0b\f\r"), True)
# A zero byte belongs to a word of SPACED; byte 255 occurs in no UTF-8 text and stands for it.
SPACED[0] = 255


SEED = 20240229


@lru_cache(4)
def _tables(seed: int = SEED) -> tuple[np.ndarray, int]:
    random = np.random.default_rng(seed)
    values = random.integers(1, 2**63, 256, dtype=np.uint64)
    values[0] = 0
    return values, int(random.integers(2**62, 2**63, dtype=np.uint64)) | 1


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(1024, 2 * n), _tables()[1], np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit value."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


@dataclass
class Words:
    raw: np.ndarray  # the texts' bytes, one text after the other
    start: np.ndarray  # of each word, in raw
    end: np.ndarray
    row: np.ndarray  # of each word
    key: np.ndarray  # its hash
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _keys(folded: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of the words that begin at ``start``; zero bytes between them add nothing."""
    spans = np.diff(np.append(start, len(folded)))
    offset = np.arange(len(folded)) - np.repeat(start, spans)  # of a byte in its word
    return np.add.reduceat(_tables(seed)[0][folded] * powers(int(spans.max()))[offset], start)


def words_of(texts: pa.Array, lut: np.ndarray, seed: int = SEED) -> Words:
    raw, offsets = raw_of(texts)
    rows = len(offsets) - 1
    empty = np.zeros(0, np.int64)
    if not len(raw):
        return Words(raw, empty, empty, empty, np.zeros(0, np.uint64), rows)
    folded = lut[raw]
    inside = folded != 0
    edge = np.zeros(len(raw) + 1, bool)  # where a text begins
    edge[offsets[:-1]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return Words(raw, empty, empty, empty, np.zeros(0, np.uint64), rows)
    length = end - start
    key = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # in bounded pieces: a hash takes eight times the bytes of its text
        stop = max(at + 1, int(np.searchsorted(end, start[at] + HASHED_BYTES, side="right")))
        key[at:stop] = _keys(folded[start[at] : end[stop - 1]], start[at:stop] - start[at], seed)
        at = stop
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(raw, start, end, row, mix(key + length.astype(np.uint64)), rows)
