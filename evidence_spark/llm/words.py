"""Vectorised words and shingles of Arrow text columns (numpy over the UTF-8 bytes).

A word is a maximal run of bytes other than the six ASCII white-space characters, with A-Z
lower-cased. Words are represented by 64-bit hashes: a polynomial over the bytes modulo
2**64, finished by a bit mixer. No Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multiplier of the polynomial and the two multipliers of the mixer.
_BASE = 0x9E3779B97F4A7C15
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)

_powers = {"fwd": np.ones(1, dtype=np.uint64), "inv": np.ones(1, dtype=np.uint64)}
CHUNK_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["fwd"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("fwd", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[key] = table
    return _powers["fwd"], _powers["inv"]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) of whole texts, about max_bytes at a time."""
    data, off = text_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): byte spans of all words of the chunk."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_WHITE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = off[:-1][off[:-1] < len(data)]
    before[first] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the index of each text's first word (length + 1)."""
    starts, ends, woff = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), woff
    fwd, inv = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * fwd[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inv[starts]), woff


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all word shingles of one text, in order, with repeats.

    A text of fewer words than the width has one shingle, its whole sequence; a text
    without words has none.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(_BASE) + words[k: n - size + 1 + k])
    return out


def texts_words(col: pa.Array):
    """Yield (row, word hashes) of every text of the column."""
    for i, j, data, off in chunks(col):
        h, woff = word_hashes(data, off)
        for k in range(j - i):
            yield i + k, h[woff[k]: woff[k + 1]]


def string_words(text: str) -> np.ndarray:
    """Word hashes of one Python string."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]
