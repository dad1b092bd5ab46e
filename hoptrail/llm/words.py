"""Words and word shingles of Arrow text columns, hashed with numpy over a whole slice at once."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that their powers have inverses
SLICE_BYTES = 1 << 20
SHINGLE = 5


@dataclass
class Words:
    """Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""

    data: np.ndarray      # bytes of all texts
    bounds: np.ndarray    # first byte of each text, and the end
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    doc: np.ndarray       # text of each word
    hash: np.ndarray      # 64-bit hash of each word
    first: np.ndarray     # first word of each text, and the end


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse modulo 2**64."""
    out = []
    for b in (BASES[base], pow(BASES[base], -1, 1 << 64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def prefix_hash(data: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(running polynomial hash, inverse powers): the hash of bytes i to j is (run[j] - run[i]) * inverse[i]."""
    power, inverse = _powers(max(20, int(len(data)).bit_length()), base)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=run[1:])
    return run, inverse


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each of some runs of bytes, in order: the sum of a 64-bit hash of each byte with its place in the run."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(start), 1 << 16):
        a, b = start[lo:lo + (1 << 16)], end[lo:lo + (1 << 16)]
        n = b - a
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        byte = data[place + np.repeat(a, n)]
        run = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum(mix(byte.astype(np.uint64) | place.astype(np.uint64) << np.uint64(8)), out=run[1:])
        out[lo:lo + (1 << 16)] = run[first + n] - run[first]
    return out


def words_of(column: pa.Array) -> Words:
    data, bounds = buffers(column)
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    opens, closes = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        opens[0] = True
        opens[1:] = gap[:len(data) - 1]
        closes[:] = gap[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        opens[inner] = True
        closes[inner - 1] = True
        filled = ~gap[:-1]
        opens &= filled
        closes &= filled
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    h = mix(_sums(data, start, end) + (end - start).astype(np.uint64))
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(data, bounds, start, end, doc, h, np.searchsorted(doc, np.arange(len(column) + 1)))


def shingles_of(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words, but one at least, is a single shingle."""
    n = np.diff(w.first)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    wide = np.zeros(len(w.hash), np.uint64)
    for k in range(size):
        wide[:max(0, len(w.hash) - k)] += w.hash[k:] * factors[k]
    whole = np.flatnonzero((np.arange(len(w.hash)) - w.first[w.doc]) + size <= n[w.doc])
    doc, h = w.doc[whole], mix(wide[whole])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            few[has] += w.hash[w.first[short[has]] + k] * factors[k]
        doc = np.r_[doc, short]
        h = np.r_[h, mix(few + n[short].astype(np.uint64))]
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct hashes of each of at most 4096 texts; the hash keeps its upper 52 bits."""
    key = doc.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12)
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    times = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), times
