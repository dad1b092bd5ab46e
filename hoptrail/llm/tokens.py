"""Byte-level BPE over Arrow columns with a bounded cache of piece encodings.

A byte-level pre-tokenizer has no token with white space after something else. Texts are therefore cut at each space that
follows a character other than white space; each distinct piece goes through the tokenizer once while it stays in the
worker's cache, and a text's ids are the pieces' ids in order. Cutting, naming (128-bit hashes of bytes and places) and
gathering are done with numpy over a whole slice, so a piece that is known costs no Python object.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable
from itertools import accumulate, count

import numpy as np
import pyarrow as pa

from .words import buffers, mix

CACHE_ENTRIES = 800_000  # pieces, per Python worker: about 40 MB
CACHE_BYTES = 64         # longer pieces are not kept
BLOCK_BYTES = 1 << 20    # pieces named at a time
SAFE_SPACE = re.compile(r"(?<=\S) ")
_JOINED = 256            # pieces that go through the tokenizer in one string


class Recent:
    """Values of recent pieces in two generations: a hit in the old one moves to the young one, a full young one turns old."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def resolve(self, lists: list[list[str]], compute: Callable[[list[str]], list]) -> list[list]:
        """The value of each piece of each list; ``compute`` gives the values (never None) of pieces that are not known."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        found, holes, missing = [], [], set()
        for k, pieces in enumerate(lists):
            values = list(map(self.young.get, pieces))
            empty = [i for i, v in enumerate(values) if v is None]
            if empty:
                holes.append((k, empty))
                missing.update([pieces[i] for i in empty])
            found.append(values)
        new, rare = [], {}
        for p in missing:
            value = self.old.get(p)
            if value is None:
                new.append(p)
            else:
                self.young[p] = value
        for p, value in zip(new, compute(new) if new else ()):
            (self.young if len(p) <= CACHE_BYTES else rare)[p] = value
        for k, empty in holes:
            pieces, values = lists[k], found[k]
            for i in empty:
                p = pieces[i]
                values[i] = self.young[p] if len(p) <= CACHE_BYTES else rare[p]
        return found


def pieces_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first piece of each text and the number of pieces) of the pieces between safe spaces; the space at a cut
    belongs to neither piece. Each text has a piece, if an empty one."""
    at = np.flatnonzero(data == 32)
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    at = at[~begins[at]]
    before = data[at - 1]
    safe = before > 32
    wide = np.flatnonzero(before >= 128)
    if len(wide):  # the space characters beyond ASCII: U+0085, A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F, 3000
        c, b, a = before[wide], data[at[wide] - 2], data[np.maximum(at[wide] - 3, 0)]
        general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        safe[wide] = ~((b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
                       | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80))
    cuts = at[safe]
    n = len(bounds) - 1
    first = np.arange(n + 1) + np.searchsorted(cuts, bounds)
    start, end = np.empty(n + len(cuts), np.int64), np.empty(n + len(cuts), np.int64)
    inner = np.ones(len(start), bool)
    inner[first[:-1]] = False
    start[first[:-1]], start[inner] = bounds[:-1], cuts + 1
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = bounds[1:]
    return start, end, first


def _named(seg: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece of ``seg`` and its kind: sums over bytes of a hash of byte and place in the piece."""
    place = np.arange(len(seg)) - np.repeat(start, np.diff(np.r_[start, len(seg)]))
    v = mix(seg.astype(np.uint64) | place.astype(np.uint64) << np.uint64(8))
    out = []
    for lane in (v, (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)):
        run = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(lane, out=run[1:])
        out.append(mix(run[end] - run[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + kind))
    return out[0], out[1]


class Encoder:
    """Encodes texts to unsigned 32-bit ids, as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # an entry has one character per byte
        for entry, i in vocabulary.items():
            self.size[i] = len(entry)
        # known pieces by their first hash: second hash, place and number of ids in ``ids``, block of the last use
        self.keys, self.twins = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.blocks = np.zeros(0, "<u4"), 0

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of short texts, one call each."""
        found = []
        for at in range(0, len(texts), 4096):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[at:at + 4096], add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, "<u4"), np.array([len(x) for x in found], np.int64)

    def joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces with a space before each. Many go through the tokenizer in one string, where
        a text could be cut, and are told apart by the bytes of their tokens. None is empty or ends in white space."""
        if not pieces:
            return self.alone([])
        groups = [(b" " + b" ".join(pieces[at:at + _JOINED])).decode() for at in range(0, len(pieces), _JOINED)]
        ids, _ = self.alone(groups)
        ends = np.cumsum(self.size[ids])
        want = np.cumsum(np.array([len(p) for p in pieces]) + 1)
        cuts = np.searchsorted(ends, want)
        if len(ends) != cuts[-1] + 1 or not np.array_equal(ends[cuts], want):
            return self.alone([(b" " + p).decode() for p in pieces])
        return ids, np.diff(np.r_[-1, cuts])

    def _computed(self, raw: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(ids, number of ids of each) of pieces of ``raw``, those inside a text first; and that order."""
        inside = np.flatnonzero(~first & ~last & (end - start <= CACHE_BYTES))
        rest = np.flatnonzero(first | last | (end - start > CACHE_BYTES))
        cut = lambda k: raw[start[k]:end[k]]
        ids, n = self.joined([cut(k) for k in inside.tolist()])
        more, m = self.alone([("" if first[k] else " ") + cut(k).decode() for k in rest.tolist()])
        return np.concatenate([ids, more]), np.concatenate([n, m]), np.concatenate([inside, rest])

    def _keep(self, keys: np.ndarray, twins: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.twins, self.at, self.n, self.used = (np.concatenate(x)[order] for x in (
            (self.twins, twins), (self.at, at), (self.n, n), (self.used, np.full(len(n), self.blocks, np.int32))))

    def _forget(self) -> None:
        """Keeps the half of the pieces that were used last."""
        keep = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        if keep.all():
            keep[:] = False
        self.keys, self.twins, self.used, at, n = (x[keep] for x in (self.keys, self.twins, self.used, self.at, self.n))
        self.ids = self.ids[_gather(at, n)]
        self.at, self.n = np.cumsum(n) - n, n

    def _place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return place, self.keys[place] == key

    def _block(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(ids, number of ids of each piece) of neighbouring pieces."""
        self.blocks += 1
        if len(self.keys) > CACHE_ENTRIES:
            self._forget()
        seg, start, end = data[start[0]:end[-1]], start - start[0], end - start[0]
        raw = seg.tobytes()
        if len(start) == 1:
            ids, n, _ = self._computed(raw, start, end, first, last)
            return ids, n
        key, twin = _named(seg, start, end, first.astype(np.uint64))
        some, shown, which = np.unique(key, return_index=True, return_inverse=True)
        rare = (end - start > CACHE_BYTES) | (twin != twin[shown][which])
        place, known = self._place(some)
        new = shown[~known & ~rare[shown]]
        if len(new):
            ids, n, order = self._computed(raw, start[new], end[new], first[new], last[new])
            self._keep(key[new][order], twin[new][order], ids, n)
            place, known = self._place(some)
        if len(self.keys):
            rare |= ~known[which] | (self.twins[place[which]] != twin)
            self.used[place[known]] = self.blocks
            at, n, ids = self.at[place][which], self.n[place][which], self.ids
        else:
            at, n, ids = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), self.ids
        if rare.any():
            odd = np.flatnonzero(rare)
            more, m, order = self._computed(raw, start[odd], end[odd], first[odd], last[odd])
            at[odd[order]], n[odd[order]] = len(ids) + np.cumsum(m) - m, m
            ids = np.concatenate([ids, more])
        return ids[_gather(at, n)], n

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bound of each text and the end) of a string column; null counts as empty."""
        data, bounds = buffers(column)
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        start, end, texts = pieces_of(data, bounds)
        first, last = np.zeros(len(start), bool), np.zeros(len(start), bool)
        first[texts[:-1]], last[texts[1:] - 1] = True, True
        huge = np.flatnonzero(end - start > BLOCK_BYTES)
        ids, counts, lo = [], [], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + BLOCK_BYTES)))
            k = np.searchsorted(huge, lo)
            if k < len(huge) and huge[k] < hi:
                hi = max(lo + 1, int(huge[k]))
            x, n = self._block(data, start[lo:hi], end[lo:hi], first[lo:hi], last[lo:hi])
            ids.append(x)
            counts.append(n)
            lo = hi
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        ids, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        raw, at = ids.tobytes(), (4 * bounds).tolist()
        return [raw[lo:hi] for lo, hi in zip(at, at[1:])]


def _gather(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of runs of ``n`` neighbours from ``at`` on, one after the other."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)


def long_pieces(text: str, most: int = 1 << 20):
    """Cuts a very long text at safe spaces into parts of about ``most`` characters; the space at a cut is left out."""
    at = 0
    while len(text) - at > most:
        gap = SAFE_SPACE.search(text, at + most)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.end()
    yield text[at:]


def ends_of(sizes: Iterable[int]) -> dict[int, int]:
    """Cumulative end of each token -> its index."""
    return dict(zip(accumulate(sizes), count()))
