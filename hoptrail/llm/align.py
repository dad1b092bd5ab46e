"""Cross-tokenizer alignment: two encodings of a text are cut where both have a token end; links are counted corpus-wide."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import CACHE_BYTES, SAFE_SPACE, Encoder, Recent, ends_of, long_pieces

SPACE = "▁"
CACHE_ENTRIES = 200_000  # pieces of one generation, per Python worker: two generations take about 140 MB


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for
    the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def common_ends(sizes_a: Iterable[int], sizes_b: Iterable[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) before each byte offset at which both encodings have a token end, ascending.

    Each encoding gives a dictionary from cumulative end to index; the keys they share, sorted, are the offsets.
    """
    end_a, end_b = ends_of(sizes_a), ends_of(sizes_b)
    return [(end_a[end] + 1, end_b[end] + 1) for end in sorted(end_a.keys() & end_b.keys())]


class Aligner:
    """Groups and links of texts under tokenizer A (byte-level BPE, ``tokenizers``) and B (pieces, ``sentencepiece``).

    Both encode a space and the text. Neither has a token with a space after something else (checked when B is loaded), so
    both have a token end before each space that follows another character, and so have the groups: each distinct piece
    between such spaces is encoded and sliced once while it stays in the worker's cache.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_alphabet()
        self.bytes_a = [b""] * len(self.a.size)
        for entry, i in self.a.tokenizer.get_vocab().items():
            if all(c in byte for c in entry):
                self.bytes_a[i] = bytes(byte[c] for c in entry)
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} has a space inside")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.name_a, self.name_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(len(self.bytes_b))))
        self.alone = [self.b.piece_to_id(SPACE)]
        self.width = len(self.bytes_b)
        if len(self.bytes_a) * self.width >= 1 << 32:
            raise ValueError("pairs of ids do not fit into 32 bits")
        self.known = Recent(CACHE_ENTRIES)

    def _after_space(self, pieces: list[str]) -> list[list[int]]:
        """Ids of A of each piece with a space before it."""
        plain = [bool(p) and len(p) <= CACHE_BYTES and not p[-1].isspace() for p in pieces]
        parts = [p.encode() for p, joined in zip(pieces, plain) if joined], [" " + p for p, joined in zip(pieces, plain) if not joined]
        found = []
        for ids, n in (self.a.joined(parts[0]), self.a.alone(parts[1])):
            ids, ends = ids.tolist(), np.cumsum(n).tolist()
            found.append(iter([ids[lo:hi] for lo, hi in zip([0, *ends], ends)]))
        return [next(found[not joined]) for joined in plain]

    def _sliced(self, pieces: list[str]) -> list[tuple[str | None, bytes, int, int]]:
        """(groups in digits, links, tokens of A, tokens of B) of each piece with a space before it; no groups if bytes differ."""
        out = []
        bytes_a, bytes_b, size_a, size_b = (x.__getitem__ for x in (self.bytes_a, self.bytes_b, self.size_a, self.size_b))
        name_a, name_b, width, join = self.name_a, self.name_b, self.width, ",".join
        for piece, ids_a, ids_b in zip(pieces, self._after_space(pieces), self.b.encode(pieces, num_threads=1)):
            ids_b = ids_b if piece else self.alone
            whole = (" " + piece).encode()
            if b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
                out.append((None, b"", 0, 0))
                continue
            i = j = 0
            groups, links = [], array("I")
            for to_a, to_b in common_ends(map(size_a, ids_a), map(size_b, ids_b)):
                groups.append(f"{join([name_a[x] for x in ids_a[i:to_a]])}|{join([name_b[x] for x in ids_b[j:to_b]])}")
                links.append(ids_a[to_a - 1] * width + ids_b[to_b - 1])
                i, j = to_a, to_b
            out.append((";".join(groups), links.tobytes(), len(ids_a), len(ids_b)))
        return out

    def parts(self, texts: list[str]):
        """Per text an iterator of (groups, links, tokens of A, tokens of B) lists: one per part of about a million characters."""
        short = [k for k, t in enumerate(texts) if len(t) <= 1 << 20]
        found = dict(zip(short, self.known.resolve([SAFE_SPACE.split(texts[k]) for k in short], self._sliced)))
        for k, text in enumerate(texts):
            if k in found:
                yield iter([found[k]])
            else:
                yield (self.known.resolve([SAFE_SPACE.split(part)], self._sliced)[0] for part in long_pieces(text))


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups_sha256, links; with ``groups`` also the groups themselves.

    Groups are written ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B between common token ends, in order. ``links`` holds one
    unsigned 32-bit number per linked pair of occurrences, id of A times B's vocabulary plus id of B: the tokens of A and B
    whose bytes end together, one pair per group. Special tokens inside a text are ordinary text. A null or empty text, or
    one that the tokens' bytes do not give back, has no tokens: zeros and empty strings.
    """
    def align(batches):
        tool = aligner(path_a, path_b)
        for b in slices(batches, most=1 << 20, rows=512):
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, t, parts in zip(b.column(0).to_pylist(), texts, tool.parts(texts)):
                digest, links, written_out = hashlib.sha256(), [], []
                n_a = n_b = 0
                whole = bool(t)
                for k, part in enumerate(parts if t else ()):
                    if any([x[0] is None for x in part]):
                        whole = False
                        break
                    digits = ";".join([x[0] for x in part])
                    digest.update((";" * (k > 0) + digits).encode())
                    links += [x[1] for x in part]
                    n_a += sum([x[2] for x in part])
                    n_b += sum([x[3] for x in part])
                    if groups:
                        written_out.append(digits)
                if not whole:
                    n_a, n_b, links, written_out = 0, 0, [], []
                packed = b"".join(links)
                rows.append((i, n_a, n_b, len(packed) // 4, digest.hexdigest() if whole else "", packed)
                            + ((";".join(written_out),) if groups else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"] + ["groups"] * groups
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()] + [pa.string()] * groups
    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * groups
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(align, ddl)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each pair of ids.

    Of two tokens that end together the shorter one's bytes end the longer one's. So there are at most as many pairs as
    bytes in both vocabularies (half a million for two of some 40 000 tokens), whatever the corpus: the table is small.
    """
    def count(batches):
        held = []

        def folded():
            pair = np.concatenate([p for p, _ in held])
            some, at = np.unique(pair, return_inverse=True)
            return some, np.bincount(at, np.concatenate([n for _, n in held]), len(some)).astype(np.int64)

        for b in slices(batches, rows=1024):
            raw = b"".join(b.column(0).to_pylist())
            held.append(np.unique(np.frombuffer(raw, "<u4"), return_counts=True))
            if len(held) >= 16:
                held = [folded()]
        if held:
            pair, n = folded()
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    return found.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_strength(found: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Adds to each row of ``aligned``: n_links, n_best (links whose pair is the most frequent of its id of B, ties included)
    and count_sum (sum of the pairs' counts over all links).

    ``counts`` is the table of ``pair_counts`` for the same corpus, ``width`` B's vocabulary size. The table goes to every
    task; its size is bounded by the vocabularies (see ``pair_counts``).
    """
    spark = found.sparkSession
    table = counts.select("pair", "n").toArrow()
    pair, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order].astype(np.uint32), n[order]
    most = np.zeros(width, np.int64)
    np.maximum.at(most, pair % np.uint32(width), n)
    sent = spark.sparkContext.broadcast((pair, n, n == most[pair % np.uint32(width)]))
    names = [c for c in found.columns if c != "links"]
    at = found.columns.index("links")

    def score(batches):
        pair, n, best = sent.value
        for b in slices(batches, rows=1024):
            raw = b.column(at).to_pylist()
            size = np.array([len(x) // 4 for x in raw])
            place = np.searchsorted(pair, np.frombuffer(b"".join(raw), "<u4"))
            ends = np.cumsum(size)
            run = lambda v: np.r_[np.int64(0), np.cumsum(v, dtype=np.int64)]
            counted, good = run(n[place]), run(best[place])
            yield pa.RecordBatch.from_arrays(
                [c for k, c in enumerate(b.columns) if k != at]
                + [pa.array(size), pa.array(good[ends] - good[ends - size]), pa.array(counted[ends] - counted[ends - size])],
                names=[*names, "n_links", "n_best", "count_sum"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "links")
    return found.mapInArrow(score, f"{ddl}, n_links long, n_best long, count_sum long")


def aligned_with_strength(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``aligned``, written once, with the corpus-wide strength of its links."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    found = written(aligned(docs, path_a, path_b, doc_id=doc_id, text=text), "aligned")
    return link_strength(found, pair_counts(found), width)
