"""Spelling variants: permuterm rotations are sorted, words one edit apart meet in a prefix range, forms are followed."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import slices, written
from .words import mix

END = "\0"              # stands after the last letter of a word; no word holds it
PIECE_CHARS = 1 << 20   # a text is read in pieces of about this length
TASK_WORDS = 300_000    # words a task counts before it hands the counts on
KEY_CHARS = 48          # longer rotations keep their first 32 letters and 128 bits of the whole
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WHOLE, INNER, EDGE = 0, 1, 2


def _pieces(text: str):
    """Cuts a text into pieces at a place that no run of letters crosses."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        gap = _GAP.search(text, at + PIECE_CHARS)
        if gap is None:
            break
        yield text[at:gap.end()]
        at = gap.end()
    yield text[at:]


_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, drop_one_in: int | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters (A to Z, a to z, U+00C0 to U+00FF) of whole texts, A to Z in lower case, with at
    least ``shortest`` letters and ``least`` occurrences.

    With ``drop_one_in`` every run whose CRC-32 of ``<doc_id>:<run>`` is divisible by it loses the letter at that number
    modulo its length: typing errors for tests of this operator. A null text is an empty one, a null id the empty string.
    Texts are read in pieces; tasks hand on partial counts, so memory does not grow with a text or the vocabulary.
    """
    run = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % shortest)

    def changed(word: bytes, start: int) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % drop_one_in:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1:]

    def count(batches):
        total: Counter = Counter()

        def out():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in slices(batches, rows=1024):
            for i, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for part in _pieces(whole or ""):
                    # one byte per letter; every character beyond U+00FF turns into a question mark, which is no letter
                    found = Counter(run.findall(part.encode("latin-1", "replace").translate(_LOWER)))
                    if drop_one_in is None:
                        total.update(found)
                    else:
                        for w, n in found.items():
                            total[changed(w, start)] += n
            if len(total) > TASK_WORDS:
                yield out()
                total.clear()
        if total:
            yield out()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.char_length("word") >= shortest) & (F.col("n") >= least))


def _digests(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of two 64-bit hashes per (place, letter): from the left, and from the right."""
    letters = np.array([ord(c) for c in word], np.uint64)
    place = np.arange(len(word), dtype=np.uint64) << np.uint64(22)
    out = np.zeros((2, 2, len(word) + 1), np.uint64)
    for side in range(2):
        for lane in range(2):
            salt = np.uint64(2 * side + lane + 1 << 60)
            np.cumsum(mix((place | letters[::1 - 2 * side]) + salt), out=out[side, lane, 1:])
    return out[0], out[1]


def rotations(words: DataFrame) -> DataFrame:
    """(key, rank, kind) of each word (columns word, rank): every rotation of word and end mark, whole (kind 0) and, for a
    rotation that ends in a letter, without that letter (kind 1; 2 if the letter after it in the word is another one).

    A rotation without its last letter skips the edited letter: words that differ there share it, and so does the word that
    lacks the letter, with its whole rotation. Keys of more than ``KEY_CHARS`` letters keep the first 32 and a 128-bit hash
    of letters and places, so a word of m letters makes 2 m + 1 rows of bounded size.
    """
    def turn(batches):
        for b in slices(batches, rows=512, most=1 << 18):
            keys, ranks, kinds = [], [], []

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(ranks, pa.int64()), pa.array(kinds, pa.int8())],
                    names=["key", "rank", "kind"])

            for word, rank in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m, ring = len(word), word + END + word
                if m < KEY_CHARS:
                    keys += [ring[i:i + m + 1] for i in range(m + 1)]
                    keys += [ring[i + 1:i + 1 + m] for i in range(m)]
                    kinds += [WHOLE] * (m + 1)
                    kinds += [INNER if word[i] == word[i + 1:i + 2] else EDGE for i in range(m)]
                    ranks += [rank] * (2 * m + 1)
                    continue
                left, right = _digests(word)
                for i in range(m + 1):
                    # what stands before place i came from the left end, what stands from there on from the right end
                    x, y = (left[:, i] + right[:, m - i]).tolist()
                    keys.append(f"{ring[i:i + m + 1]}" if m + 1 <= KEY_CHARS else f"{ring[i:i + 32]}{x:016x}{y:016x}{m:x}")
                    kinds.append(WHOLE)
                    ranks.append(rank)
                    if i < m:
                        x, y = (left[:, i] + right[:, m - i - 1]).tolist()
                        keys.append(f"{ring[i + 1:i + 1 + m]}" if m <= KEY_CHARS else f"{ring[i + 1:i + 33]}{x:016x}{y:016x}{m - 1:x}")
                        kinds.append(INNER if word[i] == word[i + 1:i + 2] else EDGE)
                        ranks.append(rank)
                    if len(keys) > 50_000:
                        yield out()
                        keys, ranks, kinds = [], [], []
            yield out()

    return words.select("word", "rank").mapInArrow(turn, "key string, rank long, kind byte")


def near_words(turned: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are one edit away from each word, and the least rank among them.

    Rotations are sorted by key and rank; equal keys are a group of words that are one edit apart, at most one per letter
    of the alphabet and one more. Each row gives its word's share and not its pairs: a replacement shows in one group only,
    an indel inside a run of equal letters in several, of which the one at the end of the run counts.
    """
    group = W.partitionBy("key").orderBy("rank")
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut, edge = F.sum((F.col("kind") != WHOLE).cast("long")), F.sum((F.col("kind") == EDGE).cast("long"))
    g = turned.select(
        "rank", "kind", F.first("rank").over(whole).alias("_first"), F.nth_value("rank", 2).over(whole).alias("_second"),
        cut.over(whole).alias("_cut"), edge.over(whole).alias("_edge"), F.count(F.lit(1)).over(whole).alias("_all")).where("_all > 1")
    shorter = ((F.col("kind") == EDGE) & (F.col("_all") > F.col("_cut"))).cast("long")
    share = F.when(F.col("kind") == WHOLE, F.col("_edge")).otherwise(F.col("_cut") - 1 + shorter)
    other = F.when(F.col("rank") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return g.groupBy("rank").agg(F.sum(share).alias("n_near"), F.min(other).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root): follows rank -> form to the end, doubling the step each round until nothing moves."""
    steps = written(forms.select("rank", F.col("form").alias("root")), "spelling-steps")
    while True:
        ahead = steps.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        steps = written(steps.select("rank", "root").join(ahead, "root", "left").select(
            "rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-steps")
        if steps.where("_moved").isEmpty():
            return steps.select("rank", "root")


def variants(counts: DataFrame, factor: int = 2) -> DataFrame:
    """Groups spelling variants: word, form, root, n, n_near, form_n of each word of ``counts`` (word, n; words distinct).

    Two words are near if one inserted, deleted or replaced letter (code point) makes one the other. The form of a word is
    its near word of largest n (ties: the smallest in code-point order) if that n is at least ``factor`` times its own,
    else null; the root is where forms lead to, the word itself without a form. Words get numbers by falling n, so the best
    near word is the least number and forms lead to smaller ones. Null words are left out; an empty table gives no rows.
    """
    given = counts.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    ranked = written(global_rank(given, [F.col("n").desc(), F.col("word")]).select("rank", "word", "n"), "spelling-words")
    near = near_words(rotations(ranked))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_form_n"))
    known = ranked.join(near, "rank", "left").join(best, "best", "left")
    has = F.col("_form_n") >= factor * F.col("n")
    known = written(known.select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("_to"),
        F.when(has, F.col("_form")).alias("form"), F.when(has, F.col("_form_n")).alias("form_n")), "spelling-near")
    roots = _roots(known.where("_to IS NOT NULL").select("rank", F.col("_to").alias("form")))
    names = ranked.select(F.col("rank").alias("root"), F.col("word").alias("_root"))
    ends = roots.join(names, "root").select("rank", "_root")
    return known.join(ends, "rank", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
