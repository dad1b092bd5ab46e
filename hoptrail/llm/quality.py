"""Quality classifier: gradient-boosted trees on histograms of document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .words import SLICE_BYTES, distinct, shingles_of, words_of

TRAIN_ROWS = 20_000  # most labelled rows that a model is fitted on
BINS = 64
FEATURES = [
    "bytes", "words", "word_bytes", "longest_word", "upper", "digit", "ascii_punct", "bars", "symbols", "marks", "brackets",
    "space", "line_feeds", "non_ascii", "entropy", "distinct_words", "top_word", "repeats_previous", "short_words",
    "capitalised", "ends_sentence", "no_letter", "distinct_shingles", "distinct_lines",
]


def _classes() -> np.ndarray:
    """Byte classes as columns of a 256-row table."""
    b = np.arange(256)
    has = lambda s: np.isin(b, np.frombuffer(s, np.uint8))
    punct = ((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))
    return np.stack([
        (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), punct, has(b"|"), has(b"#$%&*@^~+=\\"), has(b"!?"), has(b"<>{}[]()"),
        (b == 32) | ((b >= 9) & (b <= 13)), b == 10, b >= 128,
    ], axis=1).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; shares are 0 where there is nothing to share."""
    w = words_of(column)
    n_docs = len(column)
    size, n_words = np.diff(w.bounds).astype(np.float64), np.diff(w.first).astype(np.float64)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n_words, 1)
    doc_of_byte = np.repeat(np.arange(n_docs), np.diff(w.bounds))
    counts = np.bincount(doc_of_byte * 256 + w.data, minlength=n_docs * 256).reshape(n_docs, 256)
    share = counts * per_byte[:, None]
    classes = share @ _classes()
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    tally = lambda at, weights=None: np.bincount(at, weights, minlength=n_docs)
    length = (w.end - w.start).astype(np.float64)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, w.doc, length)
    doc, _, times = distinct(w.doc, w.hash)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, times)
    same = np.flatnonzero((w.doc[1:] == w.doc[:-1]) & (w.hash[1:] == w.hash[:-1]))
    first, last = w.data[w.start], w.data[w.end - 1]
    letter = np.r_[0, np.cumsum((w.data >= 128) | ((w.data | 32) >= 97) & ((w.data | 32) <= 122))]
    shingle_doc, shingle = shingles_of(w)
    n_shingles = np.maximum(tally(shingle_doc), 1)
    # a line is named by its words' hashes, so the same line in another place counts as repeated
    feeds = np.r_[0, np.cumsum(w.data == 10)]
    line = w.doc * (int(feeds[-1]) + 1) + feeds[w.start]
    new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][:len(line)])
    line_doc = w.doc[new]
    running = np.r_[np.uint64(0), np.cumsum(w.hash * (2 * (np.arange(len(w.hash)) - np.repeat(new, np.diff(np.r_[new, len(line)])))
                                                      + 1).astype(np.uint64))]
    line_hash = running[np.r_[new[1:], len(line)].astype(np.int64)] - running[new]
    n_lines = np.maximum(tally(line_doc), 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), length_mean(tally(w.doc, length), per_word), np.log1p(longest), classes, entropy,
        tally(doc) * per_word, top * per_word, tally(w.doc[1:][same]) * per_word, tally(w.doc, length <= 3) * per_word,
        tally(w.doc, (first >= 65) & (first <= 90)) * per_word, tally(w.doc, np.isin(last, [33, 46, 63])) * per_word,
        tally(w.doc, letter[w.end] == letter[w.start]) * per_word,
        tally(distinct(shingle_doc, shingle)[0]) / n_shingles, tally(distinct(line_doc, line_hash)[0]) / n_lines,
    ]).astype(np.float32)


def length_mean(total: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    return total * per_word


def document_statistics(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``stats``: the statistics of each whole text as packed 32-bit floats."""
    names = list(keep)

    def compute(batches):
        for b in slices(batches, SLICE_BYTES):
            x = statistics(b.column(len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=[*names, "stats"])

    given = docs.select(*names, F.col(text).alias("_text"))
    return given.mapInArrow(compute, type(given.schema)(given.schema.fields[:-1]).add("stats", "binary"))


@dataclass
class Trees:
    """All trees of a model as arrays: (tree, inner node) features and cuts, (tree, leaf) values; trees are complete."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics; all rows walk down a tree together."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        depth = int(self.leaf.shape[1]).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (leaf.shape[0] - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0,
        least: float = 5.0) -> Trees:
    """Boosts complete trees of ``depth`` levels for the logistic loss on histograms of ``BINS`` bins per feature.

    A node takes the cut with the largest gain that leaves ``least`` rows' worth on both sides (the first on ties); a
    node without one sends all rows left. Without rows the model answers 0.5, with one class nearly that class.
    """
    inner = 2 ** depth - 1
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    n_features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for f in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), base)
    total, width = np.full(len(y), base), n_features * BINS
    column = np.arange(n_features) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            k = 2 ** level
            cell = ((node[:, None] * n_features * BINS) + column + binned).ravel()
            hist = [np.bincount(cell, np.repeat(v, n_features), minlength=k * width).reshape(k, n_features, BINS).cumsum(axis=2)
                    for v in (grad, hess, np.ones(len(y)))]
            (gl, hl, nl), (g, h, n) = hist, [v[:, :1, -1:] for v in hist]
            gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
            gain[(nl < least) | (n - nl < least)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            feature, bin_ = best // BINS, best % BINS
            for j in np.flatnonzero(split):
                at = k - 1 + j
                model.feature[t, at] = feature[j]
                model.cut[t, at] = cuts[feature[j]][min(bin_[j], len(cuts[feature[j]]) - 1)]
            right = split[node] & (binned[np.arange(len(y)), feature[node]] > bin_[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, minlength=inner + 1), np.bincount(node, hess, minlength=inner + 1)
        model.leaf[t] = -rate * g / (h + ridge)
        total += model.leaf[t][node]
    return model


def train(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fits on at most ``rows`` labelled documents, those with the smallest hash of their id; so the driver holds a
    bounded sample. ``labels`` holds the rows that may be learned from. A document with several labels counts as 1 when
    half of them are; null ids and labels are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        (F.avg(label) >= 0.5).cast("double").alias("_y"))
    key = F.xxhash64("_id")
    sample = known.orderBy(key, "_id").limit(rows)
    found = stats.join(F.broadcast(sample), stats[doc_id] == F.col("_id")).select("_id", "_y", "stats")
    got = found.orderBy(key, "_id").limit(rows).toPandas()
    x = np.frombuffer(b"".join(map(bytes, got["stats"])), np.float32).reshape(-1, len(FEATURES))
    return fit(x, got["_y"].to_numpy(np.float64))


def scored(stats: DataFrame, model: Trees, threshold: float) -> DataFrame:
    """Replaces ``stats`` by score (probability of label 1) and predicted (1 from ``threshold`` on)."""
    names = [c for c in stats.columns if c != "stats"]

    def score(batches):
        for b in slices(batches):
            x = np.frombuffer(b"".join(b.column(len(names)).to_pylist()), np.float32).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    given = stats.select(*names, "stats")
    out = type(given.schema)(given.schema.fields[:-1]).add("score", "double").add("predicted", "integer")
    return given.mapInArrow(score, out)


def held_out(doc_id: str) -> Column:
    """True where the CRC-32 of the id's text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Statistics of the whole texts are computed once and written; labels of held-out ids are never learned from. A null
    text is an empty one and has a score too. An empty table gives no rows.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stats = written(document_statistics(given, "text", "doc_id"), "statistics")
    may_learn = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label")).where(~held_out("doc_id"))
    model = train(stats, may_learn, label="label", rows=rows)
    return scored(stats, model, threshold).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text",
                   label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, in one pass over the texts; all columns stay.

    The model is fitted on the statistics of at most ``rows`` labelled documents, found by their ids.
    """
    may_learn = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).alias("label")).where(~held_out("_id"))
    sample = may_learn.where("label IS NOT NULL AND _id IS NOT NULL").select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = given.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left_semi")
    model = train(document_statistics(found, "text", "doc_id"), may_learn.withColumnRenamed("_id", "doc_id"), label="label", rows=rows)
    names = [f"_c{k}" for k in range(len(docs.columns))]  # given columns may have any names
    at = docs.columns.index(text)

    def choose(batches):
        for b in slices(batches, SLICE_BYTES):
            yield b.filter(pa.array(model.score(statistics(b.column(at))) >= threshold))

    numbered = docs.toDF(*names)
    return numbered.mapInArrow(choose, numbered.schema).toDF(*docs.columns)
