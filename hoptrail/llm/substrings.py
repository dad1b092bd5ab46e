"""Repeated byte strings: suffixes at covering positions are named and settled, the windows between follow from them.

A string of ``length`` bytes that occurs twice has, in both places, the same sampled position at the same distance: the
leftmost least of the hashes of its first ``WINDOW`` k-mers. These positions are a difference cover by content (for any
two equal windows one distance leads both to a sampled position), thin enough to sort: about one in ``WINDOW / 2`` bytes.
The windows that share a sampled position are neighbours. They are settled together by two names of it: its core, the
bytes that all windows which may lead to it have in common, and its span, the bytes that its own windows cover.

- A core that occurs once: none of the windows is repeated.
- A span that occurs again: all of them are.
- Else the windows of the positions with this core are named one by one and sorted, equal neighbours are repeated; where a
  core has many spans, their windows are halved until core and span settle each half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, slices, whole_groups, written
from .words import buffers, mix, prefix_hash

WINDOW, KMER = 128, 16
SLICE = 1 << 20
CLASS_ROWS = 2048     # spans of one core that a task settles by itself
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_COVER_DDL = "rid long, t1 long, t2 long, spot long, core long, s1 long, s2 long"


def _name(run: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
    return mix((run[end] - run[start]) * inverse[start] + np.asarray(salt).astype(np.uint64)).view(np.int64)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: block-wise running minima from both sides, met in the middle."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _sampled(data: np.ndarray, bounds: np.ndarray, length: int):
    """(text, sampled position, first and last window that lead to it) with all places in ``data``, ascending."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    run, inverse = prefix_hash(data)
    n = len(data) - KMER + 1
    kmer = mix((run[KMER:] - run[:n]) * inverse[:n])
    least = _sliding_least((kmer & _HIGH) | np.arange(n, dtype=np.uint64), WINDOW)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    windows = np.flatnonzero(np.arange(len(data)) + length <= ends)
    if not len(windows):
        return none, none, none, none
    at = (least[windows] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last = windows[new], windows[np.r_[new[1:], len(windows)] - 1]
    return np.searchsorted(bounds, first, side="right") - 1, at[new], first, last


def _cover(keyed: DataFrame, length: int) -> DataFrame:
    """One row per sampled position: text (rid, t1, t2), spot (place in it and the least and largest distance of its
    windows, in one number), names of core and span."""
    core_bytes = length - WINDOW + 1

    def cover(batches):
        for b in slices(batches, SLICE):
            data, bounds = buffers(b.column(3))
            text, at, first, last = _sampled(data, bounds, length)
            if not len(at):
                continue
            span = (at - last) << 8 | (at - first)
            run, inverse = prefix_hash(data)
            run2, inverse2 = prefix_hash(data, 1)
            yield pa.RecordBatch.from_arrays([
                *[b.column(k).take(pa.array(text)) for k in range(3)], pa.array((at - bounds[text]) << 16 | span),
                pa.array(_name(run, inverse, at, at + core_bytes, 0)), pa.array(_name(run, inverse, first, last + length, span)),
                pa.array(_name(run2, inverse2, first, last + length, span)),
            ], names=["rid", "t1", "t2", "spot", "core", "s1", "s2"])

    return keyed.select("rid", "t1", "t2", "text").mapInArrow(cover, _COVER_DDL)


def _window_names(spans, core: np.ndarray, low: np.ndarray, high: np.ndarray, length: int):
    """(row, distance, two names) of every window of each span; equal windows have equal cores, distances and names."""
    data, bounds = buffers(spans)
    n = high - low + 1
    row = np.repeat(np.arange(len(n)), n)
    distance = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    start = bounds[row] + high[row] - distance
    salt = mix(core.view(np.uint64))[row] + distance.astype(np.uint64)
    names = [_name(*prefix_hash(data, k), start, start + length, salt) for k in (0, 1)]
    return row, distance, names[0], names[1]


def _spans_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Fetches the bytes of wanted spans (t1, t2, wants: spots): t1, t2, at, range, core, span."""
    core_bytes = length - WINDOW + 1

    def fetch(batches):
        for b in slices(batches, SLICE, rows=512):
            rows = []
            for text, t1, t2, wants in zip(*[c.to_pylist() for c in b.columns]):
                raw = text.encode()
                for spot in wants:
                    at, low, high = spot >> 16, spot >> 8 & 255, spot & 255
                    rows.append((t1, t2, at, spot & 65535, raw[at - high:at - low + length]))
            for k in range(0, len(rows), 8192):
                t1, t2, at, both, span = (pa.array(c, t) for c, t in zip(zip(*rows[k:k + 8192]), kinds))
                data, bounds = buffers(span)
                begin = bounds[:-1] + (both.to_numpy() & 255)
                core = _name(*prefix_hash(data), begin, begin + core_bytes, 0)
                yield pa.RecordBatch.from_arrays([t1, t2, at, both, pa.array(core), span], names=["t1", "t2", "at", "range", "core", "span"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    j = docs.join(wanted, ["t1", "t2"]).select("text", "t1", "t2", "wants")
    return j.mapInArrow(fetch, "t1 long, t2 long, at long, range int, core long, span binary")


def _settled_in_task(spans: DataFrame, length: int) -> DataFrame:
    """(t1, t2, begin, end) of repeated windows, for cores with few spans: all spans of a core are sorted in one task."""
    def settle(batches):
        for t in whole_groups(slices(batches, 4 << 20)):
            core, low, high, at = (t.column(k).to_numpy() for k in (0, 4, 5, 3))
            row, distance, h1, h2 = _window_names(t.column(6).combine_chunks(), core, low, high, length)
            order = np.lexsort((h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            again = np.zeros(len(row), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            row, distance = row[again], distance[again]
            if not len(row):
                continue
            # neighbouring windows of a span become one run; distances fall within a row
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] - 1)])
            last = np.r_[new[1:], len(row)] - 1
            r = row[new]
            yield pa.RecordBatch.from_arrays(
                [t.column(k).combine_chunks().take(pa.array(r)) for k in (1, 2)]
                + [pa.array(at[r] - distance[new]), pa.array(at[r] - distance[last] + length)], names=["t1", "t2", "begin", "end"])

    given = spans.select("core", "t1", "t2", "at", F.shiftright("range", 8).cast("long").alias("low"),
                         F.col("range").bitwiseAND(255).cast("long").alias("high"), "span")
    return given.repartition("core").sortWithinPartitions("core").mapInArrow(settle, "t1 long, t2 long, begin long, end long")


def _settled_by_halves(spans: DataFrame, length: int) -> DataFrame:
    """As ``_settled_in_task`` for cores with many spans: the distances are halved until each half is settled.

    A half of a span's windows has a core and a span of its own. In each round they are counted by name over all tasks: a
    core that occurs once settles its half (no window is repeated), a span that occurs again settles it too (all are), and
    one of the equal spans goes on for the sake of others. So a round has at most two rows per span that is still open.
    """
    def split(half):
        def run(batches):
            for b in slices(batches, 256 << 10):
                core, at, top, low, high, block = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 3, 4, 5, 6, 7))
                row, upper = np.divmod(np.arange(2 * len(core)), 2)
                begin = block[row] + upper * half
                some = np.flatnonzero((low[row] < begin + half) & (high[row] >= begin))
                row, begin = row[some], begin[some]
                least, most = np.maximum(low[row], begin), np.minimum(high[row], begin + half - 1)
                span = b.column(8).take(pa.array(row))
                data, bounds = buffers(span)
                spot = bounds[:-1] + top[row]  # the sampled position
                inner = mix(core[row].view(np.uint64)) + begin.astype(np.uint64)
                outer = mix(inner) + (least << 8 | most).astype(np.uint64)
                names = [_name(*prefix_hash(data, k), spot - begin, spot - begin - half + 1 + length, inner) for k in (0, 1)]
                names += [_name(*prefix_hash(data, k), spot - most, spot - least + length, outer) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).take(pa.array(row)) for k in range(5)] + [pa.array(c) for c in (least, most, begin, *names)] + [span],
                    names=["core", "t1", "t2", "at", "top", "low", "high", "block", "c1", "c2", "s1", "s2", "span"])
        return run

    high = F.col("range").bitwiseAND(255).cast("long")
    open_ = spans.select("core", "t1", "t2", "at", high.alias("top"), F.shiftright("range", 8).cast("long").alias("low"),
                         high.alias("high"), F.lit(0).cast("long").alias("block"), "span")
    ddl = "core long, t1 long, t2 long, at long, top long, low long, high long, block long"
    found, half = None, WINDOW
    while half > 1:
        half //= 2
        halves = written(open_.mapInArrow(split(half), f"{ddl}, c1 long, c2 long, s1 long, s2 long, span binary"), "open-halves")
        cores = halves.groupBy("c1", "c2").count().where("count > 1").select("c1", "c2")
        halves = written(halves.join(cores, ["c1", "c2"], "left_semi"), "open-halves")
        again = halves.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2")
        runs = halves.join(again, ["s1", "s2"], "left_semi").select(
            "t1", "t2", (F.col("at") - F.col("high")).alias("begin"), (F.col("at") - F.col("low") + length).alias("end"))
        found = runs if found is None else found.unionByName(runs)
        open_ = halves.dropDuplicates(["s1", "s2"]).select(*[c.split()[0] for c in ddl.split(", ")], "span")
    return found


def _merged_runs(intervals: DataFrame) -> DataFrame:
    """(t1, t2, begins, ends): the union of each text's intervals; repeated ones fold in their tasks first."""
    def merge(batches):
        for b in slices(batches, rows=1024):
            begins, ends = [], []
            for runs in b.column(2).to_pylist():
                x = np.array([(r["begin"], r["end"]) for r in runs], np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(np.r_[True, x[1:, 0] > reach[:-1]])
                begins.append(x[new, 0].tolist())
                ends.append(reach[np.r_[new[1:], len(x)] - 1].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                                             names=["t1", "t2", "begins", "ends"])

    runs = intervals.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return runs.mapInArrow(merge, "t1 long, t2 long, begins array<long>, ends array<long>")


def repeated_runs(keyed: DataFrame, length: int) -> DataFrame:
    """(t1, t2, begins, ends): bytes covered by repeated windows, for the texts (rid, t1, t2, text) that have some."""
    cover = written(_cover(keyed, length), "cover")
    cores = written(cover.groupBy("core").count().where("count > 1").select("core"), "repeated-cores")
    some = written(cover.join(cores, "core").select(
        "rid", "spot", F.col("spot").bitwiseAND(65535).alias("range"), "core", "s1", "s2"), "repeated-cover")
    texts = written(cover.select("rid", "t1", "t2").distinct(), "cover-texts")
    discard(cover)
    span = ["core", "range", "s1", "s2"]
    first = F.min(F.struct("rid", "spot"))
    names = some.groupBy(*span).agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select(*span, "n", "f.rid", "f.spot")
    names = written(names, "span-names")
    at, low, high = F.shiftright("spot", 16), F.shiftright("range", 8), F.col("range").bitwiseAND(255)
    again = some.join(names.where("n > 1").select(*span), span).select("rid", (at - high).alias("begin"), (at - low + length).alias("end"))
    again = again.join(texts, "rid").select("t1", "t2", "begin", "end")
    classes = written(names.groupBy("core").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1"), "open-cores")
    open_ = names.join(classes, "core").join(texts, "rid")
    wanted = written(open_.groupBy("t1", "t2").agg(F.collect_list("spot").alias("wants")), "open-spans")
    size = wanted.agg(F.coalesce(F.sum(64 + 8 * F.size("wants")), F.lit(0))).first()[0]
    docs = keyed.select("t1", "t2", "text")
    spans = _spans_of(docs, broadcast_if(wanted, size), length).dropDuplicates(["core", "range", "span"])
    spans = written(spans.join(classes, "core"), "span-bytes")
    few = _settled_in_task(spans.where(F.col("spans") <= CLASS_ROWS), length)
    settled = again.unionByName(few)
    if not classes.where(F.col("spans") > CLASS_ROWS).isEmpty():
        settled = settled.unionByName(_settled_by_halves(spans.where(F.col("spans") > CLASS_ROWS), length))
    return _merged_runs(settled)


def remove_repeated(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, begins, ends (maximal removed runs of bytes), kept (remaining bytes).

    A byte goes when a string of ``length`` bytes covers it that also starts anywhere else, in the same document or in
    another; strings never cross documents and are judged on the input. A null text is an empty one; documents shorter
    than ``length`` stay whole; of two equal documents of at least ``length`` bytes nothing stays. Rows that repeat a
    document count as two documents. ``length`` must be ``WINDOW + KMER - 1`` or more. Empty table: no rows.
    """
    if length < WINDOW + KMER - 1:
        raise ValueError(f"length must be at least {WINDOW + KMER - 1}")
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    runs = written(repeated_runs(keyed.withColumn("rid", F.monotonically_increasing_id()), length), "removed-runs")
    size = runs.agg(F.coalesce(F.sum(64 + 16 * F.size("begins")), F.lit(0))).first()[0]

    def cut(batches):
        for b in slices(batches):
            n_bytes, kept = [], []
            for t, begins, ends in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)]):
                raw = t.encode()
                n_bytes.append(len(raw))
                edges = [0, *[x for run in zip(begins or (), ends or ()) for x in run], len(raw)]
                kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), b.column(2), b.column(3), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "begins", "ends", "kept"])

    j = keyed.join(broadcast_if(runs, size), ["t1", "t2"], "left").select("doc_id", "text", "begins", "ends")
    none = F.array().cast("array<bigint>")
    out = j.mapInArrow(cut, "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary")
    return out.withColumns({c: F.coalesce(c, none) for c in ("begins", "ends")})
