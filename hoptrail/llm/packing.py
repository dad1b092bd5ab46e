"""Best-fit packing of token sequences: whole lengths are planned as counts, pieces then take their places by rank."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, slices, texts_of, written
from .tokens import encoder

PIECE_DDL = "doc_id long, piece int, start long, length long, ids binary"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary())])


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, separator_id: int,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (little-endian unsigned 32 bit).

    A document's ids end with ``separator_id``; a null text is an empty one (a piece of one id). A document that fits
    is one piece. A longer one has full pieces and, where it doesn't divide evenly, a shorter first one.
    """
    def cut(batches):
        enc, end = encoder(tokenizer_path), struct.pack("<I", separator_id)
        for b in slices(batches, rows=1024):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b.column(1)))):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(i, k, lo, hi - lo, ids[4 * lo:4 * hi]) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE_DDL)


def _exact(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``; fewer parts and better supplied lengths first."""
    if left[gap]:
        return [gap]

    def pair(have: np.ndarray, total: int) -> tuple[int, int] | None:
        a = np.arange(1, total // 2 + 1)
        if not len(a):
            return None
        supply = np.minimum(have[a], have[total - a])
        if total % 2 == 0:
            supply[-1] = have[total // 2] // 2
        k = int(supply.argmax())
        return (total - int(a[k]), int(a[k])) if supply[k] > 0 else None

    if two := pair(left, gap):
        return list(two)
    have = left.copy()
    for c in (np.flatnonzero(left[:gap - 1])[::-1] if gap > 2 else []):
        have[c] -= 1
        two = pair(have, gap - int(c))
        have[c] += 1
        if two:
            return [int(c), *two]
    return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> times in a sequence, number of sequences) that use up ``counts`` (index: length).

    Longest lengths come first. A sequence's gap is filled exactly by one, two or three available lengths while there
    are such; what has no exact complement then goes best-fit: again and again the longest length that still fits. A
    pattern is used as often as its scarcest length allows, so each step exhausts a length, and steps are bounded by
    the capacity, whatever the number of pieces.
    """
    left, patterns = counts.astype(np.int64).copy(), []

    def use(parts: list[int]) -> None:
        need = {p: parts.count(p) for p in parts}
        times = min(int(left[p]) // k for p, k in need.items())
        for p, k in need.items():
            left[p] -= k * times
        patterns.append((need, times))

    for longest in range(capacity, 0, -1):
        while left[longest]:
            if longest == capacity:
                use([longest])
                continue
            left[longest] -= 1
            found = _exact(left, capacity - longest)
            left[longest] += 1
            if found is None:
                break
            use([longest, *found])
    for longest in range(capacity, 0, -1):
        while left[longest]:
            parts, room = [longest], capacity - longest
            left[longest] -= 1
            while room and len(fits := np.flatnonzero(left[:room + 1])):
                p = int(fits[-1])
                k = min(int(left[p]), room // p)
                parts += [p] * k
                left[p] -= k
                room -= k * p
            for p in parts:
                left[p] += 1
            use(parts)
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks per length: key (length and first rank in one number), times, first sequence, place."""
    taken, first_sequence = np.zeros(capacity + 1, np.int64), 0
    rows = []
    for need, times in patterns:
        at = 0
        for length, k in need.items():
            rows.append((length, int(taken[length]), k, first_sequence, at))
            taken[length] += k * times
            at += k * length
        first_sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "times": table[:, 2], "sequence": table[:, 3], "at": table[:, 4]}


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``capacity`` ids; all columns of ``pieces`` stay, but for given ones of
    these two names, which are replaced.

    The pieces are written, and again with their number among the pieces of equal length in their task (in two steps, so
    that a task that tokenizes does not keep a second Python worker). Counts per length
    (``capacity`` numbers at most) come to the driver for the plan, and its runs (at most a few per length) go to the
    tasks; the pieces themselves get their rank from one join on (task, length). An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    given = pieces.columns
    pieces, place = numbered(pieces)
    names, length = pieces.columns, place[length]

    def counted(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = b.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(n, kind="stable")
            run = n[order]
            new = np.r_[True, run[1:] != run[:-1]][:len(run)]
            starts = np.flatnonzero(new)
            within = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
            local = np.empty(len(run), np.int64)
            local[order] = within + seen[run]
            np.add.at(seen, n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), task)), pa.array(local)],
                                             names=[*names, "_task", "_local"])

    table = pieces.schema.jsonValue()
    ddl = type(pieces.schema).fromJson(table).add("_task", "long").add("_local", "long")
    stored = written(written(pieces, "pieces").mapInArrow(counted, ddl), "numbered-pieces")
    per_task = written(stored.groupBy("_task", length).agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy(length).agg(F.sum("_n").alias("n")).collect():
        counts[row[0]] = row["n"]
    places = _places(plan(counts, capacity), capacity)
    before = W.partitionBy(length).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    shift = per_task.select("_task", length, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = stored.join(shift, ["_task", length]).withColumn("_rank", F.col("_local") + F.col("_before")).select(*names, "_rank")

    def placed(batches):
        bits = 40
        keys = places["length"] << bits | places["rank"]
        for b in batches:
            n = b.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, n << bits | rank, side="right") - 1
            nth = rank - places["rank"][k]
            times = places["times"][k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(places["sequence"][k] + nth // times), pa.array(places["at"][k] + nth % times * n)],
                names=[*names, "sequence_id", "offset"])

    out = type(pieces.schema).fromJson(table).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(placed, out).toDF(*given, "sequence_id", "offset")
