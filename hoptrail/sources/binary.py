"""Reader of the binary hop-list format.

A file is a chain of blocks (four words, the third counts the records), a record is a destination, a hop count and the
hops; only a walk along the counts tells where a record starts. The walk reads a file in windows of bounded size; the
windows it finds are decoded by other tasks, so one large file is decoded by many and none is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import int_to_ip

SCHEMA = "file string, rec bigint, dest bigint, n_hops int, idx int, ip bigint, rtt double, ttl bigint, corrupt boolean"
LIMIT = 512         # a TTL or hop count above this marks a corrupt file
WINDOW = 4 << 20    # bytes a task holds at a time; not below the longest record's 8 + 12 * LIMIT


class Window(NamedTuple):
    """Whole records of a file: where its bytes begin and end, what the walk knew there, and what it found."""
    begin: int
    end: int
    left: int               # records of the block still to come at `begin`
    rec: int                # number of the first record
    words: np.ndarray
    heads: np.ndarray       # word at which each record starts
    corrupt: bool           # the file is corrupt or cut off after these records


def _hop_words(words: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, number in the record, word) of every hop."""
    n = words[heads + 1].astype(np.int64)
    of = np.repeat(np.arange(len(heads)), n)
    idx = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, idx, heads[of] + 2 + 3 * idx


def _windows(read: Callable[[int, int], bytes], size: int, window: int = WINDOW, begin: int = 0, left: int = 0, rec: int = 0) -> Iterator[Window]:
    """Walks `read(offset, bytes)` from `begin` to `size`; the last window of a corrupt file says so."""
    while begin < size:
        data = read(begin, min(window, size - begin))
        words = np.frombuffer(data, "<u4", len(data) // 4)
        counts, total, last = memoryview(words), len(words), begin + len(data) >= size
        at, heads, to_come, corrupt = 0, [], left, False
        while to_come or at < total or len(data) % 4:
            if at + (2 if to_come else 4) > total:
                corrupt = last
                break
            if not to_come:
                to_come = counts[at + 2]
                at += 4
                continue
            hops = counts[at + 1]
            corrupt = hops > LIMIT or (last and at + 2 + 3 * hops > total)
            if corrupt or at + 2 + 3 * hops > total:
                break
            heads.append(at)
            at += 2 + 3 * hops
            to_come -= 1
        starts = np.array(heads, np.int64)
        of, _, place = _hop_words(words, starts)
        wrong = of[words[place + 2] > LIMIT]
        if len(wrong):
            starts, corrupt = starts[:wrong[0]], True
        yield Window(begin, begin + 4 * at, left, rec, words, starts, corrupt)
        if corrupt:
            return
        begin, left, rec = begin + 4 * at, to_come, rec + len(starts)


def _columns(file: str, w: Window) -> pa.RecordBatch:
    """Rows of SCHEMA: one per hop, one for a record without hops, one where the file turns corrupt."""
    n = w.words[w.heads + 1].astype(np.int64)
    of, idx, place = _hop_words(w.words, w.heads)
    bare = np.flatnonzero(n == 0)
    end = int(w.corrupt)
    rec = np.concatenate([of, bare, np.zeros(end, np.int64)])
    no_hop, no_rec = np.arange(len(rec)) >= len(of), np.arange(len(rec)) >= len(rec) - end
    whole = lambda v: np.concatenate([v, np.zeros(len(rec) - len(v), v.dtype)])
    head = w.heads[rec] if len(w.heads) else np.zeros(len(rec), np.int64)
    hops = n[rec] if len(n) else np.zeros(len(rec), np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([file] * len(rec), pa.string()), pa.array(rec + w.rec, pa.int64(), mask=no_rec),
        pa.array(w.words[head].byteswap().astype(np.int64) if len(w.words) else head, pa.int64(), mask=no_rec),
        pa.array(hops.astype(np.int32), mask=no_rec), pa.array(whole(idx).astype(np.int32), mask=no_hop),
        pa.array(whole(w.words[place].byteswap().astype(np.int64)), mask=no_hop),
        pa.array(whole(w.words.view("<f4")[place + 1].astype(np.float64)), mask=no_hop),
        pa.array(whole(w.words[place + 2].astype(np.int64)), mask=no_hop), pa.array(no_rec)],
        names=[c.split()[0] for c in SCHEMA.split(", ")])


def _destinations(file: str, w: Window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(w.heads), pa.string()), pa.array(np.arange(len(w.heads)) + w.rec), pa.array(w.words[w.heads].byteswap().astype(np.int64))],
        names=["file", "rec", "dest"])


def _range(file: str, w: Window) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"file": [file], "begin": [w.begin], "end": [w.end], "left": [w.left], "rec": [w.rec], "corrupt": [w.corrupt], "n": [len(w.heads)]},
        pa.schema([("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("left", pa.int64()), ("rec", pa.int64()), ("corrupt", pa.bool_()), ("n", pa.int64())]))


def _open(path: str):
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, place = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.open_input_file(place)


def _over_contents(emit):
    def run(batches):
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content")):
                data = memoryview(content.as_buffer())
                for w in _windows(lambda at, n: data[at:at + n], len(data)):
                    yield emit(file, w)
    return run


def _over_files(emit, window: int = WINDOW):
    def run(batches):
        for b in batches:
            for file, length in zip(b.column("file").to_pylist(), b.column("length").to_pylist()):
                with _open(file) as f:
                    for w in _windows(lambda at, n: f.read_at(n, at), length, window):
                        yield emit(file, w)
    return run


def _decode_ranges(batches):
    for b in batches:
        for r in b.to_pylist():
            with _open(r["file"]) as f:
                # up to `end` all records are whole; what follows in a corrupt file was seen by the walk
                data = f.read_at(r["end"] - r["begin"], r["begin"])
            words = np.frombuffer(data, "<u4")
            found = next(_windows(lambda at, n: data, len(data), len(data), 0, r["left"], r["rec"]), None)
            heads = found.heads[:r["n"]] if found else np.zeros(0, np.int64)
            yield _columns(r["file"], Window(r["begin"], r["end"], r["left"], r["rec"], words, heads, r["corrupt"]))


def decode_hop_files(files: DataFrame) -> DataFrame:
    """`(file, content)` -> one row per hop (and one per record without hops); a corrupt file ends in a marked row."""
    return files.select("file", "content").mapInArrow(_over_contents(_columns), SCHEMA)


def decode_destinations(files: DataFrame) -> DataFrame:
    """`(file, content)` -> (file, rec, dest) of every record; hops are stepped over."""
    return _named(files.select("file", "content").mapInArrow(_over_contents(_destinations), "file string, rec bigint, dest bigint"))


def _named(d: DataFrame) -> DataFrame:
    return d.select("file", "rec", int_to_ip("dest").alias("dest"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) in as many tasks as the session shuffles to; no content is read here."""
    d = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")


def hop_file_ranges(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """(file, begin, end, left, rec, corrupt, n): byte ranges of whole records, at most `window` bytes each."""
    return _files(spark, path).mapInArrow(
        _over_files(_range, window), "file string, begin bigint, end bigint, left bigint, rec bigint, corrupt boolean, n bigint")


def read_iplane_binary(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """As `decode_hop_files`, for files in a folder: a walk finds ranges, which are then dealt to tasks and decoded."""
    ranges = hop_file_ranges(spark, path, window).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "begin")
    return ranges.mapInArrow(_decode_ranges, SCHEMA)


def read_iplane_destinations(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, dest) of every record of the files in a folder."""
    return _named(_files(spark, path).mapInArrow(_over_files(_destinations), "file string, rec bigint, dest bigint"))
