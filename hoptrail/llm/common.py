"""Shared helpers: written stages in the shared folder, bounded Arrow slices, files in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: a lineage cut that outlives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``written`` table once all that was made from it is written."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """(file system, path) of a folder or file in the shared folder; any scheme pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(pyarrow_uri(uri))


def pyarrow_uri(uri: str) -> str:
    scheme, rest = uri.split("://", 1)
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}"


_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss"}  # Hadoop's names of stores -> pyarrow's


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by their place, so that no given name can clash, and the place of each given name."""
    names = [f"_c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), {c: n for c, n in zip(df.columns, names)}


@functools.cache
def _trim() -> Callable[[int], object]:
    """The C library's call that gives free memory back to the system; nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, TypeError, AttributeError):
        return lambda _: None


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds few rows and about ``most`` bytes (one row at least).

    At the end a task's worker gives back what Arrow and the C library keep for reuse, as workers outlive tasks.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            size = part.nbytes
            while size > most and part.num_rows > 1:
                part = part.slice(0, max(1, part.num_rows * most // (2 * size)))
                size = part.nbytes
            yield part
            at += part.num_rows
    batch = part = None
    pa.default_memory_pool().release_unused()
    _trim()(0)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Re-cuts batches sorted by a non-null integer column so that no group of equal keys is split."""
    import numpy as np

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        k = table.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if k[0] <= k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None:
        yield held


def broadcast_if(df: DataFrame, size: int, most: int = 32 << 20) -> DataFrame:
    """Marks ``df`` for a broadcast where its measured ``size`` in bytes is within ``most``; else Spark joins by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if size <= most else df
