"""Token ids as framed binary records in files, with an offset index.

A record is: length of the payload (unsigned 64 bit), masked CRC-32 of these eight bytes (unsigned 32 bit), payload,
masked CRC-32 of the payload; all little-endian. Masking rotates a checksum right by 15 bits and adds a constant, so
that a checksum stored in data that is checked again does not look like one. The payload is a flag byte (1: the document
has an id), its id (signed 64 bit), the width of a token in bytes (2 or 4, one byte), and the token ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_system, shared_folder, slices, texts_of, written
from .tokens import encoder

MASK = 0xA282EAD8
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20
_HEAD, _CRC, _META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqB")
_INDEX = pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("record", pa.int64()),
                    ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("record", pa.int64()), ("doc_id", pa.int64()),
                   ("ids", pa.binary())])
INDEX_DDL = "file string, part long, seq long, record long, offset long, length long"
READ_DDL = "part long, seq long, record long, doc_id long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _CRC.pack(masked(length)) + payload + _CRC.pack(masked(payload))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return _META.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, bytes]:
    """(document id, ids as little-endian unsigned 32-bit integers)."""
    known, doc_id, width = _META.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_META.size).astype("<u4").tobytes()


def unframe(data: memoryview) -> bytes:
    """The payload of one record; raises ValueError where a checksum or length does not fit."""
    length, crc = _HEAD.unpack_from(data)
    if crc != masked(bytes(data[:8])) or len(data) != _HEAD.size + length + 4:
        raise ValueError("damaged record head")
    payload = bytes(data[_HEAD.size:_HEAD.size + length])
    if _CRC.unpack_from(data, _HEAD.size + length)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents' ids in ascending id order and returns the offset index (written as Parquet beside them).

    Null ids come first, rows with one id in the order of their text's hash; a null text is an empty one and holds only
    ``end_id``. Range partitioning sends neighbours to one task, which writes files of about ``FILE_BYTES``. File names
    are new for each attempt of a task, and only files of attempts that Spark commits stand in the index; so a task that
    is run again leaves an unused file and no wrong record. Index: file, part and seq (order of files), record (place in
    the file), offset, length.
    """
    folder = folder or shared_folder(docs.sparkSession, "records")

    def write(batches):
        enc, fs, part = encoder(tokenizer_path), None, TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        out, name, seq, record, at = None, "", -1, 0, 0
        try:
            for b in slices(batches):
                if fs is None:
                    fs, base = file_system(folder)
                    fs.create_dir(base, recursive=True)
                rows: list[tuple] = []
                for i, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b.column(1)))):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        seq, record, at = seq + 1, 0, 0
                        name = f"ids-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.rec"
                        out = fs.open_output_stream(f"{base}/{name}")
                    data = frame(payload_of(i, np.frombuffer(ids + end, "<u4")))
                    out.write(data)
                    rows.append((f"{folder}/{name}", part, seq, record, at, len(data)))
                    record, at = record + 1, at + len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(write, INDEX_DDL), "records-index")


def read_records(index: DataFrame) -> DataFrame:
    """Reads the index's records, in any order or choice of rows: part, seq, record, doc_id, ids (LE unsigned 32 bit).

    Neighbouring records of one file are fetched with one range read of at most ``READ_BYTES`` (or one record).
    """
    def read(batches):
        name, source = None, None
        for b in slices(batches, rows=2048):
            rows = list(zip(*[b.column(k).to_pylist() for k in range(6)]))
            k = 0
            while k < len(rows):
                first, last = rows[k], k
                end = first[4] + first[5]
                while (last + 1 < len(rows) and rows[last + 1][0] == first[0] and rows[last + 1][4] == end
                       and end + rows[last + 1][5] - first[4] <= READ_BYTES):
                    last += 1
                    end += rows[last][5]
                if first[0] != name:
                    if source is not None:
                        source.close()
                    fs, path = file_system(first[0])
                    name, source = first[0], fs.open_input_file(path)
                data = memoryview(source.read_at(end - first[4], first[4]))
                got = []
                for _, part, seq, record, at, length in rows[k:last + 1]:
                    got.append((part, seq, record, *parse_payload(unframe(data[at - first[4]:at - first[4] + length]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _READ.types)], schema=_READ)
                k = last + 1
        if source is not None:
            source.close()

    return index.select("file", "part", "seq", "record", "offset", "length").mapInArrow(read, READ_DDL)


def with_starts(records: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before, in file order. Sums run inside files and over one row per file."""
    inside = W.partitionBy("part", "seq").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    files = records.groupBy("part", "seq").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", "seq", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    j = records.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, ["part", "seq"])
    return j.withColumn("start", F.col("_in") + F.col("_before")).drop("_in", "_before")
