"""WARC records in ZIP packages (stored members): a writer, and a reader that fetches byte ranges.

A package holds archive/data.warc.gz (one gzip member per record), indexes/index.cdxj (a line per record with its byte
range in the archive) and datapackage.json, all stored without further compression, so that a record can be fetched
from the package itself.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_folder, slices, written

FILE_BYTES = 64 << 20
RUN_BYTES = 16 << 20   # bytes of a package whose records one task reads
READ_BYTES = 4 << 20
LEAST_REVISIT = 100
ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
# Fixed values of the ZIP format: signatures, and the numbers that send a reader to the 64-bit fields.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
NONE16, NONE32 = 0xFFFF, 0xFFFFFFFF
URL_SAFE = "/:?&=#%~+,;@!$'()*-._[]"  # so an index line's key has neither spaces nor braces
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_DDL = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
            "payload binary")
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload, digest, record_type, refers_to.

    A null html is an empty payload. Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page_id
    is the response and others revisit it; rows that repeat this page_id are all responses, and a null page_id revisits
    unless all of its group are null. A null url is written as empty.
    """
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), raw.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    same = p.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_first")
    j = p.join(same, "digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return j.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("_first")).alias("refers_to"))


def record_bytes(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP head only and names payload size and digest in its header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One ZIP package while it is written."""

    def __init__(self, stream):
        self.stream, self.lines, self.at, self.raw = stream, [], 0, 0
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, record: bytes, url: str, date: str, kind: str, digest: str) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        stamp = "".join(c for c in date if c.isdigit())[:14]
        facts = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "digest": f"sha256:{digest}",
                 "offset": str(self.at), "length": str(len(data)), "filename": "data.warc.gz"}
        self.lines.append(f"{quote(url, safe=URL_SAFE)} {stamp} {json.dumps(facts)}")
        self.at += len(data)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)) + "\n")
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({
            "profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.at}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return len(self.lines)


def write_archives(records: DataFrame, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes ``plan_records`` rows to ZIP packages of about ``FILE_BYTES``; returns the list of packages (file, n_records).

    The list is written as Parquet and names the packages of committed task attempts only. No rows, no package.
    """
    folder = folder or shared_folder(records.sparkSession, "warc")

    def write(batches):
        fs, base, package, name, seq = None, "", None, "", 0
        for b in slices(batches, rows=512):
            if fs is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
            for page_id, url, payload, digest, kind, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                if package is None:
                    name = f"pages-{TaskContext.get().partitionId():06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.wacz"
                    package, seq = _Package(fs.open_output_stream(f"{base}/{name}")), seq + 1
                package.add(record_bytes(page_id, url, payload, digest, kind, refers_to, date), url, date, kind, digest)
                if package.at >= FILE_BYTES:
                    yield _listed(f"{folder}/{name}", package.close())
                    package = None
        if package is not None:
            yield _listed(f"{folder}/{name}", package.close())

    rows = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return written(rows.mapInArrow(write, "file string, n_records long"), "warc-list")


def _listed(name: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])


def directory(source) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file from its central directory: name -> (method, stored bytes, local header's offset)."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if NONE16 == count or NONE32 in (length, offset):
        at = tail_at + end - 20
        locator = source.read_at(20, at)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    data, at, found = source.read_at(length, offset), 0, {}
    for _ in range(count):
        if data[at:at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # 64-bit values stand for those fields only that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == NONE32 else full
                packed = next(wide) if packed == NONE32 else packed
                header = next(wide) if header == NONE32 else header
            k += 4 + n
        found[name] = (method, packed, header)
        at += 46 + n_name + n_extra + n_note
    return found


def member_range(source, found: dict, name: str) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the package."""
    method, packed, header = found[name]
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is compressed; byte ranges need a stored member")
    local = source.read_at(30, header)
    if local[:4] != LOCAL:
        raise ValueError(f"damaged local header of {name}")
    return header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed


def parse_record(record: bytes) -> tuple:
    """A row of ``READ_DDL`` from an unpacked record; raises ValueError where length or digest do not fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    payload, n = None, int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload of page {page}")
    refers = fields["WARC-Refers-To"][len("<urn:page:"):-1] if kind == "revisit" else None
    return int(page) if page else None, fields["WARC-Target-URI"], kind, int(refers) if refers else None, n, digest, payload


def locate_records(packages: DataFrame) -> DataFrame:
    """One row per record of the packages: file, offset and length (in the package file). Packages are dealt to as many tasks
    as the session shuffles to, and so are their records, in runs of neighbours."""
    def locate(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = file_system(name)
                with fs.open_input_file(path) as source:
                    found = directory(source)
                    archive, _ = member_range(source, found, ARCHIVE)
                    at, length = member_range(source, found, INDEX)
                    lines = source.read_at(length, at).decode().split("\n")
                facts = [json.loads(x[x.index(" {") + 1:]) for x in lines if x]
                spots = sorted((archive + int(f["offset"]), int(f["length"])) for f in facts)
                for k in range(0, len(spots), 8192):
                    part = spots[k:k + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array([p[0] for p in part]), pa.array([p[1] for p in part])],
                        names=["file", "offset", "length"])

    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packages.select("file").repartition(tasks, "file").mapInArrow(locate, "file string, offset long, length long")
    run = F.floor(F.col("offset") / RUN_BYTES)
    return found.repartition(tasks, "file", run).sortWithinPartitions("file", "offset")


def read_archives(spots: DataFrame) -> DataFrame:
    """Fetches records by byte range, in any order or choice of rows; see ``READ_DDL``. A revisit has no payload.

    Neighbouring records of a file are fetched with one range read of at most ``READ_BYTES`` (or one record).
    """
    def read(batches):
        name, source = None, None
        for b in slices(batches, rows=1024):
            rows = list(zip(*[c.to_pylist() for c in b.columns]))
            k = 0
            while k < len(rows):
                first, last = rows[k], k
                end = first[1] + first[2]
                while (last + 1 < len(rows) and rows[last + 1][:2] == (first[0], end)
                       and end + rows[last + 1][2] - first[1] <= READ_BYTES):
                    last += 1
                    end += rows[last][2]
                if first[0] != name:
                    if source is not None:
                        source.close()
                    fs, path = file_system(first[0])
                    name, source = first[0], fs.open_input_file(path)
                data = source.read_at(end - first[1], first[1])
                got = [parse_record(zlib.decompress(data[at - first[1]:at - first[1] + n], 31)) for _, at, n in rows[k:last + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _READ.types)], schema=_READ)
                k = last + 1
        if source is not None:
            source.close()

    return spots.select("file", "offset", "length").mapInArrow(read, READ_DDL)
