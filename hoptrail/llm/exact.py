"""Exact duplicates: groups by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, slices, written

_HASHES = ["h1", "h2", "text_sha256"]
_SCHEMA = "doc_id long, h1 long, h2 long, text_sha256 string"


def _hashed(batches, with_text: bool, at: int | None = None):
    """Adds h1, h2 and text_sha256 (and the normal text) to batches.

    The text is column ``at``, which stays; without it the last one, which goes.
    """
    for b in slices(batches):
        low = pc.ascii_lower(pc.fill_null(b.column(b.num_columns - 1 if at is None else at), ""))
        given = b.num_columns - (at is None)
        raw = [t.encode() for t in low.to_pylist()]
        h = [xxhash.xxh3_128_digest(t) for t in raw]
        yield pa.RecordBatch.from_arrays([
            *b.columns[:given], pa.array([int.from_bytes(x[:8], "big", signed=True) for x in h], pa.int64()),
            pa.array([int.from_bytes(x[8:], "big", signed=True) for x in h], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()), *[low] * with_text,
        ], names=[*b.schema.names[:given], *_HASHES, *["normal"] * with_text])


def _copies(given: DataFrame) -> DataFrame:
    """Groups of several rows with equal texts: h1, h2, text_sha256, keep_id, group_size; given: doc_id, text."""
    groups = given.mapInArrow(lambda it: _hashed(it, True), f"{_SCHEMA}, normal string").groupBy(*_HASHES, "normal").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return written(groups.select(*_HASHES, "keep_id", "group_size").where("group_size > 1"), "copies")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The group's largest doc_id
    stays. Rows that repeat the largest doc_id are all kept rows of it; a null doc_id stays only where all of its group
    are null. An empty table gives no rows.

    Groups form by (128-bit hash, text): the hash decides nearly every comparison and the bytes decide the rest, so a
    collision cannot join two texts. Every task first folds its own copies of a text to one row, so a group that holds a
    third of all rows sends one row per task. Rows then get their group back by (hash, SHA-256) without their text.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = given.mapInArrow(lambda it: _hashed(it, False), _SCHEMA)
    j = rows.join(_copies(given), _HASHES, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return j.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, that with the largest doc_id; all columns stay.

    Rows that repeat this id and text leave one of them, as do groups without any id.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    copies = _copies(given)
    names = [f"_c{k}" for k in range(len(docs.columns))]  # given columns may have any names
    numbered = docs.toDF(*names)
    place = {c: names[k] for k, c in enumerate(docs.columns)}
    at = docs.columns.index(text)
    out = type(numbered.schema)(list(numbered.schema.fields)).add("h1", "long").add("h2", "long").add("text_sha256", "string")
    hashed = numbered.mapInArrow(lambda it: _hashed(it, False, at), out)
    j = hashed.join(broadcast_if(copies, 128 * copies.count()), _HASHES, "left")
    alone = j.where("group_size IS NULL").select(*names)
    kept = j.where(F.col("group_size").isNotNull() & F.col(place[doc_id]).cast("long").eqNullSafe(F.col("keep_id")))
    return alone.unionByName(kept.dropDuplicates(_HASHES).select(*names)).toDF(*docs.columns)
