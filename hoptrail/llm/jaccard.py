"""N-gram Jaccard join: a MinHash LSH forest finds candidate pairs, whole texts verify them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import broadcast_if, numbered, slices, whole_groups, written
from .words import SLICE_BYTES, distinct, mix, shingles_of, words_of

TREES, LEVELS = 32, 8
SKETCH = 128          # minima that a bucket row carries, four bits each
BLOCK = 256           # sets of a cluster that stand in one block
BLOCK_SHINGLES = 1 << 19
COLUMNS = 4096
_K = np.arange(1, TREES * LEVELS + 1, dtype=np.uint64)
_XOR, _TIMES = mix(_K).astype(np.uint32), mix(_K + np.uint64(1 << 20)).astype(np.uint32) | np.uint32(1)


def recall(depth: int, similarity: float, trees: int = TREES) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` minima in one tree at least."""
    return 1 - (1 - similarity ** depth) ** trees


def depth_for(similarity: float, target: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix that meets the target recall: starts at full paths and shortens level by level."""
    depth = levels
    while depth > 1 and recall(depth, similarity, trees) < target:
        depth -= 1
    return depth


def signatures(n_docs: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(text, TREES * LEVELS) minima as 16-bit labels; zeros for a text without shingles. ``doc`` ascends."""
    out = np.zeros((n_docs, TREES * LEVELS), np.uint16)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][:len(doc)])
    if len(starts):
        has, low = doc[starts], (h >> np.uint64(8)).astype(np.uint32)
        for k in range(TREES * LEVELS):
            least = np.minimum.reduceat((low ^ _XOR[k]) * _TIMES[k], starts)
            out[has, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sets(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles and a 128-bit name (two signed integers) of each text's shingle set."""
    n = np.bincount(doc, minlength=n_docs)
    run = lambda v: np.r_[np.uint64(0), np.cumsum(v)]
    ends = np.r_[0, np.cumsum(n)]
    a, b = run(mix(h)), run(mix(h ^ np.uint64(0x5851F42D4C957F2D)))
    return n, (a[ends[1:]] - a[ends[:-1]]).view(np.int64), (b[ends[1:]] - b[ends[:-1]]).view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    def describe(batches):
        for b in slices(batches, SLICE_BYTES):
            doc, h = shingles_of(words_of(b.column(1)))
            doc, h, _ = distinct(doc, h)
            n, k1, k2 = _sets(doc, h, b.num_rows)
            sig = signatures(b.num_rows, doc, h)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "key", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(describe, "doc_id long, key long, n long, k1 long, k2 long, sig binary")


def _buckets(sig: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, tree) names of the prefixes of ``depth`` labels, and the other labels packed."""
    bucket = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(sig), TREES)).copy()
    for k in range(depth):
        bucket = mix(bucket * np.uint64(65599) + sig[:, :, k])
    deeper = np.zeros((len(sig), TREES), np.int64)
    for k in range(depth, LEVELS):
        deeper = deeper << 16 | sig[:, :, k]
    return bucket, deeper


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), TREES, LEVELS)


def _shared_trees(reps: DataFrame, depth: int) -> DataFrame:
    """(id, trees): for each set that shares a bucket, a bit for each tree in which it does. Sixteen bytes per set and tree are
    sorted by bucket; signatures stay where they are."""
    def spread(batches):
        for b in slices(batches, rows=2048):
            bucket, _ = _buckets(_signatures_of(b.column(1)), depth)
            tree = np.broadcast_to(np.arange(TREES, dtype=np.uint64), bucket.shape)
            # the tree stands in the bucket's lowest bits
            key = (bucket & ~np.uint64(TREES - 1) | tree).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), TREES))],
                                             names=["bucket", "id"])

    def shared(batches):
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            bucket, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if before is not None:  # the last row of the batch before waits for its successor
                bucket, ids = np.r_[before[0], bucket], np.r_[before[1], ids]
            same = np.r_[before is not None and before[2], bucket[1:] == bucket[:-1], False]
            again = (same[:-1] | same[1:])[:-1]
            yield found(bucket[:-1], ids[:-1], again)
            before = bucket[-1:], ids[-1:], bool(same[len(bucket) - 1])
        if before is not None:
            yield found(before[0], before[1], np.array([before[2]]))

    def found(bucket, ids, again):
        bit = np.int64(1) << (bucket[again] & (TREES - 1))
        return pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(bit)], names=["id", "trees"])

    rows = reps.select("id", "sig").mapInArrow(spread, "bucket long, id long")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(shared, "id long, trees long").groupBy("id").agg(F.bit_or("trees").alias("trees"))


def _bucket_rows(reps: DataFrame, depth: int) -> DataFrame:
    """One row per set and tree in which it shares its bucket (the tree's prefix of ``depth`` labels): bucket, deeper (the
    other labels), id, n, sketch. Sets that meet nobody, and their other trees, send none."""
    def spread(batches):
        for b in slices(batches, rows=2048):
            ids, n, trees = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            sig = _signatures_of(b.column(2))
            bucket, deeper = _buckets(sig, depth)
            nibble = (sig.reshape(len(ids), -1)[:, :SKETCH] & 15).astype(np.uint8)
            sketch = [s.tobytes() for s in nibble[:, ::2] << 4 | nibble[:, 1::2]]
            row, tree = np.nonzero(trees[:, None] >> np.arange(TREES) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)[row, tree]), pa.array(deeper[row, tree]), pa.array(ids[row]), pa.array(n[row]),
                 pa.array([sketch[k] for k in row.tolist()], pa.binary())], names=["bucket", "deeper", "id", "n", "sketch"])

    shared = written(_shared_trees(reps, depth), "shared-trees")
    some = reps.select("id", "n", "sig").join(broadcast_if(shared, 40 * shared.count()), "id").select("id", "n", "sig", "trees")
    return some.mapInArrow(spread, "bucket long, deeper long, id long, n long, sketch binary")


def _joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the classes of i and j: afterwards all rows of a class have its least label."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]


def _clusters(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a < b) that connect the sets of a bucket which may be similar: sizes allow it, sketches agree often enough.

    Rows of a bucket come sorted by their deeper labels, so those with the longest common path stand next to each other
    and join first; wider distances compare only what is not joined yet. So a bucket of many like sets takes few
    comparisons, and gives no more edges than it has rows. Of two sets of the similarity asked for, SKETCH labels agree
    less often than required with a probability under 1e-8 (six standard deviations).
    """
    expected = similarity + (1 - similarity) / 16
    enough = SKETCH * expected - 6 * (SKETCH * expected * (1 - expected)) ** 0.5

    def same(x: np.ndarray) -> np.ndarray:
        return ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)

    def edges(batches):
        for t in whole_groups(slices(batches, rows=65_536, most=16 << 20)):
            bucket, ids, n = (t.column(k).to_numpy() for k in (0, 2, 3))
            sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(ids), SKETCH // 2)
            labels, at, k = np.arange(len(ids)), np.arange(len(ids)), 0
            while len(at):
                k += 1
                at = at[at + k < len(ids)]
                at = at[bucket[at] == bucket[at + k]]
                for lo in range(0, len(at), 32_768):
                    i = at[lo:lo + 32_768]
                    i = i[(labels[i] != labels[i + k]) & (np.minimum(n[i], n[i + k]) >= similarity * np.maximum(n[i], n[i + k]))]
                    i = i[same(sketch[i] ^ sketch[i + k]) >= enough]
                    _joined(labels, i, i + k)
            a, b = ids[labels], ids
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "deeper")
    return sorted_rows.mapInArrow(edges, "a long, b long").distinct()


def _common(doc: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """(m, m) sizes of the common part of each two of m sets; hashes of one set only are left out first."""
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    doc, column = doc[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((m, m), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((m, COLUMNS), np.float32)
        x[doc[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def _counted(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(id, root, others) from the whole texts: for each set, per block pair, how many documents are similar to it, and
    the least id of those it is linked with there.

    A cluster of candidates is dealt to blocks of about ``BLOCK`` sets (fewer if they are long); each two blocks of it
    meet in one group, which compares all of its sets, but gives one row per set and not one per pair.
    """
    size = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    dealt = members.join(written(size.where("m > 1").drop("m"), "cluster-sizes"), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = written(dealt.drop("n"), "cluster-blocks")
    texts = docs.select("key", "text").join(broadcast_if(dealt, 96 * dealt.count()), F.col("key") == F.col("id"))
    met = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn(
        "group", F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")))

    def count(batches):
        for t in whole_groups(slices(batches, SLICE_BYTES)):
            group = t.column(0).to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
            got = []
            for lo, hi in zip(edges, edges[1:]):
                got += compared(t.slice(lo, hi - lo).combine_chunks())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["id", "root", "others"])

    def compared(t):
        sets = []
        for lo in range(0, t.num_rows, 2048):
            part = t.slice(lo, 2048)
            doc, h, _ = distinct(*shingles_of(words_of(part.column(1).combine_chunks())))
            sets.append((doc + lo, h, *_sets(doc, h, part.num_rows)))
        doc, h, n, k1, k2 = (np.concatenate(x) for x in zip(*sets))
        # a row with another text under the same key is not the set that was found; a repeated row is not another set
        right = np.flatnonzero((k1 == t.column(4).to_numpy()) & (k2 == t.column(5).to_numpy()))
        ids = t.column(2).to_numpy()
        right = right[np.unique(ids[right], return_index=True)[1]]
        if len(right) < 2:
            return []
        place = np.full(len(n), -1)
        place[right] = np.arange(len(right))
        kept = place[doc] >= 0
        ids, n, block, copies = ids[right], n[right], t.column(6).to_numpy()[right], t.column(3).to_numpy()[right]
        both = _common(place[doc[kept]], h[kept], len(right))
        linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
        linked &= ~np.eye(len(n), dtype=bool)
        if t.column(6)[0].as_py() != t.column(7)[0].as_py():  # a group of two blocks, even if one of them holds no set
            linked &= block[:, None] != block[None, :]
        labels = np.arange(len(ids))
        i, j = np.nonzero(np.triu(linked))
        _joined(labels, i, j)  # ids ascend, so the least label is the least id
        others = linked @ copies
        some = np.flatnonzero(linked.any(axis=1))
        return list(zip(ids[some].tolist(), ids[labels[some]].tolist(), others[some].tolist()))

    rows = met.select("group", "text", "id", "n_copies", "k1", "k2", "block", "other")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(count, "id long, root long, others long")


def _row_key(doc_id: str, text: str):
    """Names a row by its id and text, so that rows without an id or with another row's id can be told apart."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def _classified(docs: DataFrame, similarity: float, target_recall: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, key, n, n_copies, _others and _first (the class's first row: isnull, doc_id, key) of each row. Sets that are
    similar to nothing and have no copies show nulls in the last three. Sets go by the least ``key`` of their rows."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _row_key(doc_id, text).alias("key"))
    described = written(_described(given), "shingle-sets")
    some = described.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_first")
    copies = some.groupBy("n", "k1", "k2").agg(F.min("key").alias("id"), first, F.count(F.lit(1)).alias("n_copies"))
    copies = written(copies, "set-copies")
    least = copies.where("n_copies > 1").select("n", "k1", "k2", F.col("id").alias("_least"))
    reps = some.withColumnRenamed("key", "id").join(broadcast_if(least, 40 * least.count()), ["n", "k1", "k2"], "left")
    reps = reps.where("_least IS NULL OR id = _least").select("id", "n", "sig")
    edges = written(_clusters(_bucket_rows(reps, depth_for(similarity, target_recall)), similarity), "candidate-edges")
    clusters = connected_components(edges, a="a", b="b").select(F.col("ip").alias("id"), F.col("root").alias("cluster"))
    members = copies.join(clusters, "id").select("id", "n", "k1", "k2", "n_copies", "cluster")
    counted = written(_counted(members, given, similarity), "similar-sets")
    roots = connected_components(counted, a="id", b="root").select(F.col("ip").alias("id"), F.col("root").alias("_root"))
    roots = written(roots.join(copies.select("id", "_first"), "id"), "set-roots")
    firsts = written(roots.groupBy("_root").agg(F.min("_first").alias("_class")), "class-firsts")
    classes = roots.select("id", "_root").join(broadcast_if(firsts, 40 * firsts.count()), "_root").select("id", "_class")
    others = counted.groupBy("id").agg(F.sum("others").alias("_others"))
    facts = copies.join(classes, "id", "left").join(others, "id", "left").where("n_copies > 1 OR _class IS NOT NULL").select(
        "n", "k1", "k2", F.coalesce("_class", "_first").alias("_first"), "n_copies", F.coalesce("_others", F.lit(0)).alias("_others"))
    return described.select("doc_id", "key", "n", "k1", "k2").join(written(facts, "set-classes"), ["n", "k1", "k2"], "left")


def similar_documents(docs: DataFrame, similarity: float = 0.8, target_recall: float = 0.9999,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of ``similarity``: one row per document with
    doc_id, class_id (the smallest id that links lead to), n_links (similar documents, copies included) and n_copies
    (documents with the same set, itself included).

    Words are split at ASCII white space and compare as they are. A text of one to four words has one shingle; without
    words it has none, is similar to nothing and makes a class of its own. Copies fold into one row before anything is
    compared. Rows count by themselves, also without an id or with an id that other rows have; a class in which no row has
    an id shows null. Empty table: no rows.

    Each set has a path of minima in each of ``TREES`` tries; sets meet where they share a prefix of the depth that
    ``depth_for`` gives. Sketches drop most accidental meetings; what is left makes clusters, in which whole texts decide
    every pair. Pairs are counted where they are compared and never listed.
    """
    found, n = _classified(docs, similarity, target_recall, doc_id, text), F.coalesce("n_copies", F.lit(1))
    return found.select(
        "doc_id", F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("class_id"),
        (n - 1 + F.coalesce("_others", F.lit(0))).cast("long").alias("n_links"), n.cast("long").alias("n_copies"))


def without_similar(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                    target_recall: float = 0.9999) -> DataFrame:
    """One row of each class, that of the smallest doc_id (of several, the one of the least hash of its text; rows without an
    id come after all others); all columns stay, whatever their names. Texts without words all stay."""
    found = written(_classified(docs, similarity, target_recall, doc_id, text).where("n_copies IS NOT NULL").select(
        "key", (F.col("key") != F.col("_first.key")).alias("_goes")), "similar-rows")
    gone = written(found.where("_goes").select(F.col("key").alias("_gone")).distinct(), "similar-gone")
    given, place = numbered(docs)
    key = _row_key(place[doc_id], place[text])
    kept = given.join(broadcast_if(gone, 16 * gone.count()), key == F.col("_gone"), "left_anti")
    again = found.where("NOT _goes").groupBy(F.col("key").alias("_again")).count().where("count > 1").drop("count")
    again = written(again, "similar-again")
    if again.isEmpty():
        return kept.toDF(*docs.columns)
    size = 16 * again.count()  # rows that repeat the one which stays, id and text
    once = kept.join(broadcast_if(again, size), key == F.col("_again")).withColumn("_nth", F.row_number().over(
        W.partitionBy("_again").orderBy(F.xxhash64(*given.columns)))).where("_nth = 1")
    rest = kept.join(broadcast_if(again, size), key == F.col("_again"), "left_anti")
    return rest.unionByName(once.drop("_again", "_nth")).toDF(*docs.columns)
