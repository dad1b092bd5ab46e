"""Approximate nearest neighbours: NN-descent builds a graph, queries walk it greedily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, slices, whole_groups, written

BLOCK = 1024          # vectors compared with each other in a start block
SAMPLE = 4096         # vectors that the start's cuts are fitted on
PIVOTS = 256          # of these, entry points for queries
WIDTH = 256           # nodes that are compared with each other around one node
PAIRS = 1 << 22       # comparisons held at once
GRAPH_DDL = "node long, others array<long>, sims array<float>"
_GRAPH = pa.schema([("node", pa.int64()), ("others", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])


def _top(node: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int):
    """The k most similar distinct others of each node (ties: smaller other), by node and falling similarity."""
    order = np.lexsort((-sim, other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])][:len(node)] & (node != other)
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][:len(node)])
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
    return node[rank < k], other[rank < k], sim[rank < k]


def _rows(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Rows of ``GRAPH_DDL`` from entries sorted by node."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][:len(node)])
    ends = pa.array(np.r_[first, len(node)].astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(node[first]), pa.ListArray.from_arrays(ends, pa.array(other)),
        pa.ListArray.from_arrays(ends, pa.array(sim.astype(np.float32)))], schema=_GRAPH)


def _entries(t, k: int = 0):
    """(node, other, sim) of graph rows that start at column k."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns[k:k + 3]]
    n = pc.list_value_length(columns[1]).to_numpy(zero_copy_only=False)
    return (np.repeat(columns[0].to_numpy(zero_copy_only=False), n), columns[1].flatten().to_numpy(zero_copy_only=False),
            columns[2].flatten().to_numpy(zero_copy_only=False))


def _halves(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): the vectors that take part, as packed numbers of their own type.

    Left out: null ids, vectors that are null, empty or zero, hold null or non-finite components, or are not of the most
    frequent length (the smaller one on ties). Rows that repeat an id and its vector count once.
    """
    wide = dict(vectors.dtypes)[vector] == "array<double>"
    x = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND size(v) > 0")
    usual = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 0

    def packed(batches):
        for b in slices(batches):
            values = b.column(1).flatten()
            m = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
            good = np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1) > 0)
            m = m[good].astype(np.float64 if wide else np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in m], pa.binary())],
                                             names=["id", "vec"])

    return x.where(F.size("v") == size).mapInArrow(packed, "id long, vec binary").distinct()


def _vectors(column, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64 if wide else np.float32).reshape(len(column), -1).astype(np.float64)


def distinct_vectors(rows: DataFrame, members: int, wide: bool) -> DataFrame:
    """(node, vec, half, ids): one row per distinct vector, named by its smallest id, with its ``members`` smallest ids.

    Each task keeps its smallest ids of a vector before the shuffle, so a vector that many rows repeat is no hot spot.
    ``half`` is the unit vector in half precision, which steers building and search.
    """
    nth = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("_r", nth).where(F.col("_r") <= members)
    one = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def halved(batches):
        for b in slices(batches):
            m = _vectors(b.column(1), wide)
            scale = np.abs(m).max(axis=1, keepdims=True)
            m = m / scale
            unit = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in unit], pa.binary()), b.column(2)],
                                             names=["node", "vec", "half", "ids"])

    return one.select(F.col("ids")[0].alias("node"), "vec", "ids").mapInArrow(
        halved, "node long, vec binary, half binary, ids array<long>")


def _start(nodes: DataFrame, sample: np.ndarray, count: int, trees: int, k: int, seed: int) -> DataFrame:
    """First neighbours: in each of some random trees, vectors sorted by their path are compared in blocks of ``BLOCK``.

    A path is a row of bits (sides of random directions, cut at the sample's medians), then the place along one more
    direction. Blocks have a fixed size whatever the density, so no leaf grows.
    """
    rng = np.random.default_rng(seed)
    bits = max(0, min(24, int(np.ceil(np.log2(max(1, count / BLOCK))))))
    plane = rng.standard_normal((trees, bits + 1, sample.shape[1])).astype(np.float32)
    middle = np.stack([np.median(sample @ p.T, axis=0) for p in plane])

    def paths(batches):
        for b in slices(batches):
            x = _halves(b.column(1))
            for t in range(trees):
                side = x @ plane[t].T - middle[t]
                key = np.full(len(x), t, np.int64)
                for j in range(bits):
                    key = key << 1 | (side[:, j] > 0)
                place = np.clip((side[:, bits] + 8) / 16 * (1 << 24), 0, (1 << 24) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key << 24 | place), pa.array(np.full(len(x), t)), b.column(0), b.column(1)],
                                                 names=["path", "tree", "node", "half"])

    def blocks(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            while table.num_rows >= 2 * BLOCK:
                yield from compared(table.slice(0, BLOCK))
                table = table.slice(BLOCK)
            held = table
        if held is not None:
            yield from compared(held)

    def compared(table):
        tree = table.column(1).to_numpy()
        for t in np.unique(tree):
            at = np.flatnonzero(tree == t)
            if len(at) < 2:
                continue
            node, x = table.column(2).to_numpy()[at], _halves(table.column(3).take(pa.array(at)).combine_chunks())
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            m = min(k, len(at) - 1)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield _rows(np.repeat(node, m), node[best].ravel(), np.take_along_axis(s, best, axis=1).ravel())

    rows = nodes.select("node", "half").mapInArrow(paths, "path long, tree long, node long, half binary")
    return rows.repartitionByRange("path", "node").sortWithinPartitions("path", "node").mapInArrow(blocks, GRAPH_DDL)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """One graph row per node: the k best of all its rows."""
    def merge(batches):
        for t in whole_groups(batches):
            node, other, sim = _top(*_entries(t), k)
            if len(node):
                yield _rows(node, other, sim)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(merge, GRAPH_DDL)


def _both_ways(graph: DataFrame, most: int) -> DataFrame:
    """(node, adjacent): neighbours and those that have the node as theirs, the ``most`` closest. Ranks are cut before the
    shuffle, so a node that very many have as neighbour is no hot spot."""
    e = graph.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).select("node", "e.others", "e.sims")
    both = e.unionByName(e.select(F.col("others").alias("node"), F.col("node").alias("others"), "sims"))
    nth = F.row_number().over(W.partitionBy("node").orderBy(F.desc("sims"), "others"))
    return both.withColumn("_r", nth).where(F.col("_r") <= 2 * most).groupBy("node").agg(
        F.slice(F.collect_set("others"), 1, 2 * most).alias("adjacent"))


def _local_joins(graph: DataFrame, nodes: DataFrame, k: int, best_of: int) -> DataFrame:
    """Graph rows from comparing, at each node, its neighbours (both ways) with each other: neighbours of
    neighbours. Each of them is told the ``best_of`` nearest of the others.

    A node sends itself to few others, but very many may send themselves to one hub. These are dealt by a hash to groups
    of about ``WIDTH``, each compared within itself, so that none is left out and no group grows with the table.
    """
    around = written(_both_ways(graph, k), "graph-around")
    reach = around.select("node", F.explode(F.array_append("adjacent", F.col("node"))).alias("at"))
    hubs = written(reach.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / WIDTH).cast("int").alias("parts")).where("parts > 1"), "graph-hubs")
    dealt = reach.join(broadcast_if(hubs, 16 * hubs.count()), "at", "left").select("node", F.xxhash64(
        "at", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).alias("at"))
    sent = dealt.join(nodes.select("node", "half"), "node").select("at", "node", "half")

    def join(batches):
        for t in whole_groups(batches):
            at, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            x = _halves(t.column(2))
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.r_[first, len(at)])
            lo = 0
            while lo < len(first):
                most = 128
                while most > 1 and most * int(size[lo:lo + most].max()) ** 2 > PAIRS:
                    most //= 2
                f, n = first[lo:lo + most], size[lo:lo + most]
                lo += most
                width = int(n.max())
                if width < 2:
                    continue
                slot = f[:, None] + np.arange(width)
                real = np.arange(width) < n[:, None]
                slot = np.where(real, slot, f[:, None])
                v = x[slot]
                s = np.matmul(v, v.transpose(0, 2, 1))
                s[~np.broadcast_to(real[:, None, :], s.shape)] = -np.inf
                s[:, np.arange(width), np.arange(width)] = -np.inf
                m = min(best_of, width - 1)
                best = np.argpartition(-s, m - 1, axis=2)[:, :, :m]
                sim = np.take_along_axis(s, best, axis=2)
                ids = node[slot]
                other = np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), best, axis=2)
                ok = np.isfinite(sim) & real[:, :, None]
                mine = np.broadcast_to(ids[:, :, None], sim.shape)
                yield _rows(*_top(mine[ok], other[ok], sim[ok], 2 * k))

    return sent.repartition("at").sortWithinPartitions("at").mapInArrow(join, GRAPH_DDL)


def _changed(new: DataFrame, old: DataFrame) -> float:
    """Share of the entries of ``new`` that ``old`` does not have."""
    both = new.join(old.select("node", F.col("others").alias("_had")), "node", "left")
    fresh = F.size(F.array_except("others", F.coalesce("_had", F.array().cast("array<bigint>"))))
    return both.agg(F.sum(fresh) / F.sum(F.size("others"))).first()[0] or 0.0


def build(nodes: DataFrame, k: int = 20, trees: int = 16, delta: float = 0.001, seed: int = 9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(graph, pivot ids, pivot vectors). The graph has a row per distinct vector that has another to compare with.

    NN-descent: the start gives every vector some near ones; each round compares, at every node, its neighbours with each
    other and keeps each vector's ``k`` best, until a round changes less than a share ``delta`` of all entries. Entries only
    give way to nearer ones, so this ends. ``SAMPLE`` vectors (smallest hashes) fit the start and give the pivots.
    """
    taken = nodes.select("node", "half").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    count = nodes.count()
    sample = np.frombuffer(b"".join(map(bytes, taken["half"])), np.float16).reshape(max(1, len(taken)), -1).astype(np.float32)
    pivots = taken["node"].to_numpy()[:PIVOTS]
    if count < 2:
        return nodes.sparkSession.createDataFrame([], GRAPH_DDL), pivots, sample[:len(pivots)]
    graph = written(_merged(_start(nodes, sample, count, trees, k, seed), k), "graph")
    while True:
        before = graph
        graph = written(_merged(before.unionByName(_local_joins(before, nodes, k, (k + 1) // 2)), k), "graph")
        if _changed(graph, before) < delta:
            break
    return graph, pivots, sample[:len(pivots)]


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, pivots: tuple[np.ndarray, np.ndarray], k: int = 20,
           beam: int = 144, step: int = 36) -> DataFrame:
    """(query, node): for each query (query, half, start) the nodes its greedy walk found nearest.

    A query starts at the pivots nearest to it, and at the node ``start`` where it has one. In each round it looks at the
    neighbours of its ``step`` nearest nodes not looked at before, and keeps the ``beam`` nearest; it ends when all it
    keeps have been looked at. All queries move together, one join with the graph per round.
    """
    ids, vectors = pivots
    state_ddl = "query long, half binary, found array<long>, sims array<float>, seen array<long>"
    around = _both_ways(graph, k)
    links = around.select("node", F.explode("adjacent").alias("other")).join(
        nodes.select(F.col("node").alias("other"), "half"), "other").groupBy("node").agg(
        F.collect_list(F.struct("other", "half")).alias("near"))
    links = written(links.select("node", F.col("near.other").alias("near"), F.col("near.half").alias("halves")), "graph-links")

    def begin(batches):
        for b in slices(batches):
            x = _halves(b.column(1))
            s = x @ vectors.T
            m = min(4, s.shape[1])
            best = np.argsort(-s, axis=1, kind="stable")[:, :m]
            found, sims = ids[best].tolist(), np.take_along_axis(s, best, axis=1).tolist()
            for row, (f, g, start) in enumerate(zip(found, sims, b.column(2).to_pylist())):
                if start is not None and start not in f:
                    f.insert(0, start)
                    g.insert(0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())),
                 pa.array([[]] * len(x), pa.list_(pa.int64()))], names=["query", "half", "found", "sims", "seen"])

    def looked(batches):
        for b in slices(batches):
            sims = (_halves(b.column(1)) * _halves(b.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sims)], names=["query", "near", "near_sims"])

    state = written(queries.select("query", "half", "start").mapInArrow(begin, state_ddl), "search")
    while True:
        ranked = F.slice(F.array_sort(F.filter(F.transform(F.arrays_zip("found", "sims"), lambda e: F.struct(
            (-e["sims"]).alias("d"), e["found"].alias("n"))), lambda e: ~F.array_contains("seen", e["n"]))), 1, step)
        next_ = state.select("query", "half", F.transform(ranked, lambda e: e["n"]).alias("go")).where(F.size("go") > 0)
        if next_.isEmpty():
            break
        asks = next_.select("query", "half", F.explode("go").alias("node"))
        each = F.explode(F.arrays_zip("near", "halves")).alias("e")
        got = asks.join(links, "node").select("query", "half", each).select("query", "half", "e.near", "e.halves").mapInArrow(
            looked, "query long, near long, near_sims float")
        got = got.groupBy("query").agg(F.collect_list(F.struct("near", "near_sims")).alias("new"))
        moved = state.join(next_.select("query", "go"), "query", "left").join(got, "query", "left")
        pairs = F.concat(F.transform(F.arrays_zip("found", "sims"), lambda e: F.struct((-e["sims"]).alias("d"), e["found"].alias("n"))),
                         F.transform(F.coalesce("new", F.array().cast("array<struct<near:bigint,near_sims:float>>")),
                                     lambda e: F.struct((-e["near_sims"]).alias("d"), e["near"].alias("n"))))
        known = F.array_sort(F.array_distinct(pairs))
        moved = moved.withColumn("_k", known)
        once = F.filter("_k", lambda e, i: (i == 0) | ~F.array_contains(
            F.transform(F.slice("_k", 1, F.greatest(i, F.lit(1))), lambda p: p["n"]), e["n"]))
        state = written(moved.withColumn("_k", F.slice(once, 1, beam)).select(
            "query", "half", F.transform("_k", lambda e: e["n"]).alias("found"),
            F.transform("_k", lambda e: (-e["d"]).cast("float")).alias("sims"),
            F.array_union("seen", F.coalesce("go", F.array().cast("array<bigint>"))).alias("seen")), "search")
    return state.select("query", F.explode("found").alias("node"))


def nearest(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row by cosine: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column ``id``. Candidates are all rows but those of the query's own id. Equal scores
    rank by smaller vec_id. Scores are computed in double precision on the original vectors of what the walk found.
    Copies of a vector share a node, so that a vector held by very many rows costs no more than others; a result needs
    no more than its k + 1 smallest ids. See ``usable`` for what takes no part. A table without two usable vectors gives
    no rows.
    """
    wide = dict(vectors.dtypes)[vector] == "array<double>"
    rows = written(usable(vectors, vec_id, vector), "vectors")
    nodes = written(distinct_vectors(rows, k + 1, wide), "nodes")
    graph, pivots, pivot_vectors = build(nodes)
    asked = rows.where(is_query).select(F.col("id").alias("query"), "vec").join(
        nodes.select("vec", "half", F.col("node").alias("start")), "vec")
    asked = written(asked, "queries")
    found = search(asked.dropDuplicates(["query"]), graph, nodes, (pivots, pivot_vectors))
    pairs = found.join(nodes.select("node", F.col("vec").alias("near"), "ids"), "node").join(asked.select("query", "vec"), "query")

    def exact(batches):
        for b in slices(batches, rows=2048):
            x, y = _vectors(b.column(1), wide), _vectors(b.column(2), wide)
            score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(score)], names=["query_id", "ids", "score"])

    scored = pairs.select("query", "vec", "near", "ids").mapInArrow(exact, "query_id long, ids array<long>, score double")
    scored = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
