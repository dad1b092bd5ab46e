"""Distances over graphs with long chains, against a plain search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from hoptrail.operators import graph as G


def _plain(pairs, sources):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    dist, queue = {s: 0 for s in sources}, deque(sources)
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


def _distances(spark, pairs, sources):
    adj = spark.createDataFrame(pairs, "a bigint, b bigint")
    return {r.router: r.dist for r in G.distances(adj, spark.createDataFrame([(s,) for s in sources], "router bigint")).collect()}


def test_chain_of_ten_thousand(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(10_000)]
    cuts, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    assert _distances(spark, pairs, [3000]) == {i: abs(i - 3000) for i in range(10_001)}
    assert len(cuts) < 50  # checkpoints of all rounds: a plain search alone would take 7000


@pytest.mark.parametrize("shallow", [0, 3, 8])
def test_graphs_against_plain_search(spark, monkeypatch, shallow):
    monkeypatch.setattr(G, "SHALLOW", shallow)
    rnd = random.Random(shallow)
    for seed in range(2):
        pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(28)]
        pairs += [(a, a) for a in range(3)] + pairs[:4] + [(b, a) for a, b in pairs[:4]]
        n = 100
        for a, b in [(rnd.randrange(30), rnd.randrange(30)) for _ in range(6)]:  # chains, some from a router to itself
            way = [a, *range(n, n + rnd.randrange(1, 20)), b]
            n += 20
            pairs += list(zip(way, way[1:]))
        pairs += [(500 + i, 500 + (i + 1) % 7) for i in range(7)]                # a ring that no source reaches
        pairs += [(600 + i, 600 + (i + 1) % 8) for i in range(8)]                # a ring with one source on it
        sources = [rnd.randrange(30), 103, 603, 999]
        assert _distances(spark, pairs, sources) == _plain(pairs, sources)


def test_empty_graph_and_no_sources(spark):
    adj = spark.createDataFrame([], "a bigint, b bigint")
    none = spark.createDataFrame([], "router bigint")
    assert G.distances(adj, none).collect() == []
    assert G.distances(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"), none).collect() == []


def test_alias_difference_groups_each_side_once(spark):
    """Null addresses, repeated and reversed pairs; two joins tell which addresses both sides know."""
    from hoptrail.operators import diff as D

    left = [(1, 2), (2, 1), (1, 2), (3, 4), (5, 6), (6, 7), (1, None)]
    right = [(2, 1), (4, 5), (3, 5), (6, 9), (8, 1), (7, 1)]
    l, r = (spark.createDataFrame(x, "ip1 bigint, ip2 bigint") for x in (left, right))
    d = D.diff_aliases(l, r)
    assert sorted(tuple(x) for x in d.collect()) == [(1, 1, "left"), (1, 2, "both"), (1, 7, "right"), (3, 4, "left"), (3, 5, "right"), (4, 5, "right"), (5, 6, "left"), (6, 7, "left")]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def reused(df):
    """Shuffles that a plan reads again, without adaptive execution."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("ReusedExchange")
    finally:
        spark.conf.set(key, old)


def test_neighbours_of_a_trace_share_one_shuffle(spark):
    from hoptrail.operators import hops as H
    from hoptrail.operators import infer as I

    probes = spark.range(1000).selectExpr("id % 7 AS src", "id % 5 AS dst", "cast(if(id % 11 = 0, null, id % 9) AS int) AS ttl", "id % 13 AS resp", "array(id % 3) AS rr")
    assert reused(H.tr_hop_pairs(probes)) == 1 and reused(I.path_pairs(probes)) == 1
    rows = [(1, 9, 1, 0), (1, 9, 2, 5), (1, 9, 3, 6), (1, 9, 3, 7), (1, 9, 5, 8), (1, 9, None, 4), (2, 9, 4, 3), (2, 9, 5, None), (None, 9, 1, 2), (3, 0, 1, 2), (4, 9, 1, 0)]
    hops = spark.createDataFrame(rows, "trace int, src bigint, idx int, ip bigint")
    assert {(x.ip1, x.ip2) for x in H.hop_chain_links(hops).collect()} == {(5, 6), (5, 7), (3, 9)}
    # as a query does: the hops come from a shuffle
    grouped = hops.repartition(4, "ip").groupBy("trace", "src", "idx").agg(F.min("ip").alias("ip"))
    assert reused(H.hop_chain_links(grouped)) >= 2
