"""Series, ranks and smoothing across run borders, with one series that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from hoptrail.operators import delay as D
from hoptrail.operators import ranking as K
from hoptrail.operators import series as S
from hoptrail.operators import velocity as V


def _series(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < 0.8 else rnd.randint(1, 4), i, rnd.randint(0, 1000), None if rnd.random() < 0.9 else i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, v bigint, m bigint").repartition(5)


def test_windows_cross_runs(spark, many_runs):
    rows, df = _series(spark)
    runs = S.in_runs(df, ["k"], ["t"])
    assert runs.where("k = 0").select("_run").distinct().count() > 1
    d = S.lag_over(runs, ["k"], ["t"], {"v": "pv"})
    d = S.running_sum(d, ["k"], ["t"], "v", "cum")
    d = S.running_min(d, ["k"], ["t"], "v", "low", inclusive=False)
    d = S.last_known(d, ["k"], ["t"], "m", "last")
    d = S.next_known(d, ["k"], ["t"], "m", "next")
    odd = F.when(F.col("v") % 2 == 1, F.col("t"))
    d = S.nearest_known(d.withColumn("odd", odd), ["k"], ["t"], {"m": ("last2", "next2"), "odd": ("odd_b", "odd_a")})
    rs = d.collect()
    assert all((r["last"], r["next"]) == (r.last2, r.next2) for r in rs)
    for k in range(5):
        own = sorted((r.t, r.odd, r.odd_b, r.odd_a) for r in rs if r.k == k)
        odds = [o for _, o, _, _ in own if o is not None]
        assert [(x[2], x[3]) for x in own] == [
            (max((o for o in odds if o <= x[0]), default=None), min((o for o in odds if o >= x[0]), default=None)) for x in own]
    got = {(r.k, r.t): (r.pv, r.cum, r.low, r["last"], r["next"]) for r in rs}
    for k in range(5):
        own = sorted(r for r in rows if r[0] == k)
        cum, low, last = 0, None, None
        for i, (_, t, v, m) in enumerate(own):
            cum += v
            last = m if m is not None else last
            nxt = next((x[3] for x in own[i:] if x[3] is not None), None)
            assert got[(k, t)] == (own[i - 1][2] if i else None, cum, low, last, nxt)
            low = v if low is None else min(low, v)


@pytest.mark.parametrize("start", ["zero", "first"])
@pytest.mark.parametrize("low", [0, 1])
def test_ewma_of_a_long_connection(spark, many_runs, start, low):
    rnd = random.Random(7)
    rows = [(0 if rnd.random() < 0.9 else 1, i, rnd.randint(low, 90000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "conn bigint, seq bigint, rtt bigint").repartition(4)
    want, trace = {}, {}
    for conn, seq, x in rows:
        r, m, n = want.get(conn, (0, 0, 0))
        r, m = D.smooth(r, m, x, start)
        want[conn] = (r, m, n + 1)
        trace[(conn, seq)] = (r, m)
    got = {r.conn: (r.srtt, r.mdev, r.n) for r in D.rtt_ewma(df, ["seq"], start).collect()}
    assert got == want
    assert {(r.conn, r.seq): (r.srtt, r.mdev) for r in D.rtt_trace(df, ["seq"], start).collect()} == trace


@pytest.mark.parametrize("start", ["zero", "first"])
def test_ewma_where_starts_stay_apart(spark, many_runs, monkeypatch, start):
    """Constant samples leave different starts apart for ever, zeros bring estimates to a restart: short segments make
    many possible starts, which are settled along the connection."""
    monkeypatch.setattr(D, "SEGMENT", 16)
    rnd = random.Random(5)
    kinds = [lambda i: 1000, lambda i: rnd.choice([0, 0, 0, 5]), lambda i: 1000 if i % 90 < 45 else 995, lambda i: 0 if i % 70 < 62 else 800]
    rows = [(k, i, one(i)) for k, one in enumerate(kinds) for i in range(300 if k else 600)] + [(7, 0, 9), (8, 0, 0)]
    df = spark.createDataFrame(rows, "conn bigint, seq bigint, rtt bigint").repartition(4)
    now, trace = {}, {}
    for conn, seq, x in rows:
        now[conn] = trace[(conn, seq)] = D.smooth(*now.get(conn, (0, 0)), x, start)
    assert {(x.conn, x.seq): (x.srtt, x.mdev) for x in D.rtt_trace(df, ["seq"], start).collect()} == trace


def test_ewma_of_nothing(spark):
    df = spark.createDataFrame([], "conn bigint, seq bigint, rtt bigint")
    assert D.rtt_ewma(df, ["seq"]).collect() == [] and D.congestion_delay(df, ["seq"]).collect() == []


def test_rank_and_cdf(spark, many_runs):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 1.0, 1.0, 2.0, 5.0, 9.0, 12.5]) for _ in range(999)]
    df = spark.createDataFrame(list(enumerate(vals)), "id bigint, v double").repartition(6)
    want = {i: r for r, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(vals)))}
    assert {x.id: x["rank"] for x in K.global_rank(df, ["v", "id"]).collect()} == want
    pts = sorted((x.p, x.value) for x in K.cdf(df, "v").collect())
    assert pts[-1][0] == 1.0 and len(pts) == 1000
    assert [v for _, v in pts[1:]] == sorted(vals)


def test_known_line_fit(spark, many_runs):
    pts = [("a", -1.0, 2), ("a", 0.0, 3), ("a", 2.0, 3), ("a", 4.0, 4)]
    f = V.ipid_line_fit(spark.createDataFrame(pts, "ip string, t double, id bigint")).first()
    assert abs(f.slope - 0.3389830508) < 1e-8 and abs(f["offset"] - 2.5762711864) < 1e-8


def test_wrapped_counter(spark, many_runs):
    pts = [("a", float(i), (i + 65530) % 65536) for i in range(11)]
    df = spark.createDataFrame(pts, "ip string, t double, id bigint")
    u = V.unwrapped(df)
    assert [r.ts for r in u.orderBy("t").collect()] == list(range(65530, 65541))
    f = V.ipid_line_fit(df).first()
    assert round((f.slope * 12 + f["offset"]) % 65536) == 6


def test_velocity_distance_to_itself_is_zero(spark, many_runs):
    pts = [(ip, float(i), (40 * i) % 65536) for ip in (1, 2) for i in range(50)]
    df = spark.createDataFrame(pts, "ip bigint, t double, id bigint")
    pairs = spark.createDataFrame([(1, 2)], "ip1 bigint, ip2 bigint")
    d = V.velocity_distance(pairs, V.unwrapped(df), V.ipid_line_fit(df)).first()
    assert d.d == 0 and d.n == 100


def test_combinations_and_batches(spark, many_runs):
    items = spark.createDataFrame([(c,) for c in "abcde"], "x string")
    got = sorted(tuple(r) for r in K.n_combinations(items, "x", 3).collect())
    import itertools
    assert got == list(itertools.combinations("abcde", 3))
    b = K.batch_rows(spark.range(10), ["id"], 4).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()
    assert [r.n for r in b] == [4, 4, 2]
