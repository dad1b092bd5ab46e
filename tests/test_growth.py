"""What keeps time, memory and shuffles in proportion to the input."""

import random
import re

from pyspark.sql import functions as F


def test_computed_log_lines_are_made_and_split_once(spark):
    from hoptrail.sources.text import read_trace_log

    odd = "-  RECV\tTTL 3  it=1 from   1.2.3.4 (201)\tROUTER\t rtt=0.5 s t=1.000002 \x0bRR, hop 1 1.1.1.1 , Macro "
    lns = spark.range(4).select(
        F.when(F.col("id") == 3, "other").otherwise("/logs/d-1.2.3.4:5-6.7.8.9:80-7").alias("file"), F.col("id").alias("pos"),
        F.when(F.col("id") == 0, odd).when(F.col("id") == 1, "# TTL").otherwise(F.concat(F.lit("- RECV TTL "), F.col("id").cast("string"))).alias("value"))
    got = {r.line_no: r for r in read_trace_log(lns).collect()}
    assert set(got) == {0, 2} and got[2].ttl == 2
    w = re.split(r"\s+", odd.strip(" "))
    assert (got[0].status, got[0].ttl, got[0].resp, got[0].rttl, got[0]["class"], got[0].rr) == (w[1], int(w[3]), w[6], 201, w[8], ["1.1.1.1"])
    plan = read_trace_log(lns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(- RECV") == 1


def test_partitions_follow_the_data_unless_the_caller_says(spark):
    from hoptrail.session import configure

    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    configure(other)
    plan = other.range(100).groupBy((F.col("id") % 7).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
    assert "512)" in plan[plan.index("hashpartitioning"):].split("\n")[0].replace(", ENSURE", ")")
    set_by_caller = spark.newSession()
    set_by_caller.conf.set(first, "20")
    set_by_caller.conf.set(size, "3m")
    configure(set_by_caller)
    assert set_by_caller.conf.get(first) == "20" and set_by_caller.conf.get(size) == "3m"


def _probes(spark, n, traces, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(traces), 9, rnd.randrange(1, 7), rnd.randrange(1, 6), [rnd.randrange(1, 4) for _ in range(rnd.randrange(4))]) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "src bigint, dst bigint, ttl int, resp bigint, rr array<bigint>")


def _without_aqe(df):
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, "true")


def test_gaps_against_plain_search_and_probes_made_once(spark, monkeypatch):
    from hoptrail.operators import repair as R

    rows, rr = _probes(spark, 60, 6, 1)
    tr = spark.createDataFrame([(s, 9, t, r) for s, _, t, r, _ in rows[::3]], "src bigint, dst bigint, ttl int, resp bigint")
    fixed = spark.createDataFrame([(5,)], "ip bigint")
    paired = {(r.src, r.dst, r.ttl, r.resp1, tuple(r.rr1)) for r in R.rr_probe_pairs(rr, tr).collect()}
    probes = {(*r[:4], tuple(r[4])) for r in rows}

    def fits(o, b):
        n = min(len(o[4]), len(b[4]))
        m = n - 1 if o[4] and o[4][-1] == o[3] else n
        return n == 0 or o[4][:m] == b[4][:m]

    want = {}
    for o in probes:
        if len(set(o[4])) == len(o[4]) and o not in paired:
            later = [b[2:] for b in probes if b[:2] == o[:2] and b[2] >= o[2] + 2 and b[3] != 5 and fits(o, b)]
            if later:
                want[o] = min(later)
    made, whole = [], R.known_probes
    monkeypatch.setattr(R, "known_probes", lambda *a: made.append(1) or whole(*a))
    got = {(g.src, g.dst, g.ttl, g.resp1, tuple(g.rr)): (g.ttl2, g.resp2, g.n) for g in R.gap_links(rr, tr, fixed).collect()}
    assert got == {o: (t, r, len(l)) for o, (t, r, l) in want.items()} and got
    assert len(made) == 1
    assert "ReusedExchange" in _without_aqe(R.consecutive_probes(rr, tr))


def test_settled_pairs_meet_plainly_where_no_ttl_is_crowded(spark, monkeypatch):
    from hoptrail.operators import infer as I

    _, rr = _probes(spark, 300, 3, 2)
    every = sorted(tuple(map(str, p)) for p in I.path_pairs(rr).where("same OR resp1 = resp2").collect())
    for crowd in (0, 10, 64):
        monkeypatch.setattr(I, "CROWD", crowd)
        assert sorted(tuple(map(str, p)) for p in I.settled_pairs(rr).collect()) == every
