"""Live operators over several micro-batches, with rows out of order, against their batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hoptrail.operators import delay as D
from hoptrail.streaming import live as V

DDL = "conn bigint, probe bigint, kind string, id bigint, ts timestamp"


def at(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


def test_answers_after_a_timeout(spark, tmp_path):
    """Probe 1 times out and is answered later, twice; probe 2 is answered in time, twice; answer 9 has no probe."""
    batches = [
        [(1, 1, "probe", None, 0), (1, 2, "probe", None, 1), (1, 2, "response", 1, 2)],
        [(1, 3, "probe", None, 200)],
        [(1, 1, "response", 7, 210), (1, 9, "response", 3, 211)],
        [(1, 1, "response", 8, 230), (1, 2, "response", 4, 231)],
        [(1, 4, "probe", None, 900)],
        [(1, 5, "probe", None, 1800)],
        [(1, 5, "response", 6, 1801)],
        [(-1, -1, "probe", None, 3500), (-1, -1, "response", 0, 3500)],  # moves the watermark beyond all others
    ]
    path = str(tmp_path / "in")
    rows = []
    for b in batches:
        b = [(*r[:4], at(r[4])) for r in b]
        rows += b
        spark.createDataFrame(b, DDL.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)
    out = V.run_to_table(V.stream_classify_responses(events, 60_000_000, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = out.where("conn >= 0")
    got = sorted((r.probe, r.resp_id, r.status) for r in out.collect() if r.status != "TIMEOUT")
    rows = [r for r in rows if r[0] >= 0]
    all_ = spark.createDataFrame(rows, DDL.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    twin = V.classify_responses(all_.where("kind = 'probe'"), all_.where("kind = 'response'").withColumnRenamed("id", "resp_id"), 60_000_000)
    assert got == sorted((r.probe, r.resp_id, r.status) for r in twin.collect())
    assert got == [(1, 7, "OLD"), (1, 8, "DUPLICATE"), (2, 1, "RECV"), (2, 4, "DUPLICATE"), (5, 6, "RECV"), (9, 3, "UNSENT")]
    assert sorted(r.probe for r in out.collect() if r.status == "TIMEOUT") == [1, 3, 4]


START = datetime.datetime(2024, 1, 1)


def in_files(spark, path, rows, ddl, disorder, size, seed=1):
    """Rows (last column: seconds) as one file per micro-batch; they arrive up to ``disorder`` seconds late, and a row of key
    -1 closes the stream."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1] + rng.uniform(0, disorder))
    end = (*[-1] * (len(rows[0]) - 1), max(r[-1] for r in rows) + 10 * 86_400)
    for at in range(0, len(rows) + size, size):
        part = rows[at:at + size] if at < len(rows) else [end]
        part = [(*r[:-1], START + datetime.timedelta(seconds=r[-1])) for r in part]
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def table(spark, rows, ddl):
    return spark.createDataFrame([(*r[:-1], START + datetime.timedelta(seconds=r[-1])) for r in rows], ddl)


@pytest.mark.parametrize("start", ["zero", "first"])
def test_smoothing_does_not_depend_on_the_order_of_files(spark, tmp_path, start):
    rng = random.Random(start)
    ddl = "conn bigint, seq bigint, rtt bigint, ts timestamp"
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randint(1, 90_000), rng.randint(0, 300)) for k in range(400)]
    stream = in_files(spark, f"{tmp_path}/in", rows, ddl, 50, 80)
    out = V.run_to_table(V.stream_rtt_ewma(stream, start, "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    last = out.where("conn >= 0").groupBy("conn").agg(F.max_by("srtt", "n").alias("srtt"), F.max_by("mdev", "n").alias("mdev"), F.max("n").alias("n"))
    batch = D.rtt_ewma(table(spark, rows, ddl), ["ts", "seq"], start)
    assert sorted(map(tuple, last.collect())) == sorted((r.conn, r.srtt, r.mdev, r.n) for r in batch.collect())
    assert out.where("conn = 1").count() > 1  # estimates come out while the stream runs


def test_an_idle_connection_starts_anew(spark, tmp_path):
    ddl = "conn bigint, seq bigint, rtt bigint, ts timestamp"
    rows = [(1, k, 8000, k) for k in range(5)] + [(1, 9, 800, 5000), (2, 1, 80, 5000)]
    for name, size in (("apart", 2), ("together", 50)):
        stream = in_files(spark, f"{tmp_path}/{name}", rows, ddl, 0, size)
        out = V.run_to_table(V.stream_rtt_ewma(stream, "first", "10 seconds", idle_ms=600_000), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-state")
        got = {(r.conn, r.srtt, r.n) for r in out.where("conn >= 0").collect()}
        assert (1, 800, 1) in got and (1, 8000, 5) in got and (2, 80, 1) in got, (name, got)


def test_queueing_does_not_depend_on_the_order_of_files(spark, tmp_path):
    rng = random.Random(4)
    ddl = "conn bigint, probe bigint, hop int, delay bigint, ts timestamp"
    rows = [(rng.choice([1, 1, 2]), k, k % 2, rng.randint(1, 500), rng.randint(0, 200)) for k in range(300)]
    stream = in_files(spark, f"{tmp_path}/in", rows, ddl, 40, 60).withColumnRenamed("ts", "t")
    out = V.run_to_table(V.stream_hop_queueing(stream, "45 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    want, least = [], {}
    for conn, probe, hop, delay, _ in sorted(rows, key=lambda r: (r[-1], r[1])):
        if (conn, hop) in least:
            want.append((conn, hop, probe, delay, delay - least[conn, hop]))
        least[conn, hop] = min(delay, least.get((conn, hop), delay))
    assert sorted(tuple(r) for r in out.select("conn", "hop", "probe", "delay", "queueing").where("conn >= 0").collect()) == sorted(want)


def test_echoes_meet_their_sends(spark, tmp_path):
    rng = random.Random(5)
    ddl = "conn bigint, value bigint, ts timestamp"
    sent = [(c, v, 3 * v + c) for c in (1, 2) for v in range(1, 60)]
    echoes = [(c, v, t + rng.choice([0, 1, 8, 20])) for c, v, t in sent if v % 7] + [(1, 500, 20), (2, 3, 5)]
    streams = [in_files(spark, f"{tmp_path}/{n}", rows, ddl, 20, 30, 6) for n, rows in (("sent", sent), ("echoes", echoes))]
    live = V.stream_match_echo(*streams, within_us=100_000_000, watermark="30 seconds")
    out = V.run_to_table(live, f"{tmp_path}/out", f"{tmp_path}/state").where("conn >= 0")
    twin = V.match_echo(table(spark, sent, ddl), table(spark, echoes, ddl)).select("conn", "value", "rtt")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, twin.collect())) and len(got) > 50


def test_answers_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    ddl = "conn bigint, probe bigint, kind string, id bigint, ts timestamp"
    rows = []
    for k in range(120):
        if k % 5:
            rows.append((k % 3, k, "probe", None, 4 * k))
        rows += [(k % 3, k, "response", 10 * k + j, 4 * k + rng.choice([1, 30, 59, 61, 200])) for j in range(rng.randint(0, 3))]
    rows.sort(key=lambda r: r[-1] + rng.uniform(0, 30))
    for at in range(0, len(rows), 70):
        table(spark, rows[at:at + 70], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table(spark, [(-1, -1, "probe", None, 90_000), (-1, -1, "response", 1, 90_000)], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = V.run_to_table(V.stream_classify_responses(stream, 60_000_000, "40 seconds"), f"{tmp_path}/out", f"{tmp_path}/state").where("conn >= 0")
    all_ = table(spark, rows, ddl)
    probes, responses = all_.where("kind = 'probe'"), all_.where("kind = 'response'").withColumnRenamed("id", "resp_id")
    want = [tuple(r) for r in V.classify_responses(probes, responses, 60_000_000).select("conn", "probe", "resp_id", "status").collect()]
    want += [(r.conn, r.probe, None, "TIMEOUT") for r in V.probe_timeouts(probes, responses, 60_000_000).collect()]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_peers_expire(spark, tmp_path, many_runs):
    rng = random.Random(8)
    ddl = "ip bigint, port bigint, ts timestamp"
    rows = [(rng.randint(1, 6), k, rng.randint(0, 40_000)) for k in range(150)]
    out = V.run_to_table(V.stream_peer_expiry(in_files(spark, f"{tmp_path}/in", rows, ddl, 50, 40), "60 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    want = sorted(map(tuple, V.peer_stays(table(spark, rows, ddl), 3_600_000_000).collect()))
    assert sorted(map(tuple, out.where("ip >= 0").collect())) == want and len(want) > 6


def test_many_keys_share_few_state_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARDS", 8)
    ddl = "conn bigint, seq bigint, rtt bigint, ts timestamp"
    rows = [(None if k % 300 == 7 else k % 300, k, 1000 + k, k) for k in range(900)]
    stream = in_files(spark, f"{tmp_path}/in", rows, ddl, 20, 300)
    out = V.run_to_table(V.stream_rtt_ewma(stream, "zero", "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    last = {r.conn: (r.srtt, r.n) for r in out.groupBy("conn").agg(F.max_by("srtt", "n").alias("srtt"), F.max("n").alias("n")).collect()}
    batch = D.rtt_ewma(table(spark, [r for r in rows if r[0] is not None], ddl), ["ts", "seq"], "zero").collect()
    assert {k: v for k, v in last.items() if k is not None and k >= 0} == {r.conn: (r.srtt, r.n) for r in batch} and len(batch) == 299
    assert last[None] == (438, 3)  # samples without a connection are a key of their own, as before
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() <= 8
