"""Readers and writers over real files, and streams that follow them."""

import os
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hoptrail.functions import ip as ipf
from hoptrail.operators import diff as D
from hoptrail.sinks import writers as W
from hoptrail.sources import binary as B
from hoptrail.sources import text as X
from hoptrail.streaming import live as V

LOG = """10.0.0.1:40001-192.0.2.9:80 :: new connection: id = 9 time=1200000000.100000
10.0.0.1:40001-192.0.2.9:80 -\tSending train=0 type=DATA safettl=11 nProbes=11 payload=-1 RR=1 rto=1500000(1) time=1.5
- RECV TTL 1 it=0 from    198.51.100.1 (255)\tROUTER\t rtt=0.001500 s t=1200000000.250000 RR,  Macro
- RECV TTL 2 it=0 from    198.51.100.7 (254)\tROUTER\t rtt=0.002750 s t=1200000000.375000 RR, hop 1 203.0.113.5 , hop 2 203.0.113.9 ,  Macro Non-time exceeded message: ICMP type=12 code=0 : ABORT!
- RECV TTL 2 it?=1 from   192.0.2.9 (60)\tENDHOST\t NO MATCH t=1200000001.000001 TraceRoute?
- RECV TTL 3 it=1 from    198.51.100.8 (??) ?? rtt=0.5 s t=?? MPLS,l=17,CoS=2,ttl=1,S=1, Macro
- OLD TTL 3 it=3 from    198.51.100.8 (250)\tROUTER\t rtt=0.5 s t=1200000002.5 Pollo
"""


@pytest.fixture
def log_dir(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "data-10.0.0.1,40001-192.0.2.9,80-612").write_text(LOG)
    (d / "notes.txt").write_text(LOG)
    return str(d)


def _probe_rows(df):
    return {(r.ttl, r.it, r.status): r for r in df.collect()}


def test_trace_log_files(spark, log_dir):
    got = _probe_rows(X.read_trace_log(X.lines(spark, log_dir), "set1"))
    assert set(got) == {(1, 0, "RECV"), (2, 0, "RECV"), (2, 1, "RECV"), (3, 1, "RECV"), (3, 3, "OLD")}
    a, b, c, d = got[(1, 0, "RECV")], got[(2, 0, "RECV")], got[(2, 1, "RECV")], got[(3, 1, "RECV")]
    assert (a.src, a.dst, a.sport, a.dport, a.conn_id, a.dataset, a.rr, a.rttl, a.ptype) == ("10.0.0.1", "192.0.2.9", 40001, 80, 612, "set1", [], 255, "Macro")
    assert b.rr == ["203.0.113.5", "203.0.113.9"] and b.ptype == "Macro" and b.t.microsecond == 375000
    assert c.rtt is None and c.rr is None and c["class"] == "ENDHOST" and c.ptype == "TraceRoute"
    assert d.t is None and d.rttl is None and tuple(d.mpls) == (17, 2, 1, 1) and d.rtt == 0.5
    sends = X.read_send_lines(X.lines(spark, log_dir)).where("file LIKE '%612'").collect()
    assert [(r.train, r.distance) for r in sends] == [(0, 10)]


def test_trace_log_stream_gives_the_same_rows(spark, log_dir, tmp_path):
    out = V.run_to_table(V.stream_trace_log(spark, log_dir, "set1"), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = X.read_trace_log(X.lines(spark, log_dir), "set1").drop("line_no")
    assert sorted(map(str, out.drop("line_no").collect())) == sorted(map(str, batch.collect()))


def test_graph_round_trip(spark, tmp_path):
    text = "Router R1_A nAlly=2 10.0.0.1 10.0.0.2\n\nSource S2 nAlly=1 10.0.0.9\nLink  S2:10.0.0.9 -- R1_A:10.0.0.1 : RR\nLink  S2:10.0.0.9 -- R1_A:10.0.0.2 : TR\n"
    f = tmp_path / "g.adj"
    f.write_text(text)
    routers, links = X.read_adjacency(X.lines(spark, str(f)))
    assert {(r.router, r.kind, r.ip, tuple(r.types)) for r in routers.collect()} == {
        ("R1_A", "Router", "10.0.0.1", ("A",)), ("R1_A", "Router", "10.0.0.2", ("A",)), ("S2", "Source", "10.0.0.9", ())}
    l = links.toDF("r1", "ip1", "r2", "ip2", "link_type")
    out = str(tmp_path / "out")
    W.write_adjacency(routers, l, out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    # the TR link is hidden by the RR link of the same routers
    assert lines == ["Link  S2:10.0.0.9 -- R1_A:10.0.0.1 : RR", "Router R1_A nAlly=2 10.0.0.2 10.0.0.1", "Source S2 nAlly=1 10.0.0.9"]
    f.write_text("Nonsense here\n")
    with pytest.raises(PySparkException):
        X.read_adjacency(X.lines(spark, str(f)))[0].collect()


def test_binary_hop_lists(spark, tmp_path):
    rec = lambda dest, hops: struct.pack(">I", dest) + struct.pack("<I", len(hops)) + b"".join(struct.pack(">I", a) + struct.pack("<fI", r, t) for a, r, t in hops)
    body = rec(1, [(7, 0.5, 3), (8, 1.25, 4)]) + rec(2, [])
    (tmp_path / "good").write_bytes(struct.pack("<4I", 1, 2, 2, len(body)) + body)
    (tmp_path / "bad").write_bytes(struct.pack("<4I", 1, 2, 1, 0) + rec(3, [(9, 1.0, 600)]))
    d = B.read_iplane_binary(spark, str(tmp_path)).collect()
    ok = sorted((r.rec, r.dest, r.n_hops, r.idx if r.idx is not None else -1, r.ip, r.rtt, r.ttl) for r in d if not r.corrupt)
    assert ok == [(0, 1, 2, 0, 7, 0.5, 3), (0, 1, 2, 1, 8, 1.25, 4), (1, 2, 0, -1, None, None, None)]
    assert [os.path.basename(r.file) for r in d if r.corrupt] == ["bad"]


def _hop_file(n_blocks, rnd):
    """Blocks of records, and the rows they hold."""
    data, rows, rec = b"", [], 0
    for _ in range(n_blocks):
        records = [[(rnd.randrange(2 ** 32), rnd.randrange(64) / 4, rnd.randrange(256)) for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(7))]
        data += struct.pack("<4I", 7, 9, len(records), 0)
        for hops in records:
            dest = rnd.randrange(2 ** 32)
            data += struct.pack(">I", dest) + struct.pack("<I", len(hops))
            data += b"".join(struct.pack(">I", a) + struct.pack("<fI", r, t) for a, r, t in hops)
            rows += [(rec, dest, len(hops), i, *h) for i, h in enumerate(hops)] or [(rec, dest, 0, -1, None, None, None)]
            rec += 1
    return data, rows


@pytest.mark.parametrize("window", [96, 1000, 4 << 20])
def test_walk_of_hop_lists_in_windows(window):
    """Every window size gives the same rows; a cut anywhere keeps the whole records before it."""
    rnd = random.Random(window)
    data, rows = _hop_file(40, rnd)
    value = lambda b: [tuple(-1 if k == "idx" and v is None else v for k, v in r.items() if k not in ("file", "corrupt"))
                       for r in b.to_pylist() if not r["corrupt"]]
    read = lambda d: [w for w in B._windows(lambda at, n: d[at:at + n], len(d), window)]
    order = lambda t: (t[0], t[3])
    found = read(data)
    assert not any(w.corrupt for w in found) and (len(found) > 1) == (window < len(data))
    assert sorted((r for w in found for r in value(B._columns("f", w))), key=order) == rows
    for cut in rnd.sample(range(1, len(data)), 60):
        part = read(data[:cut])
        got = sorted((r for w in part for r in value(B._columns("f", w))), key=order)
        assert got == rows[:len(got)] and len({r[0] for r in got}) == sum(len(w.heads) for w in part)
    assert read(b"") == [] and read(b"abc")[0].corrupt


def test_large_hop_file_is_read_by_several_tasks(spark, tmp_path):
    data, rows = _hop_file(600, random.Random(3))
    (tmp_path / "large").write_bytes(data)
    (tmp_path / "cut").write_bytes(data[:-2])
    d = B.read_iplane_binary(spark, str(tmp_path), 8192)
    assert d.where("file LIKE '%large'").select(F.spark_partition_id()).distinct().count() > 2
    get = lambda name: d.where(F.col("file").endswith(name) & ~F.col("corrupt"))
    seen = sorted(((r.rec, r.dest, r.n_hops, -1 if r.idx is None else r.idx, r.ip, r.rtt, r.ttl) for r in get("large").collect()), key=lambda t: (t[0], t[3]))
    assert seen == rows
    assert [os.path.basename(r.file) for r in d.where("corrupt").collect()] == ["cut"]
    names = B.read_iplane_destinations(spark, str(tmp_path)).where("file LIKE '%large'")
    assert names.count() == rows[-1][0] + 1


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_headings_hold_over_splits(spark, tmp_path, small_splits):
    """Files of many splits; some splits have no heading at all."""
    rnd, want = random.Random(4), set()
    for name in ("a", "b"):
        rows = ["0: 9.9.9.9 1.0 1"]                                    # no heading yet
        for k in range(12):
            dest, n = f"10.0.{k}.1", rnd.choice([0, 1, 3, 150])
            rows.append(f"destination: {dest} hops: {n}")
            for i in range(n):
                rows.append(f"{i}: 10.1.{k}.{i} {i / 4} {i}")
                want.add((name, dest, n, i, f"10.1.{k}.{i}"))
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    lns = X.lines(spark, str(tmp_path))
    d = X.read_iplane_text(lns)
    assert lns.select("file", "pos._b").distinct().count() > 10
    got = d.collect()
    assert {(os.path.basename(r.file), r.dest, r.n_hops, r.idx, r.ip) for r in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="straight from the scan"):
        X.read_iplane_text(lns.coalesce(1).sort(F.col("pos._i").desc())).collect()


def test_routes_and_interfaces_over_splits(spark, tmp_path, small_splits):
    head = "   Network          Next Hop            Metric LocPrf Weight Path"
    line = lambda net, path: "*> " + net.ljust(17) + "4.0.4.90".ljust(20) + "0".ljust(21) + path
    rows, routes = [head], []
    for k in range(40):
        for i in range(1 + k % 5 * 4):
            rows.append(line(f"10.{k}.0.0/16" if i == 0 else "", f"3356 {k * 100 + i} i"))
            routes.append(((10 << 24) + (k << 16), 16, str(k * 100 + i)))
    (tmp_path / "rv").write_text("\n".join(rows) + "\n")
    assert sorted(map(tuple, X.read_bgp_table(X.lines(spark, str(tmp_path / "rv"))).collect())) == sorted(routes)
    text = "".join(f"so-{k} is up, line protocol is up\n" + "  MTU 4470 bytes\n" * (k % 7 * 9) + f"<br>&nbsp; Internet address is 10.2.{k}.1/30\n" for k in range(30))
    (tmp_path / "Out=r1").write_text(text)
    got = X.read_show_interfaces(X.lines(spark, str(tmp_path / "Out=r1"))).collect()
    assert sorted((r.router, r.iface, r.ip, r.len) for r in got) == sorted(("r1", f"so-{k}", f"10.2.{k}.1", 30) for k in range(30))


def test_interfaces_xml(spark, tmp_path):
    one = lambda n, st, ip: f"<physical-interface><name>{n}</name><oper-status>{st}</oper-status><logical-interface><name>{n}.0</name><address-family><interface-address><ifa-destination>10.1.2/30</ifa-destination><ifa-local>{ip}</ifa-local></interface-address></address-family></logical-interface></physical-interface>"
    f = tmp_path / "x.xml"
    f.write_text('<all><router name="r1"><interface-information>' + one("so-0", "up", "10.1.2.1") + one("so-1", "down", "10.1.2.5") + one("dsc", "up", "10.1.2.9") + "</interface-information></router></all>")
    assert [tuple(r) for r in X.read_interfaces_xml(spark, str(f)).collect()] == [("r1", "so-0", "10.1.2.1", 30, True)]


def test_facts_and_models(spark, tmp_path):
    f = tmp_path / "clique-1.2.3.4-5.6.7.8.model"
    f.write_text("% comment rr(1,2,3).\ngap(1_2,1_3,2,1).\ngap(1_2,1_3,2,1,4). % five\nBest model: {link(ip1_1_1_1,ip2_2_2_2,1), other(ip1_1_1_1,rrend)}\nCost ([Weight:Level]): <[3:5]>\nBest model: {link(ip1_1_1_1,ip")
    lns = X.lines(spark, str(f))
    g = X.typed_facts(X.read_facts(lns.where("value LIKE 'gap%'")), "gap", ["id1", "id2", "length", "delta", "n"])
    assert sorted((r.length, r.delta, r.n or "") for r in g.collect()) == [("2", "1", ""), ("2", "1", "4")]
    m = sorted((r.pred, r.a1, r.a2, r.a3) for r in X.read_models(lns).collect())
    assert m == [("link", "ip1_1_1_1", "ip2_2_2_2", "1"), ("other", "ip1_1_1_1", None, "rrend")]
    assert [(r.weight, r.level) for r in X.read_model_costs(lns).collect()] == [(3, 5)]


def test_address_round_trip(spark):
    d = spark.createDataFrame([("0.0.0.0",), ("255.255.255.255",), ("10.1",)], "ip string")
    assert [r[0] for r in d.select(ipf.int_to_ip(ipf.ip_to_int("ip"))).collect()] == ["0.0.0.0", "255.255.255.255", "10.1.0.0"]
    c = d.select(ipf.canonical_prefix(F.lit("10.9.8.7/0"))).first()[0]
    assert (c.net, c.len) == (0, 0)


def test_no_difference_of_a_graph_with_itself(spark):
    g = spark.createDataFrame([("alias", 1, 2, 0), ("link", 2, 3, 1), ("alias", 5, 5, 0)], "item string, ip1 bigint, ip2 bigint, link_type int")
    assert D.diff_graphs(g, g).count() == 0 and D.diff_aliases(g, g).where("side <> 'both'").count() == 0


def test_peers_expire(spark, tmp_path):
    d = tmp_path / "in"
    for i, rows in enumerate(([(1, 80, "2024-01-01 00:00:00")], [(2, 81, "2024-01-01 03:00:00")], [(2, 82, "2024-01-01 05:00:00")])):
        spark.createDataFrame(rows, "ip bigint, port bigint, ts string").selectExpr("ip", "port", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(d))
    s = spark.readStream.schema("ip bigint, port bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(d))
    out = V.run_to_table(V.stream_peer_registry(s), str(tmp_path / "o"), str(tmp_path / "s")).collect()
    assert {(r.ip, r.port) for r in out if not r.alive} >= {(1, 80)}
    assert max((r.last_seen, r.port) for r in out if r.ip == 2 and r.alive)[1] == 82


def test_lines_of_one_file_meet_their_heading_in_many_tasks(spark, many_runs):
    lns = spark.range(2000).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.lit("x").alias("value"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = X._beside(lns, lns.groupBy("file").agg(F.min("pos").alias("hp")))
        tasks = d.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.max("hp").alias("hp")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(t.n for t in tasks) == 2000 and all(t.hp == 0 for t in tasks)
    assert len(tasks) > 4 and max(t.n for t in tasks) < 600
