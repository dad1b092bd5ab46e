"""Registered queries: column functions and address operators."""

from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..functions import probe as pf
from ..operators import addresses as A
from ..operators import hops as H
from . import tables as T
from .registry import query
from .tables import DEST_BASE, ROUTER_BASE, SOURCE_BASE, SQL, sql_ip


def _supp_ips(spark, sf):
    return T.table(spark, sf, "supplier").select((F.col("s_suppkey") + ROUTER_BASE).alias("ip"))


def _part_ips(spark, sf):
    return T.table(spark, sf, "part").select(((F.col("p_partkey") * 3).cast("bigint") + ROUTER_BASE).alias("ip"))


PARTIP = f"(p_partkey * 3 + {ROUTER_BASE})"


@query("ip_to_int", f"SELECT p_partkey, {sql_ip(PARTIP)} AS ip, {PARTIP} AS n, {PARTIP.replace('* 3', '* 0')} AS short FROM part")
def _(spark, sf):
    ip = ipf.int_to_ip(F.col("p_partkey") * 3 + ROUTER_BASE)
    return T.table(spark, sf, "part").select(
        "p_partkey", ip.alias("ip"), ipf.ip_to_int(ip).alias("n"), ipf.ip_to_int(F.lit("10")).alias("short")
    )


@query("int_to_ip", f"SELECT p_partkey, {sql_ip('p_partkey * 99991')} AS ip FROM part")
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", ipf.int_to_ip(F.col("p_partkey") * 99991).alias("ip"))


@query("ip_atom", f"SELECT s_suppkey, 'ip' || replace({sql_ip(f's_suppkey + {ROUTER_BASE}')}, '.', '_') AS atom, {sql_ip(f's_suppkey + {ROUTER_BASE}')} AS back FROM supplier")
def _(spark, sf):
    a = ipf.ip_atom(ipf.ip_atom(ipf.int_to_ip(F.col("s_suppkey") + ROUTER_BASE)))
    return T.table(spark, sf, "supplier").select("s_suppkey", a.alias("atom"), ipf.atom_ip(a).alias("back"))


@query("prefix_match", f"""SELECT p_partkey, 20 + p_partkey % 13 AS len,
  (({PARTIP}) >> CAST(12 - p_partkey % 13 AS INTEGER)) = (({ROUTER_BASE} + 1030) >> CAST(12 - p_partkey % 13 AS INTEGER)) AS hit FROM part""")
def _(spark, sf):
    d = T.table(spark, sf, "part").withColumn("len", 20 + F.col("p_partkey") % 13)
    return d.select("p_partkey", "len", ipf.prefix_match(
        F.lit(ROUTER_BASE + 1030), "len", F.col("p_partkey") * 3 + ROUTER_BASE).alias("hit"))


@query("canonical_prefix", f"""WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN {PARTIP} WHEN 1 THEN ({PARTIP} >> 8) << 8
   WHEN 2 THEN ({PARTIP} >> 16) << 16 ELSE ({PARTIP} >> 24) << 24 END AS n FROM part),
 y AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size % 33 WHEN n & 16777215 = 0 THEN 8 WHEN n & 65535 = 0 THEN 16
   WHEN n & 255 = 0 THEN 24 END AS len FROM x)
 SELECT p_partkey, CASE WHEN len IS NULL THEN n WHEN len = 0 THEN 0 ELSE (n >> (32 - len)) << (32 - len) END AS net, len FROM y""")
def _(spark, sf):
    n = F.col("p_partkey") * 3 + ROUTER_BASE
    cut = lambda b: F.shiftleft(F.shiftright(n, b), b)
    m = F.col("p_partkey") % 4
    n = F.when(m == 0, n).when(m == 1, cut(8)).when(m == 2, cut(16)).otherwise(cut(24))
    text = F.concat(ipf.int_to_ip(n), F.when(
        F.col("p_size") % 2 == 0, F.concat(F.lit("/"), (F.col("p_size") % 33).cast("string"))).otherwise(""))
    return T.table(spark, sf, "part").select("p_partkey", ipf.canonical_prefix(text).alias("c")).select("p_partkey", "c.*")


@query("filter_prefixes", f"""SELECT {PARTIP} AS ip FROM part WHERE ({PARTIP} >> 4) = ({ROUTER_BASE + 64} >> 4)
  OR ({PARTIP} >> 8) = ({ROUTER_BASE + 1024} >> 8)""")
def _(spark, sf):
    return A.filter_prefixes(_part_ips(spark, sf), ["ip"], [(ROUTER_BASE + 64, 28), (ROUTER_BASE + 1024, 24)])


_OB1 = f"""WITH i AS (SELECT DISTINCT s_suppkey + {ROUTER_BASE} AS ip FROM supplier)
  SELECT a.ip AS ip1, b.ip AS ip2, %s AS fact FROM i a JOIN i b ON abs(a.ip - b.ip) = 1 AND a.ip >> 2 = b.ip >> 2"""


@query("off_by_one", _OB1 % "'offbyone'")
def _(spark, sf):
    return A.off_by_one_pairs(_supp_ips(spark, sf).distinct())


@query("off_by_one_exception", _OB1 % f"CASE WHEN regexp_matches({sql_ip('a.ip')}, '^10[.]0[.]0[.]1[0-9]$') OR regexp_matches({sql_ip('b.ip')}, '^10[.]0[.]0[.]1[0-9]$') THEN 'offbyoneException' ELSE 'offbyone' END")
def _(spark, sf):
    return A.off_by_one_pairs(_supp_ips(spark, sf).distinct(), [r"^10\.0\.0\.1[0-9]$"])


@query("off_by_one_loose", f"""SELECT l_suppkey AS a, l_partkey // 20 AS b, count(*) AS n FROM lineitem
  WHERE abs(l_suppkey - l_partkey // 20) = 1 AND l_suppkey >> 8 = (l_partkey // 20) >> 8 GROUP BY ALL""")
def _(spark, sf):
    d = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).cast("bigint").alias("b"))
    return d.where(ipf.off_by_one_loose("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("same_prefix24", f"""WITH i AS (SELECT DISTINCT {PARTIP} AS ip FROM part)
  SELECT a.ip AS ip1, b.ip AS ip2 FROM i a JOIN i b ON a.ip >> 8 = b.ip >> 8 AND a.ip <> b.ip""")
def _(spark, sf):
    return A.same_prefix24(_part_ips(spark, sf))


@query("link_peer_addresses", f"""WITH x AS (SELECT p_partkey, {PARTIP} AS ip, 28 + p_partkey % 5 AS len FROM part)
  SELECT ip, len, xor(ip, 1) AS peer FROM x WHERE len = 31 UNION ALL SELECT ip, len, xor(ip, 3) FROM x WHERE len = 30
  UNION ALL SELECT ip, len, ((ip >> 3) << 3) + k FROM x, range(1, 7) t(k) WHERE len = 29 AND ((ip >> 3) << 3) + k <> ip""")
def _(spark, sf):
    d = T.table(spark, sf, "part").select((F.col("p_partkey") * 3 + ROUTER_BASE).alias("ip"), (28 + F.col("p_partkey") % 5).alias("len"))
    return d.select("ip", "len", F.explode(ipf.link_peer_addresses("ip", "len")).alias("peer"))


_BOGON = "(p_partkey * 2147483 % 4294967296)"


@query("is_bogon", f"""SELECT p_partkey, ip >> 24 = 10 OR ip >> 16 = 49320 OR ip >> 20 = 2753 AS bogon
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 2147483 % 4294967296 WHEN p_partkey % 3 = 1
  THEN p_partkey + {SOURCE_BASE} + (p_partkey % 7) * 300000 ELSE p_partkey + {DEST_BASE} + (p_partkey % 5) * 20000 END AS ip FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey")
    ip = F.when(k % 3 == 0, k * 2147483 % 4294967296).when(k % 3 == 1, k + SOURCE_BASE + (k % 7) * 300000).otherwise(
        k + DEST_BASE + (k % 5) * 20000)
    return T.table(spark, sf, "part").select("p_partkey", ipf.is_bogon(ip).alias("bogon"))


@query("is_loopback", "SELECT p_partkey, p_partkey % 10 = 1 AS loopback FROM part")
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", ipf.is_loopback((F.col("p_partkey") % 10) + 127 * 16777216).alias("loopback"))


@query("canonical_pair", "SELECT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    lo, hi = ipf.canonical_pair("l_suppkey", "l_partkey")
    return T.table(spark, sf, "lineitem").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("responder_class", "WITH " + SQL["base"] + """ SELECT CASE WHEN qty = 50 THEN 'ENDHOST' WHEN resp = dst AND flag = 'A' THEN 'NAT'
  WHEN resp = dst THEN 'FIREWALL?' ELSE 'ROUTER' END AS class, count(*) AS n FROM base GROUP BY ALL""")
def _(spark, sf):
    b = T._base(spark, sf)
    return b.groupBy(pf.responder_class("resp", "dst", F.col("flag") == "A", F.col("qty") == 50).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("probe_status", """SELECT CASE s WHEN 'SENT' THEN 'RECV' WHEN 'UNSENT' THEN 'UNSENT' WHEN 'TIMEDOUT' THEN 'OLD' ELSE 'DUPLICATE' END AS status,
  count(*) AS n FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'SENT' WHEN 1 THEN 'UNSENT' WHEN 2 THEN 'TIMEDOUT' ELSE 'RECEIVED' END AS s FROM events) GROUP BY ALL""")
def _(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in ("SENT", "UNSENT", "TIMEDOUT", "RECEIVED")]), (F.col("user_id") % 4 + 1).cast("int"))
    return T.table(spark, sf, "events").groupBy(pf.probe_status(s).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_mpls", "SELECT p_partkey, CAST(p_partkey % 1048576 AS INTEGER) AS label, CAST(p_size % 8 AS INTEGER) AS cos, CAST(p_partkey % 256 AS INTEGER) AS ttl, CAST(p_size % 2 AS INTEGER) AS s FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf):
    line = F.when(F.col("p_partkey") % 3 == 0, F.format_string(
        "- RECV TTL 3 it=1 from 10.0.0.1 (250)\tROUTER\t rtt=0.1 s t=1.5 MPLS,l=%d,CoS=%d,ttl=%d,S=%d, Macro",
        F.col("p_partkey") % 1048576, F.col("p_size") % 8, F.col("p_partkey") % 256, F.col("p_size") % 2)).otherwise("- RECV TTL 3 Macro")
    d = T.table(spark, sf, "part").select("p_partkey", pf.parse_mpls(line).alias("m")).where("m IS NOT NULL")
    return d.select("p_partkey", "m.label", "m.cos", "m.ttl", "m.s")


@query("parse_probe_type", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Macro' WHEN 1 THEN 'TraceRoute' WHEN 2 THEN 'Pollo' END AS ptype FROM part")
def _(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in (
        "hop 1 1.2.3.4 ,  Macro", "t=1.2 TraceRoute?", "hop 1 1.2.3.4 ,  Pollo Non-time exceeded message: ICMP type=12 code=0 : ABORT!",
        "noise")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return T.table(spark, sf, "part").select("p_partkey", pf.parse_probe_type(F.concat(F.lit("- RECV TTL 1 "), tail)).alias("ptype"))


@query("link_type_code", "SELECT p_partkey, CAST(p_partkey % 5 + 1 AS INTEGER) AS code, CASE p_partkey % 5 WHEN 0 THEN 'RR' WHEN 1 THEN 'STR' WHEN 2 THEN 'TR' WHEN 3 THEN 'UNKNOWN' ELSE 'HIDDEN' END AS name FROM part")
def _(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("rr", "STR", "3", "Unknown", "HIDDEN")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    code = pf.link_type_code(name)
    return T.table(spark, sf, "part").select("p_partkey", code.alias("code"), pf.link_type_name(code).alias("name"))


@query("better_link", "SELECT p_partkey, p_partkey % 5 < p_size % 5 AS better FROM part")
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", pf.better_link(F.col("p_partkey") % 5, F.col("p_size") % 5).alias("better"))


@query("guess_hops", "SELECT p_partkey, CASE WHEN p_partkey % 256 <= 64 THEN 64 - p_partkey % 256 WHEN p_partkey % 256 <= 128 THEN 128 - p_partkey % 256 ELSE 255 - p_partkey % 256 END AS hops FROM part")
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", pf.guess_hops(F.col("p_partkey") % 256).alias("hops"))


@query("normalize_ttl", """SELECT p_partkey, CASE WHEN d > 64 THEN d - 64 ELSE d END AS ttl FROM (SELECT p_partkey,
  CASE WHEN p_partkey % 256 > 192 THEN p_partkey % 256 - 192 ELSE p_partkey % 256 END AS d FROM part)""")
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", pf.normalize_ttl(F.col("p_partkey") % 256).alias("ttl"))


@query("reply_kind", """WITH x AS (SELECT p_partkey, p_size % 3 AS p, CASE p_partkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS a,
   CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 11 END AS t, p_partkey % 2 * 3 AS c, p_partkey % 2 = 0 AS rst FROM part),
 y AS (SELECT *, CASE WHEN p = 0 AND a = 'tcp' AND rst THEN '' WHEN p = 1 AND a = 'icmp' AND t = 3 AND c = 3 THEN ''
   WHEN p = 2 AND a = 'icmp' AND t = 0 AND c = 0 THEN '' WHEN a = 'tcp' AND rst THEN ':TCP_RST' WHEN a = 'tcp' THEN ':TCP' WHEN a = 'udp' THEN ':UDP'
   WHEN t = 0 THEN ':ICMP_ECHOREPLY' WHEN t = 3 THEN ':ICMP_U_' || CAST(c AS VARCHAR) ELSE ':ICMP_UNK_' || CAST(t AS VARCHAR) END AS s FROM x)
 SELECT p_partkey, CAST(57 AS INTEGER) AS ttl, CASE WHEN s = '' THEN '-' ELSE s[2:] END AS kind FROM y""")
def _(spark, sf):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    k, z = F.col("p_partkey"), F.col("p_size")
    s = pf.reply_kind(pick(("tcp", "udp", "icmp"), z % 3), pick(("tcp", "udp", "icmp"), k % 3), pick((0, 3, 3, 11), z % 4), (k % 2 * 3).cast("int"), k % 2 == 0)
    return T.table(spark, sf, "part").select("p_partkey", pf.split_reply(F.concat(F.lit("57"), s)).alias("r")).select("p_partkey", "r.ttl", "r.kind")


@query("rr_self_loop", "WITH " + SQL["rr"] + " SELECT src, dst, ttl, resp, count(*) AS n FROM rrp WHERE len(list_distinct(rr)) < len(rr) GROUP BY ALL")
def _(spark, sf):
    return T.rr_probes(spark, sf).where(pf.rr_self_loop("rr")).groupBy("src", "dst", "ttl", "resp").agg(F.count(F.lit(1)).alias("n"))


@query("rr_index_reversed", "WITH " + SQL["rr"] + " SELECT src, ttl, resp, i AS idx, rr[len(rr) - i + 1] AS ip, count(*) AS n FROM rrp, range(1, 10) x(i) WHERE i <= len(rr) GROUP BY ALL")
def _(spark, sf):
    d = H.rr_index_reversed(T.rr_probes(spark, sf).select("src", "ttl", "resp", "rr"))
    return d.groupBy("src", "ttl", "resp", F.col("idx").cast("bigint").alias("idx"), "ip").agg(F.count(F.lit(1)).alias("n"))


@query("swap_id_bytes", "SELECT event_id, ((event_id % 65536) & 255) * 256 + ((event_id % 65536) >> 8) AS swapped FROM events")
def _(spark, sf):
    return T.table(spark, sf, "events").select("event_id", pf.swap_id_bytes(F.col("event_id") % 65536).alias("swapped"))


@query("router_clock_ms", """SELECT event_id, (epoch_us(ts) % 86400000000) // 1000 + CASE WHEN epoch_us(ts) % 1000 > 500 THEN 1 ELSE 0 END AS ms FROM events""")
def _(spark, sf):
    return T.table(spark, sf, "events").select("event_id", pf.router_clock_ms("ts").alias("ms"))


@query("retransmit_timeout", "SELECT event_id, CASE WHEN user_id % 5 < 1 THEN 2 * event_id ELSE event_id + 4 * user_id END AS rto, CASE WHEN user_id % 5 < 1 THEN event_id + 2 * user_id ELSE event_id + 4 * user_id END AS rto2 FROM events")
def _(spark, sf):
    n = F.col("user_id") % 5
    return T.table(spark, sf, "events").select("event_id", pf.retransmit_timeout("event_id", "user_id", n).alias("rto"),
                                               pf.retransmit_timeout("event_id", "user_id", n, "mdev").alias("rto2"))


@query("subnet_key", f"SELECT split_part({sql_ip(f's_suppkey * 70000 + {ROUTER_BASE}')}, '.', 1) || '.' || split_part({sql_ip(f's_suppkey * 70000 + {ROUTER_BASE}')}, '.', 2) AS subnet, count(*) AS n FROM supplier GROUP BY ALL")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(ipf.subnet_key(ipf.int_to_ip(F.col("s_suppkey") * 70000 + ROUTER_BASE)).alias("subnet"))
    return s.groupBy("subnet").agg(F.count(F.lit(1)).alias("n"))


@query("disaggregate_prefixes", f"""WITH p AS (SELECT CASE WHEN s_nationkey = 3 THEN 65333 ELSE 100 + s_nationkey END AS asn,
   18 + s_suppkey % 8 AS len, (((s_suppkey * 4096) + {ROUTER_BASE}) >> (14 - s_suppkey % 8)::INTEGER) << (14 - s_suppkey % 8)::INTEGER AS net FROM supplier),
 q AS (SELECT * FROM p WHERE asn <> 65333)
 SELECT DISTINCT ip FROM (SELECT net + 1 AS ip FROM q UNION ALL
   SELECT ((net >> 10) << 10) + k * 1024 + 1 FROM q, range(0, 16) r(k)
   WHERE ((net >> 10) << 10) + k * 1024 >= net AND ((net >> 10) << 10) + k * 1024 < net + (1 << (32 - len)::INTEGER))""")
def _(spark, sf):
    k = F.col("s_suppkey")
    bits = F.lit(14) - (k % 8).cast("int")
    net = F.call_function("shiftleft", F.call_function("shiftright", k * 4096 + ROUTER_BASE, bits), bits)
    p = T.table(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") == 3, 65333).otherwise(100 + F.col("s_nationkey")).alias("asn"),
        (18 + k % 8).cast("int").alias("len"), net.alias("net"))
    return A.disaggregate_prefixes(p, 22)
