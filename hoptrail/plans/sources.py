"""Registered queries: readers. Lines are built from the tables by Spark, then parsed; the SQL twins state the result."""

from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..session import cut_lineage
from ..sources import binary as B
from ..sources import text as X
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SOURCE_BASE, SQL, sql_ip

L = F.lit


def _ip(c):
    return ipf.int_to_ip(c)


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def trace_lines(df):
    """One response line per lineitem row: record-route, label-stack, unmatched and unknown-time variants among them."""
    k, n, q = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    src, dst = _ip(F.col("l_suppkey") + SOURCE_BASE), _ip(F.col("l_orderkey") + T.DEST_BASE)
    file = F.concat(L("/logs/data-"), src, L(":35343-"), dst, L(":80-"), _s("l_orderkey"))
    micros = F.unix_micros("l_shipdate") + k
    t = F.concat(_s(F.floor(micros / 1000000)), L("."), F.lpad(_s(micros % 1000000), 6, "0"))
    time = F.when(q % 10 == 0, F.concat(L(" NO MATCH t="), t)).when(q % 10 == 1, L(" rtt=0.25 s t=??")).otherwise(
        F.concat(L(" rtt=0."), F.lpad(_s(k % 1000000), 6, "0"), L(" s t="), t))
    rr = F.when(F.col("l_returnflag") == "R", L("")).otherwise(F.concat(
        L(" RR, hop 1 "), _ip(F.floor(k / 20) + ROUTER_BASE), L(" , hop 2 "), _ip(k + ROUTER_BASE), L(" , ")))
    mpls = F.when(q % 7 == 0, F.concat(L(" MPLS,l="), _s(k), L(",CoS=1,ttl=2,S=1,"))).otherwise(L(""))
    status = F.when(q == 13, "DUPLICATE").otherwise("RECV")
    line = F.concat(L("- "), status, L(" TTL "), _s(n), F.when(q == 17, " it?=").otherwise(" it="), _s(q % 4), L(" from "),
                    F.lpad(_ip(F.col("l_suppkey") + ROUTER_BASE), 16, " "), L(" ("), _s(q + 200), L(")\tROUTER\t"), time, rr, mpls,
                    F.when(k % 2 == 0, " Macro").otherwise(" TraceRoute"))
    return df.select(file.alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"), line.alias("value"))


_LOG = f"""SELECT 'data-' || {sql_ip(f'l_suppkey + {SOURCE_BASE}')} || ':35343-' || {sql_ip(f'l_orderkey + {T.DEST_BASE}')} || ':80-' || l_orderkey AS trace_id,
  {sql_ip(f'l_suppkey + {SOURCE_BASE}')} AS src, {sql_ip(f'l_orderkey + {T.DEST_BASE}')} AS dst, l_orderkey AS conn_id, CASE WHEN l_quantity = 13 THEN 'DUPLICATE' ELSE 'RECV' END AS status, l_linenumber AS ttl, CAST(l_quantity AS INTEGER) % 4 AS it,
  {sql_ip(f'l_suppkey + {ROUTER_BASE}')} AS resp, CAST(l_quantity AS INTEGER) + 200 AS rttl, 'ROUTER' AS class,
  CASE CAST(l_quantity AS INTEGER) % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.25 ELSE l_partkey % 1000000 / 1e6 END AS rtt, CASE WHEN CAST(l_quantity AS INTEGER) % 10 <> 1 THEN epoch_us(l_shipdate) + l_partkey END AS t,
  CASE WHEN l_returnflag <> 'R' THEN {sql_ip(f'l_partkey // 20 + {ROUTER_BASE}')} || ' ' || {sql_ip(f'l_partkey + {ROUTER_BASE}')} END AS rr,
  CASE WHEN CAST(l_quantity AS INTEGER) % 7 = 0 THEN CAST(l_partkey AS INTEGER) END AS label, CASE WHEN l_partkey % 2 = 0 THEN 'Macro' ELSE 'TraceRoute' END AS ptype FROM lineitem"""


def _flat(p):
    return p.select("trace_id", "src", "dst", "conn_id", "status", "ttl", "it", "resp", "rttl", "class", "rtt", F.unix_micros("t").alias("t"),
                    F.array_join("rr", " ").alias("rr"), F.col("mpls.label").alias("label"), "ptype")


@query("read_trace_log", _LOG)
def _(spark, sf):
    logs = cut_lineage(trace_lines(T.table(spark, sf, "lineitem")).repartition("file"))     # stands for the files on disk
    return _flat(X.read_trace_log(logs))


@query("parse_trace_filename", f"SELECT o_orderkey, {sql_ip(f'o_custkey + {SOURCE_BASE}')} AS src, CASE WHEN o_orderkey % 2 = 0 THEN 35343 ELSE 0 END AS sport, {sql_ip(f'o_orderkey + {T.DEST_BASE}')} AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 80 ELSE 33434 END AS dport, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS conn_id FROM orders")
def _(spark, sf):
    s, d = _ip(F.col("o_custkey") + SOURCE_BASE), _ip(F.col("o_orderkey") + T.DEST_BASE)
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(L("/x/data-"), s, L(":35343-"), d, L(":80-"), _s("o_custkey"))).otherwise(
        F.concat(L("data-"), s, L(",0-"), d, L(",33434")))
    o = T.table(spark, sf, "orders")
    return o.select("o_orderkey", *X.parse_trace_filename(name))


@query("read_send_lines", "SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(o_orderkey % 50 AS INTEGER) AS train, CAST(least(o_orderkey % 30, 10) AS INTEGER) AS distance FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, sf):
    k = F.col("o_orderkey")
    v = F.when(F.col("o_orderstatus") == "P", F.concat(L("1.2.3.4:5-6.7.8.9:80 -\tSending probe=1 safettl="), _s(k % 30))).otherwise(F.concat(
        L("1.2.3.4:5-6.7.8.9:80 -\tSending train="), _s(k % 50), L(" type=DATA safettl="), _s(k % 30), L(" nProbes=11 payload=-1 RR=1 rto=1500000(1) time=1.5")))
    return X.read_send_lines(T.table(spark, sf, "orders").select(_s("o_custkey").alias("file"), L(0).alias("pos"), v.alias("value")))


@query("read_final_state", f"SELECT CAST(o_orderkey AS VARCHAR) AS file, {sql_ip(f'o_custkey + {ROUTER_BASE}')} AS ip, CAST(o_orderkey % 110 AS INTEGER) AS state, CASE WHEN o_orderstatus <> 'P' THEN {sql_ip(f'o_custkey + {ROUTER_BASE}')} || ' ' || {sql_ip(f'o_orderkey + {ROUTER_BASE}')} END AS stops FROM orders")
def _(spark, sf):
    a, b = _ip(F.col("o_custkey") + ROUTER_BASE), _ip(F.col("o_orderkey") + ROUTER_BASE)
    head = F.concat(L("# finalstate "), a, L("=="), _s(F.col("o_orderkey") % 110))
    stop = F.when(F.col("o_orderstatus") != "P", F.concat(L("# stoplist = "), a, L(" : "), b))
    lns = T.table(spark, sf, "orders").select(_s("o_orderkey").alias("file"), F.posexplode(F.array(head, stop, L("- RECV TTL 1"))).alias("pos", "value")).where("value IS NOT NULL")
    return X.read_final_state(lns).withColumn("stops", F.array_join("stops", " "))


def adjacency_text(spark, sf):
    """Graph lines of the suppliers: routers of four addresses with a type mark, and a link between neighbours."""
    s = T.table(spark, sf, "supplier").withColumn("r", F.concat(L("R"), _s(F.floor(F.col("s_suppkey") / 4)), L("_B")))
    r = s.groupBy("r").agg(F.array_sort(F.collect_list(_ip(F.col("s_suppkey") + ROUTER_BASE))).alias("ips")).select(
        F.concat(L("Router "), "r", L(" nAlly="), _s(F.size("ips")), L(" "), F.array_join("ips", " ")).alias("value"))
    name = F.element_at(F.array(*[L(x) for x in ("RR", "STR", "TR", "UNKNOWN", "HIDDEN")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    l = s.select(F.concat(L("Link  "), "r", L(":"), _ip(F.col("s_suppkey") + ROUTER_BASE), L(" -- R"), _s(F.floor((F.col("s_suppkey") + 1) / 4)), L("_B:"),
                          _ip(F.col("s_suppkey") + 1 + ROUTER_BASE), L(" : "), name).alias("value"))
    blank = spark.range(1).select(L("  ").alias("value"))
    return r.unionByName(l).unionByName(blank).select(L("g").alias("file"), L(0).alias("pos"), "value")


@query("read_adjacency", f"SELECT 'R' || s_suppkey // 4 || '_B' AS src_router, {sql_ip(f's_suppkey + {ROUTER_BASE}')} AS src_ip, 'R' || (s_suppkey + 1) // 4 || '_B' AS dst_router, {sql_ip(f's_suppkey + 1 + {ROUTER_BASE}')} AS dst_ip, CAST(1 + s_suppkey % 5 AS INTEGER) AS link_type FROM supplier")
def _(spark, sf):
    return X.read_adjacency(adjacency_text(spark, sf))[1]


@query("read_adjacency_routers", f"SELECT 'R' || s_suppkey // 4 || '_B' AS router, 'Router' AS kind, 'B' AS types, {sql_ip(f's_suppkey + {ROUTER_BASE}')} AS ip FROM supplier")
def _(spark, sf):
    return X.read_adjacency(adjacency_text(spark, sf))[0].withColumn("types", F.array_join("types", " "))


@query("read_facts", f"SELECT 'gap' AS pred, '10_' || l_orderkey AS a1, '10_' || (l_orderkey + 1) AS a2, CAST(l_linenumber AS VARCHAR) AS a3, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL UNION ALL SELECT 'potentialAlias', 'ip' || replace({sql_ip(f'l_suppkey + {ROUTER_BASE}')}, '.', '_'), 'ip1_2_3_4', 'name', count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def _(spark, sf):
    k = F.col("l_orderkey")
    v = F.when(F.col("l_returnflag") == "A", F.concat(L("gap(10_"), _s(k), L(", 10_"), _s(k + 1), L(","), _s("l_linenumber"), L("). % gap: a --> b"))).when(
        F.col("l_returnflag") == "R", F.concat(L("potentialAlias("), ipf.ip_atom(_ip(F.col("l_suppkey") + ROUTER_BASE)), L(",ip1_2_3_4,name)."))).otherwise("% rr(1,2,3). nothing")
    f = X.read_facts(T.table(spark, sf, "lineitem").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))
    return f.groupBy("pred", *[F.try_element_at("args", L(i)).alias(f"a{i}") for i in (1, 2, 3)]).agg(F.count(L(1)).alias("n"))


def _model_lines(spark, sf):
    a = lambda c: ipf.ip_atom(_ip(F.col(c) + ROUTER_BASE))
    o = T.table(spark, sf, "orders").withColumn("a", a("o_custkey")).withColumn("b", a("o_orderkey"))
    best = F.concat(L("Best model: {link("), "a", L(","), "b", L(",1), -alias("), "a", L(","), "b", L(",ally), other("), "a", L(",rrend), type("), "b", L(",n)"),
                    F.when(F.col("o_orderstatus") == "P", "").otherwise("}"))
    cost = F.concat(L("Cost ([Weight:Level]): <["), _s(F.col("o_orderkey") % 9), L(":5],[1:10]>"))
    return o.select(F.concat(L("/m/clique-"), _s("o_orderkey")).alias("file"), F.posexplode(F.array(best, cost)).alias("pos", "value"))


_A = lambda c: f"'ip' || replace({sql_ip(f'{c} + {ROUTER_BASE}')}, '.', '_')"


@query("read_models", f"""SELECT 'clique-' || o_orderkey AS model, p AS pred, CASE WHEN p = 'type' THEN {_A('o_orderkey')} ELSE {_A('o_custkey')} END AS a1, CASE WHEN p IN ('link', '-alias') THEN {_A('o_orderkey')} END AS a2,
  CASE p WHEN 'link' THEN '1' WHEN '-alias' THEN 'ally' WHEN 'other' THEN 'rrend' ELSE 'n' END AS a3 FROM orders, unnest(['link', '-alias', 'other', 'type']) x(p) WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    return X.read_models(_model_lines(spark, sf))


@query("read_model_costs", "SELECT 'clique-' || o_orderkey AS model, CAST(o_orderkey % 9 AS INTEGER) AS weight, 5 AS level FROM orders UNION ALL SELECT 'clique-' || o_orderkey, 1, 10 FROM orders")
def _(spark, sf):
    return X.read_model_costs(_model_lines(spark, sf))


@query("read_conflict_debug", f"SELECT {sql_ip(f'o_custkey + {ROUTER_BASE}')} AS ip1, {sql_ip(f'o_orderkey + {ROUTER_BASE}')} AS ip2, CAST(1 + o_orderkey % 2 AS INTEGER) AS link_type, './clique-1-' || o_custkey || '.model ./clique-2-3.model' AS link_models, './clique-4-' || o_orderkey || '.model' AS alias_models FROM orders")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    a, b = ipf.ip_atom(_ip(F.col("o_custkey") + ROUTER_BASE)), ipf.ip_atom(_ip(F.col("o_orderkey") + ROUTER_BASE))
    v = F.concat(L("link("), a, L(","), b, L(","), _s(1 + F.col("o_orderkey") % 2), L(") 2 alias("), a, L(","), b, L(") 1 (./clique-1-"), _s("o_custkey"), L(".model;./clique-2-3.model) ( ./clique-4-"), _s("o_orderkey"), L(".model)"))
    c = X.read_conflict_debug(o.select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))
    return c.withColumn("link_models", F.array_join("link_models", " ")).withColumn("alias_models", F.array_join("alias_models", " "))


@query("read_alias_sets", f"SELECT {sql_ip(f'o_custkey + {ROUTER_BASE}')} AS ip, 2 AS size, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT {sql_ip(f'o_orderkey + {T.DEST_BASE}')}, 2, count(*) FROM orders GROUP BY 1".replace("2 AS size", "CAST(2 AS BIGINT) AS size"))
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    v = F.concat(_ip(F.col("o_custkey") + ROUTER_BASE), L("  "), _ip(F.col("o_orderkey") + T.DEST_BASE), L(" "))
    s = X.read_alias_sets(o.select(L("f").alias("file"), F.col("o_orderkey").alias("pos"), v.alias("value")))
    size = s.groupBy("router").agg(F.count(L(1)).alias("size"))
    return s.join(size, "router").groupBy("ip", "size").agg(F.count(L(1)).alias("n"))


@query("read_alias_pairs", f"SELECT CASE WHEN o_orderstatus <> 'P' THEN {sql_ip(f'o_custkey + {ROUTER_BASE}')} END AS ip1, CASE WHEN o_orderstatus <> 'P' THEN {sql_ip(f'o_orderkey + {ROUTER_BASE}')} END AS ip2, o_orderstatus <> 'P' AS valid FROM orders")
def _(spark, sf):
    v = F.concat(_ip(F.col("o_custkey") + ROUTER_BASE), F.when(F.col("o_orderstatus") == "P", " junk ").otherwise(" "), _ip(F.col("o_orderkey") + ROUTER_BASE))
    return X.read_alias_pairs(T.table(spark, sf, "orders").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))


@query("read_router_id_pairs", f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS router, {sql_ip(f'l_suppkey + {ROUTER_BASE}')} AS ip FROM lineitem")
def _(spark, sf):
    v = F.concat(_s("l_orderkey"), L(" "), _ip(F.col("l_suppkey") + ROUTER_BASE))
    return X.read_router_id_pairs(T.table(spark, sf, "lineitem").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))


def verdict_lines(spark, sf):
    t = F.element_at(F.array(L("ALIAS! probe/x: 11, 12"), L("NOT ALIAS. timing (9): 5"), L("UNKNOWN. no data")), (F.col("l_partkey") % 3 + 1).cast("int"))
    v = F.concat(_ip(F.col("l_suppkey") + ROUTER_BASE), L(" "), _ip(F.col("l_orderkey") + T.DEST_BASE), L(" :: "), t)
    return T.table(spark, sf, "lineitem").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value"))


_VERDICTS = f"SELECT {sql_ip(f'l_suppkey + {ROUTER_BASE}')} AS ip1, {sql_ip(f'l_orderkey + {T.DEST_BASE}')} AS ip2, ['probex', 'timing', NULL][1 + l_partkey % 3] AS source, ['ALIAS', 'NOT', 'UNKNOWN'][1 + l_partkey % 3] AS verdict FROM lineitem"


@query("read_alias_verdicts", _VERDICTS)
def _(spark, sf):
    return X.read_alias_verdicts(verdict_lines(spark, sf))


@query("read_iplane_text", f"""SELECT 'trace.out.' || o_orderkey % 5 AS file, {sql_ip(f'o_orderkey + {T.DEST_BASE}')} AS dest, CAST(o_custkey % 30 AS INTEGER) AS n_hops, l_linenumber AS idx, {sql_ip(f'l_suppkey + {ROUTER_BASE}')} AS ip, l_quantity / 4 AS rtt, CAST(l_quantity AS INTEGER) AS ttl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf):
    file = lambda c: F.concat(L("trace.out."), _s(F.col(c) % 5)).alias("file")
    z = L(0).cast("bigint")
    head = T.table(spark, sf, "orders").select(
        file("o_orderkey"), F.struct(F.col("o_orderkey").alias("a"), z.alias("b"), z.alias("c")).alias("pos"),
        F.concat(L("destination: "), _ip(F.col("o_orderkey") + T.DEST_BASE), L(" hops: "), _s(F.col("o_custkey") % 30)).alias("value"))
    hop = T.table(spark, sf, "lineitem").select(
        file("l_orderkey"), F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"), F.monotonically_increasing_id().alias("c")).alias("pos"),
        F.concat(_s("l_linenumber"), L(": "), _ip(F.col("l_suppkey") + ROUTER_BASE), L(" "), _s(F.col("l_quantity") / 4), L(" "), _s(F.col("l_quantity").cast("int"))).alias("value"))
    return X.read_iplane_text(head.unionByName(hop))


def hop_files(spark, sf):
    """Binary hop lists, 64 traces to a file: hop counts are those of the trace, round trips powers of two."""
    hexs = lambda c, w: F.lpad(F.hex(c.cast("bigint")), w, "0")
    swap = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    li = T.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    rtt = F.element_at(F.array(L("0000003F"), L("0000803F"), L("00000040")), (F.col("s") % 3 + 1).cast("int"))    # 0.5, 1, 2
    hop = F.concat(hexs(F.col("s") + ROUTER_BASE, 8), rtt, swap(hexs(F.col("q"), 8)))
    rec = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", hop.alias("h")))).alias("hops"))
    body = F.concat(hexs(F.col("l_orderkey") + T.DEST_BASE, 8), swap(hexs(F.size("hops"), 8)), F.array_join(F.transform("hops", lambda x: x["h"]), ""))
    f = rec.select(F.floor(F.col("l_orderkey") / 64).alias("f"), "l_orderkey", body.alias("b")).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "b"))).alias("r"))
    text = F.concat(swap(hexs(L(7), 8)), swap(hexs(L(9), 8)), swap(hexs(F.size("r"), 8)), swap(hexs(L(0), 8)), F.array_join(F.transform("r", lambda x: x["b"]), ""))
    cut = F.when(F.col("f") % 10 == 9, F.expr("substring(t, 1, length(t) - 8)")).otherwise(F.col("t"))      # some files are cut off
    return f.select(F.concat(L("f"), _s("f")).alias("file"), "f", text.alias("t")).select("file", F.unhex(cut).alias("content"))


_BIN = """WITH h AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT k, count(*) AS hops, k // 64 AS f, row_number() OVER (PARTITION BY k // 64 ORDER BY k) - 1 AS rec, row_number() OVER (PARTITION BY k // 64 ORDER BY k DESC) AS back FROM h GROUP BY k)"""


@query("read_iplane_binary", _BIN + f""" SELECT 'f' || f AS file, rec, k + {T.DEST_BASE} AS dest, CAST(hops AS INTEGER) AS n_hops, CAST(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS INTEGER) AS idx, s + {ROUTER_BASE} AS ip, [0.5, 1.0, 2.0][1 + s % 3] AS rtt, CAST(q AS BIGINT) AS ttl, false AS corrupt
  FROM h JOIN r USING (k) WHERE NOT (f % 10 = 9 AND back = 1) UNION ALL SELECT DISTINCT 'f' || f, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM r WHERE f % 10 = 9""")
def _(spark, sf):
    return B.decode_hop_files(hop_files(spark, sf))


@query("read_iplane_destinations", _BIN + f" SELECT 'f' || f AS file, rec, {sql_ip(f'k + {T.DEST_BASE}')} AS dest FROM r WHERE NOT (f % 10 = 9 AND back = 1)")
def _(spark, sf):
    return B.decode_destinations(hop_files(spark, sf))


@query("read_ipid_samples", f"SELECT {sql_ip(f'user_id + {ROUTER_BASE}')} AS ip, {sql_ip(f'user_id + {ROUTER_BASE}')} AS resp, CAST(event_id + 0.5 AS DOUBLE) AS t, CAST(event_id % 65536 AS INTEGER) AS id, 'Tcp' AS kind FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    ip = _ip(F.col("user_id") + ROUTER_BASE)
    v = F.when(F.col("event_type") == "error", F.concat(ip, L(" -  -  - - Tcp"))).otherwise(F.concat(ip, L("  "), ip, L(" "), _s("event_id"), L(".5 "), _s(F.col("event_id") % 65536), L(" 77 Tcp")))
    return X.read_ipid_samples(T.table(spark, sf, "events").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))


@query("read_slopes", f"SELECT {sql_ip(f'p_partkey + {ROUTER_BASE}')} AS ip, p_retailprice AS \"offset\", 0.5 AS offset_err, CAST(p_size + 0.25 AS DOUBLE) AS slope, 0.125 AS slope_err, p_partkey AS n FROM part")
def _(spark, sf):
    v = F.concat(_ip(F.col("p_partkey") + ROUTER_BASE), L(" off "), _s("p_retailprice"), L(" +/- 0.5 slope "), _s("p_size"), L(".25 +/- 0.125 0.01 n="), _s("p_partkey"))
    return X.read_slopes(T.table(spark, sf, "part").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))


@query("read_ttl_distance", f"""SELECT 'v' || l_linenumber AS vantage, {sql_ip(f'l_suppkey + {ROUTER_BASE}')} AS ip, CAST(l_quantity AS INTEGER) AS udp, '-' AS udpr, CAST(1.5 AS DOUBLE) AS udp_rtt, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 235 END AS tcp, CASE WHEN l_partkey % 4 = 1 THEN 'TCP_RST' ELSE '-' END AS tcpr, CAST(2.5 AS DOUBLE) AS tcp_rtt,
  -1 AS icmp, CASE WHEN l_partkey % 3 = 0 THEN 'ICMP_U_1' ELSE '-' END AS icmpr, CAST(NULL AS DOUBLE) AS icmp_rtt FROM lineitem""")
def _(spark, sf):
    k = F.col("l_partkey")
    v = F.concat(_ip(F.col("l_suppkey") + ROUTER_BASE), L("      Udp "), _s(F.col("l_quantity").cast("int")), L(" 1.5 1.6 Tcp "), F.when(k % 4 == 0, "-").when(k % 4 == 1, "235:TCP_RST").otherwise("235"),
                 L(" 2.5 2.6 Icmp "), F.when(k % 3 == 0, "-1:ICMP_U_1").otherwise("-1"), L(" - -"))
    return X.read_ttl_distance(T.table(spark, sf, "lineitem").select(F.concat(L("v"), _s("l_linenumber")).alias("file"), L(0).alias("pos"), v.alias("value")), F.col("file"))


@query("read_show_interfaces", f"SELECT 'r' || p_partkey // 50 AS router, CASE WHEN p_partkey % 2 = 0 THEN 'so-0/0/' || p_partkey ELSE 'ge-1.' || p_partkey END AS iface, {sql_ip(f'p_partkey * 4 + {ROUTER_BASE}')} AS ip, CAST(24 + p_size % 8 AS INTEGER) AS len, true AS up FROM part")
def _(spark, sf):
    ip, n, even = _ip(F.col("p_partkey") * 4 + ROUTER_BASE), _s(24 + F.col("p_size") % 8), F.col("p_partkey") % 2 == 0
    head = F.when(even, F.concat(L("so-0/0/"), _s("p_partkey"), L(" is Up, line protocol is Up"))).otherwise(F.concat(L("  Logical interface ge-1."), _s("p_partkey"), L(" (Index 70) (SNMP)")))
    addr = F.when(even, F.concat(L("<br>&nbsp; Internet address is "), ip, L("/"), n)).otherwise(F.concat(L("    Destination: 10.1.2/"), n, L(", Local: "), ip))
    d = T.table(spark, sf, "part").select(F.concat(L("/d/Out=r"), _s(F.floor(F.col("p_partkey") / 50))).alias("file"), "p_partkey", F.posexplode(F.array(head, L("  MTU 4470 bytes"), addr)).alias("q", "value"))
    return X.read_show_interfaces(d.select("file", F.struct("p_partkey", "q").alias("pos"), "value"))


_XML = """`interface-information` array<struct<`physical-interface`: array<struct<name: string, `oper-status`: string, `logical-interface`: array<struct<name: string, `address-family`: array<struct<`interface-address`: array<struct<`ifa-local`: string, `ifa-destination`: string>>>>>>>>>>"""


@query("read_interfaces_xml", f"SELECT 'r' || p_partkey AS router, 'so-' || p_size AS iface, {sql_ip(f'p_partkey + {ROUTER_BASE}')} AS ip, 30 AS len, true AS up FROM part WHERE p_size % 3 <> 0")
def _(spark, sf):
    v = F.concat(L('<router><interface-information><physical-interface><name>so-'), _s("p_size"), L("</name><oper-status>"), F.when(F.col("p_size") % 3 == 0, "down").otherwise("up"),
                 L("</oper-status><logical-interface><name>x.0</name><address-family><interface-address><ifa-destination>10.0.0.0/30</ifa-destination><ifa-local>"), _ip(F.col("p_partkey") + ROUTER_BASE),
                 L("</ifa-local></interface-address></address-family></logical-interface></physical-interface><physical-interface><name>dsc</name><oper-status>up</oper-status></physical-interface></interface-information></router>"))
    d = T.table(spark, sf, "part").select(F.concat(L("r"), _s("p_partkey")).alias("_name"), F.from_xml(v, _XML).alias("x"))
    return X.interfaces_from_xml(d.select("_name", F.col("x")["interface-information"].alias("interface-information")))


@query("read_bgp_table", "SELECT (64 * 16777216 + o_orderkey * 256) AS net, 24 AS len, CAST(l_suppkey AS VARCHAR) AS asn, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL UNION ALL SELECT (64 * 16777216 + o_orderkey * 256), 24, 'C' || o_custkey, 1 FROM orders")
def _(spark, sf):
    z = L(0).cast("bigint")
    file = lambda c: F.concat(L("rv"), _s(F.col(c) % 3)).alias("file")
    row = lambda net, path: F.concat(L("*> "), F.rpad(net, 17, " "), F.rpad(L("4.0.4.90"), 20, " "), F.rpad(L("0"), 21, " "), path)
    heading = spark.range(3).select(F.concat(L("rv"), _s("id")).alias("file"), F.struct(L(-1).cast("bigint").alias("a"), z.alias("b"), z.alias("c")).alias("pos"),
                                    F.concat(L("   "), F.rpad(L("Network"), 17, " "), F.rpad(L("Next Hop"), 20, " "), F.rpad(L("Metric LocPrf Weight"), 21, " "), L("Path")).alias("value"))
    net = F.concat(_ip(F.col("o_orderkey") * 256 + 64 * 16777216), L("/24"))
    o = T.table(spark, sf, "orders").select(file("o_orderkey"), F.struct(F.col("o_orderkey").alias("a"), z.alias("b"), z.alias("c")).alias("pos"), row(net, F.concat(L("3356 701 C"), _s("o_custkey"), L(" i"))).alias("value"))
    li = T.table(spark, sf, "lineitem").select(file("l_orderkey"), F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"), F.monotonically_increasing_id().alias("c")).alias("pos"),
                                               row(L(""), F.concat(L("1299 "), _s("l_suppkey"), L(" i"))).alias("value"))
    return X.read_bgp_table(heading.unionByName(o).unionByName(li)).groupBy("net", "len", "asn").agg(F.count(L(1)).alias("n"))


@query("read_prefix_filter", f"SELECT ((p_partkey * 1024 + {ROUTER_BASE}) >> 8) << 8 AS net, 24 AS len, CAST([7, 1, 2, 4, 7][1 + p_partkey % 5] AS INTEGER) AS bits, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY ALL")
def _(spark, sf):
    word = F.element_at(F.array(*[L(x) for x in (" ip", " tcp", " 2", " icmp", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    v = F.concat(F.when(F.col("p_size") % 4 == 0, "# ").otherwise(""), _ip(F.col("p_partkey") * 1024 + 3 + ROUTER_BASE), L("/24"), word, L(" # reason"))
    d = X.read_prefix_filter(T.table(spark, sf, "part").select(L("f").alias("file"), L(0).alias("pos"), v.alias("value")))
    return d.groupBy("net", "len", "bits").agg(F.count(L(1)).alias("n"))
