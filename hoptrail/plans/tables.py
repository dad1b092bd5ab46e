"""Views that project the driver's tables onto the measurement model, each with its SQL twin.

Addresses: routers 10.x from supplier keys, sources 172.16.x from customer keys, destinations 192.168.x from order
keys. All views read whole tables; no view keeps a group-sized structure that grows with the data: a trace's hop list
is cut to nine entries per TTL before it is built, because a record list holds nine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.probe import router_clock_ms

ROUTER_BASE = 167772160    # 10.0.0.0
SOURCE_BASE = 2886729728   # 172.16.0.0
DEST_BASE = 3232235520     # 192.168.0.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the driver's tables; its zoneless timestamps are read as instants in the session time zone (UTC)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def _base(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("spoofed", F.col("l_tax") == 0.08)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .select(
            F.col("l_orderkey").alias("trace"),
            (F.col("o_custkey") + SOURCE_BASE).alias("src"),
            (F.col("l_orderkey") + DEST_BASE).alias("dst"),
            F.col("l_linenumber").cast("int").alias("ttl"),
            F.when(F.col("spoofed"), F.col("l_orderkey") + DEST_BASE)
            .otherwise(F.col("l_suppkey") + ROUTER_BASE).alias("resp"),
            (F.col("l_suppkey") + ROUTER_BASE).alias("tr_resp"),
            F.col("l_partkey").alias("part"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_shipdate").alias("t"),
        )
    )


def tr_probes(spark, sf) -> DataFrame:
    """Plain probes: src, dst, ttl, resp, t."""
    return (
        _base(spark, sf).where("status = 'F' OR flag = 'R'")
        .select("trace", "src", "dst", "ttl", F.col("tr_resp").alias("resp"), "t", "qty")
    )


def recorded_hops(spark, sf) -> DataFrame:
    """(trace, hops): array of (ttl, key, ip) a record option could hold, nine per TTL at most."""
    li = table(spark, sf, "lineitem").where((F.col("l_orderkey") + F.col("l_partkey")) % 4 != 0)
    # dealt out by trace once, for the steps below and the join with the probes
    hops = li.select(
        F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("int").alias("ttl"), F.col("l_partkey").alias("part")
    ).repartition("trace").distinct()
    w = W.partitionBy("trace", "ttl").orderBy("part")
    hops = hops.withColumn("n", F.row_number().over(w)).where("n <= 9")
    ip = (F.floor(F.col("part") / 20) + ROUTER_BASE).cast("bigint").alias("ip")
    return hops.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("ttl", "part", ip))).alias("hops"))


def rr_probes(spark, sf) -> DataFrame:
    """Record-route probes: src, dst, ttl, resp, rr (oldest first, at most nine)."""
    p = _base(spark, sf).where("flag <> 'R'")
    j = p.join(recorded_hops(spark, sf), "trace", "left")
    earlier = F.filter("hops", lambda h: h["ttl"] < F.col("ttl"))
    rr = F.coalesce(F.transform(F.slice(earlier, 1, 9), lambda h: h["ip"]), F.array().cast("array<bigint>"))
    return j.select("trace", "src", "dst", "ttl", "resp", rr.alias("rr"), "t", "part", "qty")


def probes(spark, sf) -> DataFrame:
    """Both kinds in one table; ``rr`` is null for plain probes."""
    tr = tr_probes(spark, sf).withColumn("rr", F.lit(None).cast("array<bigint>"))
    cols = ["src", "dst", "ttl", "resp", "rr"]
    return rr_probes(spark, sf).select(cols).unionByName(tr.select(cols))


def ipid_samples(spark, sf) -> DataFrame:
    """Counter samples per address, one per point in time."""
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") + ROUTER_BASE).alias("ip"),
        ((F.unix_micros("ts") - 1704067200000000) / 1e6).alias("t"),
        F.pmod(F.col("event_id") * 40, F.lit(65536)).alias("id"),
    )


def rtt_samples(spark, sf) -> DataFrame:
    """Round-trip samples in microseconds per connection (user), ordered by (ts, event_id)."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("conn"), "ts", F.col("event_id").alias("seq"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("rtt"), "event_type",
    )


def stamps(spark, sf) -> DataFrame:
    """Probes with one to four router clock stamps, in milliseconds since midnight."""
    return stamps_of(table(spark, sf, "events"))


def stamps_of(e: DataFrame) -> DataFrame:
    ms = router_clock_ms("ts")
    n = F.col("event_id") % 4 + 1
    arr = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: (ms + 5 * i + F.floor(F.col("value") * i) % 17).cast("bigint"))
    recv = F.timestamp_micros(F.unix_micros("ts") + 40000 + F.floor(F.col("value") * 1000).cast("bigint"))
    return e.select(F.col("user_id").alias("conn"), F.col("event_id").alias("probe"), F.col("ts").alias("sent"), recv.alias("recv"), arr.alias("stamps"))


def ttl_distance(spark, sf) -> DataFrame:
    """Reply TTLs per vantage and address."""
    p = _base(spark, sf)
    q = F.col("qty")
    return p.select(
        F.concat(F.lit("v"), F.pmod(F.col("src") - SOURCE_BASE, F.lit(25)).cast("string")).alias("vantage"),
        F.col("tr_resp").alias("ip"),
        F.when(q % 3 == 0, -1).otherwise(q + 192).alias("udp"),
        F.when(q % 7 == 0, "TCP").otherwise("-").alias("udpr"),
        F.when(q % 2 == 0, q + 64).otherwise(-1).alias("tcp"), F.lit("-").alias("tcpr"),
        F.when(q % 5 == 0, q).otherwise(-2).alias("icmp"),
        F.when(q % 11 == 0, "ICMP_U_1").otherwise("-").alias("icmpr"),
        F.col("t").alias("ts"), F.col("trace"), F.col("part"),
    )


def alias_pairs_small(spark, sf) -> DataFrame:
    """Alias evidence as chains: neighbours inside blocks of eight suppliers."""
    s = table(spark, sf, "supplier")
    return s.where(F.col("s_suppkey") % 8 != 0).select(
        (F.col("s_suppkey") - 1 + ROUTER_BASE).alias("ip1"), (F.col("s_suppkey") + ROUTER_BASE).alias("ip2"),
        F.concat(F.lit("src"), (F.col("s_nationkey") % 3).cast("string")).alias("source"),
    )


def routers_true(spark, sf) -> DataFrame:
    """Ground truth: blocks of four addresses make one router."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("T"), F.floor(F.col("s_suppkey") / 4).cast("string")).alias("router"),
        (F.col("s_suppkey") + ROUTER_BASE).alias("ip"),
    )


def routers_observed(spark, sf) -> DataFrame:
    """Observed graph: blocks of three, so some true routers are split and some merged; one in seven unseen."""
    s = table(spark, sf, "supplier").where(F.col("s_nationkey") % 7 != 3)
    return s.select(
        F.concat(F.lit("R"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("router"),
        (F.col("s_suppkey") + ROUTER_BASE).alias("ip"),
    )


def graph_links(spark, sf, which: str = "all") -> DataFrame:
    """Sparse graph over supplier addresses: each links to one to three addresses after it."""
    li = table(spark, sf, "lineitem")
    step = F.col("l_partkey") % 3
    if which == "observed":
        li = li.where(F.col("l_suppkey") % 5 != 0)
    if which == "truth":
        li = li.where((F.col("l_suppkey") + step) % 7 != 0)
    return li.select(
        (F.col("l_suppkey") + ROUTER_BASE).alias("ip1"), (F.col("l_suppkey") + 1 + step + ROUTER_BASE).alias("ip2"),
        (1 + (F.col("l_suppkey") * 7 + step) % 4).cast("int").alias("link_type"),
    ).distinct()


def model_facts(spark, sf) -> DataFrame:
    """Solved facts of many models, one model per trace: links, aliases, refuted aliases, tags and types."""
    b = _base(spark, sf)
    li = b.withColumn("key", F.col("tr_resp") - ROUTER_BASE).withColumn("step", F.col("part") % 3)
    pair = F.col("tr_resp") + 1 + F.col("step")
    n, q = F.col("ttl"), F.col("qty")
    tag = F.element_at(F.array(*[F.lit(x) for x in ("rrend", "mpls", "lazy", "source")]), q % 4 + 1)
    src = F.element_at(F.array(*[F.lit(x) for x in ("name", "mercatorsource", "ally")]), q % 3 + 1)
    pred = (
        F.when(n <= 3, "link").when((n == 4) & ((F.col("key") + F.col("step")) % 6 == 0), "alias")
        .when(n == 4, "badAlias").when(n == 5, "-alias").when(n == 6, "other").otherwise("type"))
    a3 = (
        F.when(n <= 3, (1 + (F.col("key") * 7 + F.col("step") + q % 2) % 4).cast("string")).when(n <= 5, src)
        .when(n == 6, tag).otherwise(F.when(q % 2 == 0, "a").otherwise("n")))
    return li.select(
        F.concat(F.lit("clique-"), (F.col("src") - SOURCE_BASE).cast("string"), F.lit("-"), F.col("trace").cast("string")).alias("model"),
        pred.alias("pred"), F.col("tr_resp").alias("a1"), F.when(n <= 5, pair).alias("a2"), a3.alias("a3"))


SQL = {}
_LK = """(SELECT DISTINCT l_suppkey + {b} AS ip1, l_suppkey + 1 + l_partkey % 3 + {b} AS ip2,
  CAST(1 + (l_suppkey * 7 + l_partkey % 3) % 4 AS INTEGER) AS link_type FROM lineitem {w})"""
SQL["links"] = "lk AS " + _LK.format(b=ROUTER_BASE, w="")
SQL["links_observed"] = "lo AS " + _LK.format(b=ROUTER_BASE, w="WHERE l_suppkey % 5 <> 0")
SQL["links_truth"] = "lt AS " + _LK.format(b=ROUTER_BASE, w="WHERE (l_suppkey + l_partkey % 3) % 7 <> 0")
SQL["base"] = f"""base AS (
  SELECT l_orderkey AS trace, o_custkey + {SOURCE_BASE} AS src, l_orderkey + {DEST_BASE} AS dst,
         CAST(l_linenumber AS INTEGER) AS ttl,
         CASE WHEN l_tax = 0.08 THEN l_orderkey + {DEST_BASE} ELSE l_suppkey + {ROUTER_BASE} END AS resp,
         l_suppkey + {ROUTER_BASE} AS tr_resp, l_partkey AS part, l_returnflag AS flag, l_linestatus AS status,
         CAST(l_quantity AS INTEGER) AS qty, l_shipdate AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL["tr"] = SQL["base"] + """, trp AS (
  SELECT trace, src, dst, ttl, tr_resp AS resp, t, qty FROM base WHERE status = 'F' OR flag = 'R')"""
SQL["rr"] = SQL["tr"] + f""", hop0 AS (
  SELECT DISTINCT l_orderkey AS trace, l_linenumber AS ttl, l_partkey AS part FROM lineitem WHERE (l_orderkey + l_partkey) % 4 <> 0),
hop1 AS (SELECT trace, list({{'t': ttl, 'p': part}} ORDER BY ttl, part) AS hops FROM
  (SELECT *, row_number() OVER (PARTITION BY trace, ttl ORDER BY part) AS n FROM hop0) WHERE n <= 9 GROUP BY trace),
rrp AS (
  SELECT b.trace, src, dst, b.ttl, resp,
         coalesce(list_transform(list_filter(hops, lambda h: h.t < b.ttl)[1:9],
                  lambda h: CAST(floor(h.p / 20.0) AS BIGINT) + {ROUTER_BASE}), CAST([] AS BIGINT[])) AS rr, t, part, qty
  FROM base b LEFT JOIN hop1 USING (trace) WHERE flag <> 'R')"""
SQL["probes"] = SQL["rr"] + """, probes AS (
  SELECT src, dst, ttl, resp, rr FROM rrp UNION ALL SELECT src, dst, ttl, resp, NULL FROM trp)"""
SQL["ipid"] = f"""ipid AS (
  SELECT user_id + {ROUTER_BASE} AS ip, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, (event_id * 40) % 65536 AS id FROM events)"""
SQL["rtt"] = """rtts AS (
  SELECT user_id AS conn, ts, event_id AS seq, CAST(floor(value * 1000) AS BIGINT) AS rtt, event_type FROM events)"""
SQL["stamps"] = """st0 AS (SELECT user_id AS conn, event_id AS probe, epoch_us(ts) AS s, epoch_us(ts) + 40000 + CAST(floor(value * 1000) AS BIGINT) AS r, value, event_id % 4 + 1 AS n FROM events),
 st AS (SELECT *, (s % 86400000000) // 1000 + CASE WHEN s % 1000 > 500 THEN 1 ELSE 0 END AS sms, (r % 86400000000) // 1000 + CASE WHEN r % 1000 > 500 THEN 1 ELSE 0 END AS rms FROM st0),
 stamp AS (SELECT conn, probe, s, sms, rms, n, CAST(i AS BIGINT) AS i, sms + 5 * i + CAST(floor(value * i) AS BIGINT) % 17 AS v FROM st, range(1, 5) x(i) WHERE i <= n)"""
SQL["ttl"] = SQL["base"] + f""", ttld AS (
  SELECT 'v' || CAST((src - {SOURCE_BASE}) % 25 AS VARCHAR) AS vantage, tr_resp AS ip,
    CASE WHEN qty % 3 = 0 THEN -1 ELSE qty + 192 END AS udp, CASE WHEN qty % 7 = 0 THEN 'TCP' ELSE '-' END AS udpr,
    CASE WHEN qty % 2 = 0 THEN qty + 64 ELSE -1 END AS tcp, '-' AS tcpr,
    CASE WHEN qty % 5 = 0 THEN qty ELSE -2 END AS icmp, CASE WHEN qty % 11 = 0 THEN 'ICMP_U_1' ELSE '-' END AS icmpr,
    t AS ts, trace, part FROM base)"""
SQL["aliases"] = f"""al AS (
  SELECT s_suppkey - 1 + {ROUTER_BASE} AS ip1, s_suppkey + {ROUTER_BASE} AS ip2,
         'src' || CAST(s_nationkey % 3 AS VARCHAR) AS source FROM supplier WHERE s_suppkey % 8 <> 0)"""
SQL["truth"] = f"""truth AS (
  SELECT 'T' || CAST(s_suppkey // 4 AS VARCHAR) AS router, s_suppkey + {ROUTER_BASE} AS ip FROM supplier)"""
SQL["observed"] = f"""observed AS (
  SELECT 'R' || CAST(s_suppkey // 3 AS VARCHAR) AS router, s_suppkey + {ROUTER_BASE} AS ip
  FROM supplier WHERE s_nationkey % 7 <> 3)"""


def sql_ip(expr: str) -> str:
    """SQL text that prints an integer address as a dotted quad."""
    o = lambda s: f"CAST((({expr}) >> {s}) & 255 AS VARCHAR)"
    return f"({o(24)} || '.' || {o(16)} || '.' || {o(8)} || '.' || {o(0)})"
SQL["facts"] = SQL["base"] + f""", mf AS (SELECT 'clique-' || CAST(src - {SOURCE_BASE} AS VARCHAR) || '-' || CAST(trace AS VARCHAR) AS model,
  CASE WHEN ttl <= 3 THEN 'link' WHEN ttl = 4 AND (tr_resp - {ROUTER_BASE} + part % 3) % 6 = 0 THEN 'alias' WHEN ttl = 4 THEN 'badAlias' WHEN ttl = 5 THEN '-alias' WHEN ttl = 6 THEN 'other' ELSE 'type' END AS pred,
  tr_resp AS a1, CASE WHEN ttl <= 5 THEN tr_resp + 1 + part % 3 END AS a2,
  CASE WHEN ttl <= 3 THEN CAST(1 + ((tr_resp - {ROUTER_BASE}) * 7 + part % 3 + qty % 2) % 4 AS VARCHAR) WHEN ttl <= 5 THEN ['name', 'mercatorsource', 'ally'][qty % 3 + 1]
    WHEN ttl = 6 THEN ['rrend', 'mpls', 'lazy', 'source'][qty % 4 + 1] WHEN qty % 2 = 0 THEN 'a' ELSE 'n' END AS a3 FROM base)"""
