"""Registered queries: prefixes, loops, stop lists, ranks and samples."""

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import routing as R
from . import tables as T
from .registry import query
from .tables import DEST_BASE, ROUTER_BASE, SOURCE_BASE, SQL

_PFX = f"""pf AS (SELECT ((({ROUTER_BASE} + p_partkey * 3) >> (4 + p_partkey % 9)::INT) << (4 + p_partkey % 9)::INT) AS net, CAST(28 - p_partkey % 9 AS INTEGER) AS len, CAST(100 + p_partkey % 50 AS VARCHAR) AS asn FROM part),
 pf1 AS (SELECT net, len, min(asn) AS asn FROM pf GROUP BY 1, 2), pip AS (SELECT p_partkey * 3 + 7 + {ROUTER_BASE} AS ip FROM part),
 hit AS (SELECT ip, asn, len, row_number() OVER (PARTITION BY ip ORDER BY len DESC) AS i FROM pip JOIN pf1 ON ip >> (32 - len) = net >> (32 - len))"""


def _prefixes(spark, sf):
    k = F.col("p_partkey")
    bits = (4 + k % 9).cast("int")
    net = F.call_function("shiftleft", F.call_function("shiftright", ROUTER_BASE + k * 3, bits), bits)
    return T.table(spark, sf, "part").select(
        net.alias("net"), (28 - k % 9).cast("int").alias("len"), (100 + k % 50).cast("string").alias("asn"))


def _ips(spark, sf):
    return T.table(spark, sf, "part").select((F.col("p_partkey") * 3 + 7 + ROUTER_BASE).alias("ip"))


@query("ip_to_asn", "WITH " + _PFX + " SELECT ip, asn, len FROM hit WHERE i = 1")
def _(spark, sf):
    return R.ip_to_asn(_ips(spark, sf), _prefixes(spark, sf))


_BL = "WITH " + _PFX + ", bits AS (SELECT ip, CAST(bit_or(CASE WHEN len > 26 THEN [7, 1, 2, 4][1 + CAST(asn AS INTEGER) % 4] ELSE 1 END) AS INTEGER) AS bits FROM pip JOIN pf ON ip >> (32 - len) = net >> (32 - len) GROUP BY ip)"


def _black(spark, sf):
    """Codes of all prefixes: wide ones have a bit that ``filter_blacklist`` does not ask for."""
    bits = F.when(F.col("len") > 26, F.element_at(F.array(*[F.lit(b) for b in (7, 1, 2, 4)]), F.col("asn").cast("int") % 4 + 1)).otherwise(1)
    return _prefixes(spark, sf).select("net", "len", bits.alias("bits"))


@query("filter_codes", _BL + " SELECT * FROM bits")
def _(spark, sf):
    return R.filter_codes(_ips(spark, sf), _black(spark, sf))


@query("filter_blacklist", _BL + " SELECT ip FROM pip WHERE ip NOT IN (SELECT ip FROM bits WHERE bits & 6 <> 0)")
def _(spark, sf):
    return R.filter_blacklist(_ips(spark, sf), _black(spark, sf), bits=6)


_LP = "WITH " + SQL["tr"] + ", lp AS (SELECT DISTINCT src, dst FROM trp WHERE dst % 3 = 0)"


def _loops(spark, sf):
    return T.tr_probes(spark, sf).where("dst % 3 = 0").select("src", "dst").distinct()


def _tr6(spark, sf):
    """Plain answers with the responder taken modulo six, so that addresses repeat inside a trace."""
    return T.tr_probes(spark, sf).withColumn("resp", F.col("resp") % 6 + ROUTER_BASE)


_LR = _LP + f", lr AS (SELECT ip, count(*) AS traces FROM (SELECT src, dst, resp % 6 + {ROUTER_BASE} AS ip FROM trp WHERE (src, dst) IN (SELECT (src, dst) FROM lp) GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY ip)"


@query("loop_routers", _LR + " SELECT * FROM lr")
def _(spark, sf):
    return R.loop_routers(_tr6(spark, sf), _loops(spark, sf))


@query("loop_routers_by_as", _LR + f" SELECT CASE WHEN ip - {ROUTER_BASE} < 4 THEN 'A' || (ip % 2) ELSE '0' END AS asn, CAST(sum(traces) AS BIGINT) AS traces, count(*) AS routers FROM lr GROUP BY 1")
def _(spark, sf):
    lr = R.loop_routers(_tr6(spark, sf), _loops(spark, sf))
    asn = lr.where(F.col("ip") - ROUTER_BASE < 4).select("ip", F.concat(F.lit("A"), (F.col("ip") % 2).cast("string")).alias("asn"))
    return R.loop_routers_by_as(lr, asn)


@query("loop_ends", _LP + """ SELECT 'src' AS side, (src >> 24) || '.' || ((src >> 16) & 255) AS subnet, count(*) AS n FROM lp GROUP BY 1, 2 UNION ALL SELECT 'dst', (dst >> 24) || '.' || ((dst >> 16) & 255), count(*) FROM lp GROUP BY 1, 2""")
def _(spark, sf):
    return R.loop_ends(_loops(spark, sf))


@query("route_loops", "SELECT l_orderkey AS trace, pos, back FROM (SELECT l_orderkey, (l_linenumber, l_partkey) AS p, l_linenumber * 10000000 + l_partkey AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000 + l_partkey DESC) AS back FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE back <= 3")
def _(spark, sf):
    states = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace"), F.when(F.col("o_orderstatus") == "F", 109).otherwise(0).alias("state"))
    lines = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trace"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"))
    return R.route_loops(states, lines, last=3)


@query("disjoint_path_summary", """WITH d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey) SELECT CAST(n AS DOUBLE) AS value, (SELECT count(*) FROM d x WHERE x.n <= d.n) / (SELECT count(*) FROM d) AS p, (SELECT avg(n) FROM d) AS average FROM d GROUP BY n""")
def _(spark, sf):
    d = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("a"), F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey")).otherwise(-1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return R.disjoint_path_summary(d)


_SL = "WITH " + SQL["rr"] + """, hp AS (SELECT src, dst, ttl, resp, qty % 2 AS it, rr FROM rrp), en AS (SELECT src, dst, min(ttl) AS e FROM hp WHERE resp = dst GROUP BY 1, 2),
 sl AS (SELECT hp.src, hp.dst, e - ttl - 1 AS pos, min(resp) AS ip FROM hp JOIN en USING (src, dst) WHERE resp <> hp.dst AND e - ttl - 1 BETWEEN 0 AND 2 GROUP BY ALL)"""


def _hp(spark, sf):
    return T.rr_probes(spark, sf).select("src", "dst", "ttl", "resp", (F.col("qty") % 2).alias("it"), "rr")


@query("stop_list", _SL + " SELECT * FROM sl")
def _(spark, sf):
    return R.stop_list(_hp(spark, sf))


@query("stop_at_stoplist", _SL + """, ct AS (SELECT src, dst, it, min(ttl) AS s FROM hp WHERE (src, dst, resp) IN (SELECT (src, dst, ip) FROM sl) OR (it = 1 AND len(rr) >= 9) GROUP BY 1, 2, 3)
  SELECT src, dst, it, ttl, resp FROM hp LEFT JOIN ct USING (src, dst, it) WHERE s IS NULL OR ttl <= s""")
def _(spark, sf):
    h = _hp(spark, sf)
    return R.stop_at_stoplist(h, R.stop_list(h)).select("src", "dst", "it", "ttl", "resp")


@query("trace_inventory", """SELECT CASE WHEN o_custkey % 11 = 0 THEN 'bad_source' WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_totalprice < 5000 THEN 'small' WHEN o_orderstatus = 'F' THEN 'loop' ELSE 'good' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    o = T.table(spark, sf, "orders").withColumn("src", F.col("o_custkey")).withColumn("dst", F.col("o_orderkey"))
    files = o.where("dst % 7 <> 0").select("src", "dst", F.when(F.col("o_totalprice") < 5000, 5).otherwise(500).alias("size"), F.when(F.col("o_orderstatus") == "F", 109).otherwise(1).alias("state"))
    return R.trace_inventory(o.select("src", "dst"), o.where("src % 11 = 0").select("src"), files)


@query("cdf", "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) SELECT 0.0::DOUBLE AS value, 0.0::DOUBLE AS p UNION ALL SELECT v, i / n FROM s WHERE i % (CAST(floor(0.0001 * n) AS BIGINT) + 1) = 0")
def _(spark, sf):
    return K.cdf(T.table(spark, sf, "orders"), "o_totalprice")


@query("ccdf", "WITH s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem) SELECT 0.0::DOUBLE AS value, 1.0::DOUBLE AS p UNION ALL SELECT v, 1 - i / n FROM s WHERE i % (CAST(floor(0.0001 * n) AS BIGINT) + 1) = 0")
def _(spark, sf):
    return K.ccdf(T.table(spark, sf, "lineitem"), "l_quantity")


@query("rank_curve", "SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) / count(*) OVER () AS fraction FROM events")
def _(spark, sf):
    return K.rank_curve(T.table(spark, sf, "events"), "value", ["event_id"])


@query("batch_rows", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders")
def _(spark, sf):
    return K.batch_rows(T.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("random_shuffle", "SELECT p_partkey FROM part")
def _(spark, sf):
    return K.random_shuffle(T.table(spark, sf, "part").select("p_partkey"), 7)


@query("sample_n", "SELECT p_partkey FROM part ORDER BY sha256(CAST(p_partkey AS VARCHAR) || ':3') LIMIT 50")
def _(spark, sf):
    return K.sample_n(T.table(spark, sf, "part").select("p_partkey"), 50, F.col("p_partkey"), 3)


@query("one_per_prefix", f"SELECT (ip >> 8) << 8 AS net, min(ip) AS ip FROM (SELECT p_partkey * 3 + {ROUTER_BASE} AS ip FROM part) GROUP BY 1")
def _(spark, sf):
    return K.one_per_prefix(T.table(spark, sf, "part").select((F.col("p_partkey") * 3 + ROUTER_BASE).alias("ip")), "ip")


@query("n_combinations", "WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem) SELECT a.k AS l_orderkey, a.n AS i1, b.n AS i2, c.n AS i3 FROM d a JOIN d b ON a.k = b.k AND a.n < b.n JOIN d c ON b.k = c.k AND b.n < c.n")
def _(spark, sf):
    return K.n_combinations(T.table(spark, sf, "lineitem"), "l_linenumber", 3, ["l_orderkey"])
