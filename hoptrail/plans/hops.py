"""Registered queries: operators along traces."""

from pyspark.sql import functions as F

from ..operators import hops as H
from ..operators import addresses as A
from . import tables as T
from .registry import query
from .tables import DEST_BASE, ROUTER_BASE, SOURCE_BASE, SQL

TR, RR, PR = "WITH " + SQL["tr"], "WITH " + SQL["rr"], "WITH " + SQL["probes"]
_H = TR + ", h AS (SELECT DISTINCT src, dst, ttl, resp FROM trp)"
_S = "coalesce(array_to_string(rr, ' '), '-')"


def _rrs(df):
    """Record lists as text, so results compare as plain values."""
    return df.withColumn("rr", F.coalesce(F.array_join(F.col("rr").cast("array<string>"), " "), F.lit("-")))


@query("scan_traces", PR + f" SELECT src, dst, ttl, resp, {_S} AS rr FROM probes WHERE src < {SOURCE_BASE + 40} AND ttl <= 3")
def _(spark, sf):
    return _rrs(H.scan_traces(T.probes(spark, sf), f"src < {SOURCE_BASE + 40} AND ttl <= 3"))


@query("add_source_hop", PR + """ SELECT ttl, rr IS NULL AS plain, count(*) AS n FROM (SELECT src, dst, ttl, resp, rr FROM probes
  UNION ALL SELECT DISTINCT src, dst, 0, src, NULL FROM probes UNION ALL SELECT DISTINCT src, dst, 0, src, CAST([] AS BIGINT[]) FROM probes) GROUP BY ALL""")
def _(spark, sf):
    return H.add_source_hop(T.probes(spark, sf)).groupBy("ttl", F.isnull("rr").alias("plain")).agg(F.count(F.lit(1)).alias("n"))


@query("tr_links", _H + " SELECT DISTINCT a.resp AS ip1, b.resp AS ip2, 3 AS link_type FROM h a JOIN h b ON a.src = b.src AND a.dst = b.dst AND a.ttl + 1 = b.ttl AND a.resp <> b.resp")
def _(spark, sf):
    return H.tr_links(T.tr_probes(spark, sf))


@query("tr_self_links", _H + " SELECT DISTINCT a.resp AS ip, 'selflink' AS tag FROM h a JOIN h b ON a.src = b.src AND a.dst = b.dst AND a.ttl + 1 = b.ttl AND a.resp = b.resp")
def _(spark, sf):
    return H.tr_self_links(T.tr_probes(spark, sf))


@query("tr_links_sequential", _H + """, l AS (SELECT *, lag(ttl) OVER w AS pttl, lag(resp) OVER w AS presp FROM h WINDOW w AS (PARTITION BY src, dst ORDER BY ttl, resp))
  SELECT DISTINCT CASE WHEN pttl IS NULL THEN src ELSE presp END AS ip1, resp AS ip2, 3 AS link_type FROM l WHERE (pttl IS NULL AND ttl = 1) OR pttl = ttl - 1""")
def _(spark, sf):
    return H.tr_links_sequential(T.tr_probes(spark, sf))


@query("hop_chain_links", TR + f""", c AS (SELECT trace, src, ttl AS idx, min(CASE WHEN qty % 10 = 0 THEN 0 ELSE resp END) AS ip FROM trp GROUP BY ALL),
  l AS (SELECT c.*, coalesce(p.ip, CASE WHEN f.m = c.idx THEN c.src END) AS prev FROM c LEFT JOIN c p ON c.trace = p.trace AND c.idx = p.idx + 1
        JOIN (SELECT trace, min(idx) AS m FROM c GROUP BY trace) f ON f.trace = c.trace)
  SELECT DISTINCT least(ip, prev) AS ip1, greatest(ip, prev) AS ip2, 3 AS link_type FROM l WHERE ip <> 0 AND prev <> 0""")
def _(spark, sf):
    ip = F.when(F.col("qty") % 10 == 0, F.lit(0)).otherwise(F.col("resp"))
    hops = T.tr_probes(spark, sf).groupBy("trace", "src", F.col("ttl").alias("idx")).agg(F.min(ip).alias("ip"))
    return H.hop_chain_links(hops)


@query("tr_gap", _H + """, n AS (SELECT src, dst, ttl, lead(ttl) OVER (PARTITION BY src, dst ORDER BY ttl) AS next_ttl FROM (SELECT DISTINCT src, dst, ttl FROM h))
  SELECT src, dst, ttl, resp, next_ttl, next_ttl - ttl AS gap FROM h JOIN n USING (src, dst, ttl) WHERE next_ttl > ttl + 1""")
def _(spark, sf):
    return H.tr_gap(T.tr_probes(spark, sf))


@query("add_endhost_link", PR + """, r AS (SELECT src, dst, resp, row_number() OVER (PARTITION BY src, dst ORDER BY ttl DESC, resp) AS n FROM probes WHERE resp <> dst),
  t AS (SELECT DISTINCT src, dst FROM probes)
  SELECT DISTINCT coalesce(r.resp, t.src) AS ip1, t.dst AS ip2, 4 AS link_type FROM t LEFT JOIN r ON t.src = r.src AND t.dst = r.dst AND n = 1""")
def _(spark, sf):
    return H.add_endhost_link(T.probes(spark, sf))


@query("probe_counts", RR + f" SELECT src, ttl, resp, {_S} AS rr, count(*) AS n FROM rrp GROUP BY ALL")
def _(spark, sf):
    return _rrs(H.probe_counts(T.rr_probes(spark, sf)))


@query("probe_ids", PR + """ SELECT DISTINCT src, ttl, resp, CAST(src AS VARCHAR) || '_' || sha1(concat_ws('|', src, ttl, resp, coalesce(array_to_string(rr, ','), 'tr'))) AS id FROM probes""")
def _(spark, sf):
    return H.probe_ids(T.probes(spark, sf)).select("src", "ttl", "resp", "id")


@query("first_probe_wins", RR + """ SELECT src, dst, ttl, it, min_by(resp, (part, resp)) AS resp FROM (SELECT *, qty % 2 AS it FROM rrp) GROUP BY ALL""")
def _(spark, sf):
    p = T.rr_probes(spark, sf).withColumn("it", F.col("qty") % 2).select("src", "dst", "ttl", "it", "resp", F.struct("part", "resp").alias("line_no"))
    return H.first_probe_wins(p).select("src", "dst", "ttl", "it", "resp")


@query("route_change", _H + " SELECT src, dst, ttl, count(*) AS n_resp FROM h GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return H.route_change(T.tr_probes(spark, sf))


_VIS = PR + """, v AS (SELECT ip, bit_or(b) AS b FROM (SELECT resp AS ip, 1 AS b FROM probes UNION ALL SELECT unnest(rr), 2 FROM probes WHERE rr IS NOT NULL) GROUP BY ip),
  l AS (SELECT ip, CASE b WHEN 1 THEN 'T' WHEN 2 THEN 'R' ELSE 'B' END AS label FROM v)"""


@query("ip_visibility", _VIS + " SELECT ip, label FROM l")
def _(spark, sf):
    return H.ip_visibility(T.probes(spark, sf))


@query("visibility_totals", _VIS + """ SELECT count(*) AS total, count(*) FILTER (label <> 'R') AS n_tr, count(*) FILTER (label <> 'T') AS n_rr,
  count(*) FILTER (label = 'T') AS tr_only, count(*) FILTER (label = 'R') AS rr_only FROM l""")
def _(spark, sf):
    return H.visibility_totals(H.ip_visibility(T.probes(spark, sf)))


@query("merge_visibility", PR + """, v AS (SELECT ttl % 2 AS part, ip, bit_or(b) AS b FROM (SELECT ttl, resp AS ip, 1 AS b FROM probes UNION ALL SELECT ttl, unnest(rr), 2 FROM probes WHERE rr IS NOT NULL) GROUP BY ALL)
  SELECT ip, CASE bit_or(b) WHEN 1 THEN 'T' WHEN 2 THEN 'R' ELSE 'B' END AS label FROM v GROUP BY ip""")
def _(spark, sf):
    p = T.probes(spark, sf)
    a, b = H.ip_visibility(p.where("ttl % 2 = 0")), H.ip_visibility(p.where("ttl % 2 = 1"))
    return H.merge_visibility(a.unionByName(b))


@query("drops_rr", PR + " SELECT src, dst, ttl, count(*) AS n_tr FROM probes WHERE ttl < 10 GROUP BY ALL HAVING count(rr) = 0 AND count(*) >= 2")
def _(spark, sf):
    return H.drops_rr(T.probes(spark, sf), iterations=4)


@query("best_link", PR + """ SELECT src AS ip1, resp AS ip2, min(CASE WHEN rr IS NULL THEN 3 ELSE 1 END) AS link_type FROM probes GROUP BY ALL""")
def _(spark, sf):
    l = T.probes(spark, sf).select(F.col("src").alias("ip1"), F.col("resp").alias("ip2"), F.when(F.isnull("rr"), 3).otherwise(1).alias("link_type"))
    return H.best_link(l)


@query("distinct_ips", PR + " SELECT DISTINCT ip FROM (SELECT resp AS ip FROM probes UNION ALL SELECT src FROM probes UNION ALL SELECT dst FROM probes UNION ALL SELECT unnest(rr) FROM probes WHERE rr IS NOT NULL)")
def _(spark, sf):
    return A.distinct_ips(T.probes(spark, sf))


def _host_traces(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


_HT = "WITH ht AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders)"


@query("clique_traces", _HT + " SELECT src, dst FROM ht WHERE src IN (SELECT c_custkey FROM customer WHERE c_nationkey < 6) AND dst IN (SELECT c_custkey FROM customer WHERE c_nationkey < 6) AND src <> dst")
def _(spark, sf):
    ips = T.table(spark, sf, "customer").where("c_nationkey < 6").select(F.col("c_custkey").alias("ip"))
    return H.clique_traces(_host_traces(spark, sf), ips).select("src", "dst")


@query("enumerate_cliques", _HT + " SELECT DISTINCT least(src, dst) AS src1, greatest(src, dst) AS src2 FROM ht WHERE dst IN (SELECT src FROM ht) AND src <> dst")
def _(spark, sf):
    return H.enumerate_cliques(_host_traces(spark, sf))


@query("enumerate_srcdst", _HT + """, r AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT src FROM ht)),
  s AS (SELECT a.i AS slot, a.src AS src1, b.src AS src2 FROM r a JOIN r b ON b.i = (a.i + 1) % a.n WHERE a.i % 2 = 0)
  SELECT DISTINCT slot, src1, src2, dst FROM s JOIN ht ON ht.src = src1 OR ht.src = src2""")
def _(spark, sf):
    return H.enumerate_srcdst(_host_traces(spark, sf))


@query("trace_display", PR + " SELECT src, dst, ttl, resp, array_to_string(rr, ' ') AS shown, count(*) AS n FROM probes WHERE rr IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return H.trace_display(T.probes(spark, sf), "rr")


@query("type_c_router", RR + """, own AS (SELECT resp, ttl, qty, CASE WHEN resp % 10 = 0 THEN list_concat(rr[1:8], [resp]) ELSE rr END AS rr FROM rrp)
  SELECT resp AS ip FROM own GROUP BY resp HAVING bool_and(len(rr) > 0 AND coalesce(rr[-1] = resp, false)) AND resp NOT IN (SELECT resp FROM own WHERE ttl = 7 AND qty = 1)""")
def _(spark, sf):
    own = F.when(F.col("resp") % 10 == 0, F.concat(F.slice("rr", 1, 8), F.array("resp"))).otherwise(F.col("rr"))
    p = T.rr_probes(spark, sf).withColumn("rr", own)
    return H.type_c_router(p, p.where("ttl = 7 AND qty = 1").select(F.col("resp").alias("ip")))


@query("rpt_bandwidth", "WITH " + SQL["base"] + """, x AS (SELECT *, CASE WHEN part % 2 = 0 THEN 'Macro' ELSE 'Pollo' END AS ptype, epoch_us(t) / 1e6 + part AS sec, flag <> 'R' AS is_rr FROM base),
  g AS (SELECT src, dst, ttl, 0 AS it, arg_max(sec, (part, qty, sec, tr_resp, is_rr)) FILTER (ptype = 'Macro') AS m, arg_max(sec, (part, qty, sec, tr_resp, is_rr)) FILTER (ptype = 'Pollo') AS p,
     arg_max(tr_resp, (part, qty, sec, tr_resp, is_rr)) FILTER (ptype = 'Macro') AS mi, arg_max(tr_resp, (part, qty, sec, tr_resp, is_rr)) FILTER (ptype = 'Pollo') AS pi, arg_max(is_rr, (part, qty, sec, tr_resp, is_rr)) AS is_rr FROM x GROUP BY ALL),
  y AS (SELECT src, dst, max(ttl) AS maxttl FROM x GROUP BY ALL)
  SELECT src, dst, ttl, it, mi AS ip, p - m AS delta, 9334 + (CASE WHEN is_rr THEN 80 ELSE 40 END) * (maxttl - ttl) AS bytes,
    CASE WHEN p <> m THEN (9334 + (CASE WHEN is_rr THEN 80 ELSE 40 END) * (maxttl - ttl)) / (p - m) END AS bw, mi <> pi AS flap
  FROM g JOIN y USING (src, dst) WHERE m IS NOT NULL AND p IS NOT NULL""")
def _(spark, sf):
    b = T._base(spark, sf)
    p = b.select("src", "dst", "ttl", F.lit(0).alias("it"), F.col("tr_resp").alias("resp"),
                 F.when(F.col("part") % 2 == 0, "Macro").otherwise("Pollo").alias("ptype"),
                 (F.unix_micros("t") / 1e6 + F.col("part")).alias("t"), (F.col("flag") != "R").alias("is_rr"), "part", "qty")
    return H.rpt_bandwidth(p.withColumn("line_no", F.struct("part", "qty", "t", "resp", "is_rr")))


@query("multi_address_hosts", SQL and "WITH r AS (SELECT s_suppkey // 3 AS router, CASE s_nationkey % 3 WHEN 0 THEN 'Source' WHEN 1 THEN 'Endhost' ELSE 'Router' END AS kind, " + f"s_suppkey + {ROUTER_BASE} AS ip FROM supplier) "
  "SELECT router, kind, ip FROM r WHERE kind <> 'Router' AND router IN (SELECT router FROM r WHERE kind <> 'Router' GROUP BY router HAVING count(DISTINCT ip) > 1)")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 3).cast("bigint").alias("router"),
        F.when(F.col("s_nationkey") % 3 == 0, "Source").when(F.col("s_nationkey") % 3 == 1, "Endhost").otherwise("Router").alias("kind"),
        (F.col("s_suppkey") + ROUTER_BASE).alias("ip"))
    return H.multi_address_hosts(s)


@query("pending_targets", TR + f" SELECT o_custkey + {SOURCE_BASE} AS src, o_orderkey + {DEST_BASE} AS dst FROM orders WHERE (o_custkey + {SOURCE_BASE}, o_orderkey + {DEST_BASE}) NOT IN (SELECT (src, dst) FROM trp)")
def _(spark, sf):
    t = T.table(spark, sf, "orders").select((F.col("o_custkey") + SOURCE_BASE).alias("src"), (F.col("o_orderkey") + DEST_BASE).alias("dst"))
    return H.pending_targets(t, T.tr_probes(spark, sf))
