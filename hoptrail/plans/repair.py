"""Registered queries: probe pairs, gaps and repairs."""

from pyspark.sql import functions as F

from ..operators import addresses as A
from ..operators import hops as H
from ..operators import repair as R
from ..session import dealt
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL

RR = "WITH RECURSIVE " + SQL["rr"]
_S = "coalesce(array_to_string(rr, ' '), '-')"
_PAIRS = RR + """, d AS (SELECT DISTINCT src, dst, ttl, resp, rr, (src, ttl, resp) IN (SELECT (src, ttl, resp) FROM trp) AS in_tr
    FROM rrp WHERE len(list_distinct(rr)) = len(rr)),
  pairs AS (SELECT a.src, a.dst, a.ttl, a.resp AS resp1, b.resp AS resp2, a.rr AS rr1, b.rr AS rr2, len(b.rr) - len(a.rr) AS delta, len(b.rr) AS n, len(a.rr) >= 9 AS full_
   FROM d a JOIN d b ON a.src = b.src AND a.dst = b.dst AND b.ttl = a.ttl + 1 WHERE len(b.rr) >= len(a.rr) AND a.resp <> b.resp
   AND (len(a.rr) = 0 OR a.rr[-1] = a.resp OR (a.in_tr AND b.in_tr AND a.rr[-1] = b.rr[len(a.rr)]) OR b.rr[1:len(a.rr)] = a.rr))"""


def _t(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


def _data(spark, sf):
    return T.rr_probes(spark, sf), T.tr_probes(spark, sf)


@query("rr_probe_pairs", _PAIRS + " SELECT src, dst, ttl, resp1, resp2, array_to_string(rr1, ' ') AS rr1, array_to_string(rr2, ' ') AS rr2, delta, n FROM pairs WHERE NOT full_")
def _(spark, sf):
    return R.rr_probe_pairs(*_data(spark, sf)).select("src", "dst", "ttl", "resp1", "resp2", _t("rr1"), _t("rr2"), "delta", "n")


@query("rr_full_pairs", _PAIRS + " SELECT DISTINCT src, dst, ttl, resp1, resp2 FROM pairs WHERE full_")
def _(spark, sf):
    return R.rr_full_pairs(*_data(spark, sf))


@query("dedup_probe_pairs", _PAIRS + """, k AS (SELECT *, row_number() OVER (PARTITION BY resp1, resp2, delta, CASE WHEN n = 0 THEN rr2 ELSE rr2[greatest(n - least(delta + 1, n) + 1, 1):n] END
   ORDER BY src, dst, ttl, rr1, rr2, n) AS i FROM pairs WHERE NOT full_) SELECT src, dst, ttl, resp1, resp2, delta, n FROM k WHERE i = 1""")
def _(spark, sf):
    return R.dedup_probe_pairs(R.rr_probe_pairs(*_data(spark, sf))).select("src", "dst", "ttl", "resp1", "resp2", "delta", "n")


@query("paranoid_pairs", _PAIRS + """, l2 AS (SELECT DISTINCT src, dst FROM (SELECT src, dst, ttl, rr[-1] FROM rrp WHERE len(rr) > 0 GROUP BY src, dst, ttl, rr[-1] HAVING count(DISTINCT resp) > 1)),
  chk AS (SELECT *, (src, dst, ttl, resp1) IN (SELECT (src, dst, ttl, resp) FROM trp) AND (src, dst, ttl + 1, resp2) IN (SELECT (src, dst, ttl, resp) FROM trp) AS ok, (src, dst) IN (SELECT (src, dst) FROM l2) AS l2 FROM pairs WHERE NOT full_)
  SELECT 1 AS level, src, dst, ttl, resp1, resp2, delta FROM chk WHERE ok OR NOT l2 UNION ALL SELECT 2, src, dst, ttl, resp1, resp2, delta FROM chk WHERE ok""")
def _(spark, sf):
    rr, tr = _data(spark, sf)
    keep, rr, tr = dealt(H.TRACE, rr.select(*R.RR_COLS), tr.select(*H.TRACE, "ttl", "resp"), distinct=True)
    cols = ["src", "dst", "ttl", "resp1", "resp2", "delta"]
    p = keep(R.rr_probe_pairs(rr, tr, keep).select(cols))
    one = keep.result(R.paranoid_pairs(p, tr, 1, keep(R.layer2_switch(rr))))
    two = keep.result(R.paranoid_pairs(p, tr, 2))
    return one.select(F.lit(1).alias("level"), *cols).unionByName(two.select(F.lit(2).alias("level"), *cols))


@query("gap_links", _PAIRS + """, u AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM rrp), o AS (SELECT * FROM u WHERE len(list_distinct(rr)) = len(rr) AND len(rr) < 9
    AND (src, dst, ttl, resp, rr) NOT IN (SELECT (src, dst, ttl, resp1, rr1) FROM pairs WHERE NOT full_)),
  c AS (SELECT o.src, o.dst, o.ttl, o.resp AS resp1, o.rr, b.ttl AS ttl2, b.resp AS resp2, b.rr AS rr2,
     row_number() OVER (PARTITION BY o.src, o.dst, o.ttl, o.resp, o.rr ORDER BY b.ttl, b.resp, b.rr) AS i
   FROM o JOIN u b ON o.src = b.src AND o.dst = b.dst AND b.ttl >= o.ttl + 2
   WHERE CASE WHEN len(o.rr) = 0 OR len(b.rr) = 0 THEN true
     WHEN o.rr[-1] = o.resp THEN (least(len(o.rr), len(b.rr)) = 1 OR o.rr[1:least(len(o.rr), len(b.rr)) - 1] = b.rr[1:least(len(o.rr), len(b.rr)) - 1])
     ELSE o.rr[1:least(len(o.rr), len(b.rr))] = b.rr[1:least(len(o.rr), len(b.rr))] END)
  SELECT src, dst, ttl, resp1, ttl2, resp2, least(ttl2 - ttl, 9 - len(rr)) AS length, len(rr2) - len(rr) AS delta, len(rr2) AS n FROM c WHERE i = 1""")
def _(spark, sf):
    return R.gap_links(*_data(spark, sf)).drop("rr")


@query("layer2_switch", RR + """, e AS (SELECT DISTINCT src, dst, ttl, rr[-1] AS edge, resp AS ip FROM rrp WHERE len(rr) > 0)
  SELECT * FROM e WHERE (src, dst, ttl, edge) IN (SELECT (src, dst, ttl, edge) FROM e GROUP BY ALL HAVING count(*) > 1)""".replace("GROUP BY ALL", "GROUP BY src, dst, ttl, edge"))
def _(spark, sf):
    return R.layer2_switch(T.rr_probes(spark, sf))


@query("layer2_flap", RR + """, p AS (SELECT src, dst, ttl, qty % 4 AS it, resp, rr FROM rrp)
  SELECT DISTINCT a.src, a.dst, a.ttl, a.resp AS resp1, b.resp AS resp2 FROM p a JOIN p b ON a.src = b.src AND a.dst = b.dst AND a.ttl = b.ttl AND b.it = (a.it + 2) % 4 AND a.rr = b.rr AND a.resp <> b.resp""")
def _(spark, sf):
    return R.layer2_flap(T.rr_probes(spark, sf).withColumn("it", F.col("qty") % 4), 4)


_SPOOF = RR + """, u AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM rrp),
  bt AS (SELECT src, dst, ttl, min(resp) AS by_tr FROM trp WHERE resp <> dst GROUP BY ALL),
  br AS (SELECT src, dst, ttl - 1 AS ttl, min(rr[1]) AS by_rr FROM u WHERE resp <> dst AND len(rr) > 0 GROUP BY src, dst, ttl),
  s AS (SELECT u.*, by_tr, by_rr FROM u LEFT JOIN bt USING (src, dst, ttl) LEFT JOIN br USING (src, dst, ttl) WHERE resp = dst)"""


@query("fix_dst_spoof", _SPOOF + " SELECT DISTINCT src, dst, ttl, resp, " + _S + " AS rr FROM (SELECT src, dst, ttl, resp, rr FROM u WHERE resp <> dst UNION ALL SELECT src, dst, ttl, coalesce(by_tr, by_rr, resp), rr FROM s)")
def _(spark, sf):
    return R.fix_dst_spoof(*_data(spark, sf))[0].select("src", "dst", "ttl", "resp", _t("rr"))


@query("spoof_tags", _SPOOF + " SELECT DISTINCT ip, 'china' AS tag FROM (SELECT t.resp AS ip FROM trp t WHERE resp <> dst AND (src, dst, ttl) IN (SELECT (src, dst, ttl) FROM s) UNION ALL SELECT by_rr FROM s WHERE by_tr IS NULL AND by_rr IS NOT NULL)")
def _(spark, sf):
    return R.fix_dst_spoof(*_data(spark, sf))[1]


def _flaky_input(spark, sf):
    """Record-route probes, a fifth of them also in a variant that misses the second entry."""
    gap = F.concat(F.slice("rr", 1, 1), F.expr("slice(rr, 3, size(rr))"))
    both = F.when(F.expr("part % 5 = 0 AND size(rr) >= 3"), F.array("rr", gap)).otherwise(F.array("rr"))
    return T.rr_probes(spark, sf).withColumn("rr", F.explode(both))


_FLAKY = RR + """, fi AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM (SELECT src, dst, ttl, resp, rr FROM rrp UNION ALL
    SELECT src, dst, ttl, resp, list_concat(rr[1:1], rr[3:]) FROM rrp WHERE part % 5 = 0 AND len(rr) >= 3)),
  pr AS (SELECT a.src, a.dst, a.ttl, a.resp, a.rr AS x, b.rr AS y FROM fi a JOIN fi b ON a.src = b.src AND a.dst = b.dst AND a.ttl = b.ttl AND a.resp = b.resp AND len(a.rr) > len(b.rr)),
  w AS (SELECT *, 0 AS k, 0 AS o, CAST(NULL AS BIGINT) AS tag FROM pr UNION ALL
    SELECT src, dst, ttl, resp, x, y, k + 1, CASE WHEN x[k + 1 + o] = y[k + 1] THEN o WHEN x[k + 2 + o] = y[k + 1] THEN o + 1 ELSE o END,
      CASE WHEN x[k + 1 + o] = y[k + 1] THEN NULL WHEN x[k + 2 + o] = y[k + 1] THEN x[k + 2 + o] END FROM w WHERE k < len(y))"""


@query("flaky_routers", _FLAKY + " SELECT src, dst, ttl, resp, " + _S + " AS rr FROM fi WHERE (src, dst, ttl, resp, rr) NOT IN (SELECT (src, dst, ttl, resp, y) FROM w WHERE tag IS NOT NULL)")
def _(spark, sf):
    return R.flaky_routers(_flaky_input(spark, sf))[0].select("src", "dst", "ttl", "resp", _t("rr"))


@query("flaky_tags", _FLAKY + " SELECT DISTINCT tag AS ip, 'flaky' AS tag FROM w WHERE tag IS NOT NULL")
def _(spark, sf):
    return R.flaky_routers(_flaky_input(spark, sf))[1]


def lazy_rounds(probes: str) -> str:
    """Recursion over the rounds of `lazy_routers`: a trace's probes and plain hops as lists, `f` its first lazy probe."""
    return """st0 AS (SELECT src, dst, list(DISTINCT {'ttl': ttl, 'resp': resp, 'rr': rr}) AS s FROM %s GROUP BY src, dst),
  plain AS (SELECT src, dst, list(DISTINCT {'ttl': ttl, 'resp': resp}) AS p FROM trp GROUP BY src, dst),
  st AS (SELECT 0 AS i, src, dst, p, s FROM st0 LEFT JOIN plain USING (src, dst) UNION ALL
    SELECT i + 1, src, dst, p, list_distinct([CASE WHEN list_contains(x.rr, f.rr[-1]) THEN {'ttl': x.ttl + 1, 'resp': x.resp, 'rr': x.rr} ELSE x END FOR x IN s]) FROM (%s) WHERE f IS NOT NULL),
  fnd AS (SELECT * FROM (%s))""" % (probes, _FIRST_LAZY, _FIRST_LAZY)


_FIRST_LAZY = """SELECT *, list_sort([x FOR x IN s IF len(x.rr) > 0 AND list_contains(p, {'ttl': x.ttl + 1, 'resp': x.resp}) AND NOT list_contains(p, {'ttl': x.ttl, 'resp': x.resp})
    AND NOT list_contains(k, {'ttl': x.ttl + 1, 'resp': x.resp})])[1] AS f FROM (SELECT *, [{'ttl': y.ttl, 'resp': y.resp} FOR y IN s] AS k FROM st)"""
_MOVED = "lz AS (SELECT src, dst, x.ttl AS ttl, x.resp AS resp, x.rr AS rr FROM fnd, unnest(s) u(x) WHERE f IS NULL)"


@query("lazy_routers", RR + ", " + lazy_rounds("rrp") + ", " + _MOVED + " SELECT src, dst, ttl, resp, array_to_string(rr, ' ') AS rr FROM lz")
def _(spark, sf):
    return R.lazy_routers(*_data(spark, sf))[0].select("src", "dst", "ttl", "resp", _t("rr"))


@query("find_lazy", RR + """, u AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM rrp), z AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ttl, resp, rr) AS i FROM u
   WHERE len(rr) > 0 AND (src, dst, ttl + 1, resp) IN (SELECT (src, dst, ttl, resp) FROM trp) AND (src, dst, ttl, resp) NOT IN (SELECT (src, dst, ttl, resp) FROM trp)
   AND (src, dst, ttl + 1, resp) NOT IN (SELECT (src, dst, ttl, resp) FROM u)) SELECT src, dst, ttl AS lazy_ttl, rr[-1] AS demark FROM z WHERE i = 1""")
def _(spark, sf):
    return R.find_lazy(*_data(spark, sf))


def _stupid_input(spark, sf):
    """Plain and record-route probes with coarser addresses, so that responders come up at neighbouring TTLs."""
    coarse = lambda d: d.withColumn("resp", F.shiftright("resp", 4)).withColumn("src", F.lit(0).cast("bigint")).withColumn("dst", F.floor(F.col("dst") / 8).cast("bigint"))
    rr, tr = _data(spark, sf)
    return coarse(rr), coarse(tr)


@query("stupid_routers", RR + """, r AS (SELECT CAST(0 AS BIGINT) AS src, dst // 8 AS dst, ttl, resp >> 4 AS resp, count(*) AS n FROM rrp GROUP BY ALL),
  t AS (SELECT CAST(0 AS BIGINT) AS src, dst // 8 AS dst, ttl, resp >> 4 AS resp, count(*) AS n FROM trp GROUP BY ALL),
  s AS (SELECT r.src, r.dst, r.ttl, bool_or(t.n IS NOT NULL) AS seen, sum(r.n * coalesce(x.n, 0)) AS points FROM r LEFT JOIN t ON r.src = t.src AND r.dst = t.dst AND r.ttl = t.ttl AND r.resp = t.resp
    LEFT JOIN t x ON r.src = x.src AND r.dst = x.dst AND r.ttl + 1 = x.ttl AND r.resp = x.resp GROUP BY r.src, r.dst, r.ttl)
  SELECT src, dst, ttl, CAST(points AS BIGINT) AS points, CASE WHEN points >= 9 THEN 'mark' ELSE 'drop' END AS verdict FROM s WHERE NOT seen AND points >= 3""")
def _(spark, sf):
    return R.stupid_routers(*_stupid_input(spark, sf))


_VERD = f"v AS (SELECT l_suppkey + {ROUTER_BASE} AS ip1, l_partkey // 20 + {ROUTER_BASE} AS ip2, CASE WHEN l_discount > 0.05 THEN 'ALIAS' ELSE 'NOT' END AS verdict, l_returnflag AS source FROM lineitem)"


def _verdicts(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") + ROUTER_BASE).alias("ip1"), (F.floor(F.col("l_partkey") / 20).cast("bigint") + ROUTER_BASE).alias("ip2"),
        F.when(F.col("l_discount") > 0.05, "ALIAS").otherwise("NOT").alias("verdict"), F.col("l_returnflag").alias("source"))


@query("attach_alias_evidence", RR + ", " + _VERD + ", i AS (SELECT DISTINCT resp AS ip FROM trp) SELECT CASE verdict WHEN 'ALIAS' THEN 'potentialAlias' ELSE 'potentialNotAlias' END AS pred, ip1, ip2, source, count(*) AS n FROM v WHERE ip1 IN (FROM i) AND ip2 IN (FROM i) GROUP BY ALL")
def _(spark, sf):
    ips = T.tr_probes(spark, sf).select(F.col("resp").alias("ip"))
    return R.attach_alias_evidence(_verdicts(spark, sf), ips).groupBy("pred", "ip1", "ip2", "source").agg(F.count(F.lit(1)).alias("n"))


@query("attach_hints", RR + f" SELECT s_suppkey + {ROUTER_BASE} AS ip, s_name AS hint FROM supplier WHERE s_suppkey + {ROUTER_BASE} IN (SELECT resp FROM trp)")
def _(spark, sf):
    ips = T.tr_probes(spark, sf).select(F.col("resp").alias("ip"))
    hints = T.table(spark, sf, "supplier").select((F.col("s_suppkey") + ROUTER_BASE).alias("ip"), F.col("s_name").alias("hint"))
    return R.attach_hints(ips, hints)


@query("ip_tags", _SPOOF + """, e AS (SELECT DISTINCT src, dst, ttl, rr[-1] AS edge, resp AS ip FROM rrp WHERE len(rr) > 0),
  l2 AS (SELECT * FROM e WHERE (src, dst, ttl, edge) IN (SELECT (src, dst, ttl, edge) FROM e GROUP BY src, dst, ttl, edge HAVING count(*) > 1)),
  tg AS (SELECT src AS ip, 'source' AS tag FROM trp UNION SELECT dst, 'endhost' FROM trp UNION SELECT edge, 'layer2' FROM l2 UNION SELECT ip, 'layer2' FROM l2
    UNION SELECT t.resp, 'china' FROM trp t WHERE resp <> dst AND (src, dst, ttl) IN (SELECT (src, dst, ttl) FROM s) UNION SELECT by_rr, 'china' FROM s WHERE by_tr IS NULL AND by_rr IS NOT NULL
    UNION SELECT a.resp, 'selflink' FROM trp a JOIN trp b ON a.src = b.src AND a.dst = b.dst AND a.ttl + 1 = b.ttl AND a.resp = b.resp)
  SELECT ip, string_agg(tag, ',' ORDER BY tag) AS tags FROM tg GROUP BY ip""")
def _(spark, sf):
    rr, tr = _data(spark, sf)
    l2 = R.layer2_switch(rr).select(F.explode(F.array("edge", "ip")).alias("ip")).distinct().withColumn("tag", F.lit("layer2"))
    t = R.ip_tags(R.end_tags(tr), l2, R.fix_dst_spoof(rr, tr)[1], H.tr_self_links(tr))
    return t.select("ip", F.array_join("tags", ",").alias("tags"))
