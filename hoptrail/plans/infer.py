"""Registered queries: router behaviour and implied links."""

from pyspark.sql import functions as F

from ..operators import infer as I
from ..session import cut_lineage
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL


def _rr(spark, sf):
    """Record-route probes with the source as the hop at TTL 0; spoofed answers aside."""
    p = T.rr_probes(spark, sf).where("resp <> dst").select("src", "dst", "ttl", "resp", "rr")
    s = p.select("src", "dst").distinct().select("src", "dst", F.lit(0).alias("ttl"), F.col("src").alias("resp"), F.array().cast("array<bigint>").alias("rr"))
    return p.unionByName(s)


_RR = "WITH RECURSIVE " + SQL["rr"] + """, d AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM rrp WHERE resp <> dst UNION SELECT DISTINCT src, dst, 0, src, CAST([] AS BIGINT[]) FROM rrp WHERE resp <> dst),
 near AS (SELECT *, len(rr) > 0 AND abs(resp - rr[-1]) = 1 AND resp >> 8 = rr[-1] >> 8 AS n1, len(rr) > 1 AND abs(resp - rr[-2]) = 1 AND resp >> 8 = rr[-2] >> 8 AS n2 FROM d),
 p AS (SELECT a.src, a.dst, a.ttl, a.resp AS resp1, b.resp AS resp2, a.rr AS rr1, b.rr AS rr2, len(b.rr) - len(a.rr) AS delta,
   CASE WHEN least(len(a.rr), len(b.rr)) = 0 THEN true ELSE a.rr[1:least(len(a.rr), len(b.rr))] = b.rr[1:least(len(a.rr), len(b.rr))] END AS same,
   coalesce(b.n1, false) AND NOT coalesce(b.n2, false) AS off, NOT coalesce(b.n1, false) OR coalesce(b.n2, false) AS plus_b
   FROM d a JOIN near b ON a.src = b.src AND a.dst = b.dst AND b.ttl = a.ttl + 1),
 c2 AS (SELECT src, dst, resp2 AS resp, 2 AS mask FROM p WHERE same AND (delta = 2 OR (ttl = 0 AND delta = 1)) UNION SELECT src, dst, resp1, 1 FROM p WHERE same AND (delta = 2 OR (ttl = 0 AND delta = 1))),
 c0 AS (SELECT src, dst, resp2 AS resp, 5 AS mask FROM p WHERE same AND delta = 0 AND len(rr2) < 9 UNION SELECT src, dst, resp1, 6 FROM p WHERE same AND delta = 0 AND len(rr2) < 9),
 co AS (SELECT DISTINCT src, dst, resp, 5 AS mask FROM near WHERE coalesce(n1, false) AND NOT coalesce(n2, false)),
 st AS (SELECT src, dst, resp, bit_and(mask) AS mask FROM (SELECT src, dst, resp, 7 AS mask FROM d UNION ALL FROM c2 UNION ALL FROM c0 UNION ALL FROM co) GROUP BY ALL),
 ps AS (SELECT p.*, a.mask AS m1, b.mask AS m2 FROM p JOIN st a ON p.src = a.src AND p.dst = a.dst AND p.resp1 = a.resp JOIN st b ON p.src = b.src AND p.dst = b.dst AND p.resp2 = b.resp)"""
_M = ["src", "dst", "resp", "mask"]


def _kept(spark, sf):
    rr = cut_lineage(_rr(spark, sf))     # probes and pairs are read several times each
    p = cut_lineage(I.path_pairs(rr))
    return rr, p, I.start_state(rr, p)


def _state(spark, sf):
    return _kept(spark, sf)[1:]


@query("same_path", "WITH " + SQL["rr"] + f""", d AS (SELECT DISTINCT src, dst // 50 AS dst, ttl, resp, rr FROM rrp),
  z AS (SELECT a.src, a.dst, a.ttl, list_filter(list_transform(range(1, least(len(a.rr), len(b.rr)) + 1), lambda i: CASE WHEN a.rr[i] <> b.rr[i] THEN b.rr[i] END), lambda x: x IS NOT NULL) AS l
    FROM d a JOIN d b ON a.src = b.src AND a.dst = b.dst AND b.ttl = a.ttl + 1) SELECT DISTINCT src, dst, ttl, l[1] AS ip, 'Flapping' AS tag FROM z WHERE len(l) > 0""")
def _(spark, sf):
    return I.same_path(T.rr_probes(spark, sf).withColumn("dst", F.floor(F.col("dst") / 50).cast("bigint")))


@query("rr_delta", _RR + " SELECT src, dst, ttl, resp1, resp2, delta, delta NOT IN (-1, 0, 1, 2) OR resp1 = resp2 AS reject FROM p WHERE same OR resp1 = resp2")
def _(spark, sf):
    return I.rr_delta(I.path_pairs(_rr(spark, sf)))


@query("rule_plus_two", _RR + " SELECT * FROM c2")
def _(spark, sf):
    return I.rule_plus_two(I.path_pairs(_rr(spark, sf))).select(_M)


@query("rule_zero", _RR + " SELECT * FROM c0")
def _(spark, sf):
    return I.rule_zero(I.path_pairs(_rr(spark, sf))).select(_M)


@query("rule_intersection", _RR + " SELECT * FROM st")
def _(spark, sf):
    return _state(spark, sf)[1].select(_M)


@query("rule_off_by_one", _RR + " SELECT * FROM co")
def _(spark, sf):
    return I.rule_off_by_one(_rr(spark, sf)).select(_M)


@query("rule_double_zero", _RR + """, z AS (SELECT * FROM p WHERE same AND delta = 0), h AS (SELECT * FROM z WHERE (src, dst, ttl, resp1, rr1) IN (SELECT (src, dst, ttl + 1, resp2, rr2) FROM z))
  SELECT src, dst, resp1 AS resp, 4 AS mask FROM h UNION SELECT src, dst, resp2, 5 FROM h""")
def _(spark, sf):
    return I.rule_double_zero(I.path_pairs(_rr(spark, sf))).select(_M)


@query("rule_plus_one", _RR + """, h AS (SELECT * FROM ps WHERE same AND delta = 1 AND m1 IN (1, 2, 4) AND m2 NOT IN (1, 2, 4))
  SELECT src, dst, resp2 AS resp, 5 AS mask, false AS hidden FROM h WHERE m1 = 1 UNION SELECT src, dst, resp2, 2, false FROM h WHERE m1 <> 1 AND plus_b
  UNION SELECT src, dst, resp1, 6, false FROM h WHERE m1 <> 1 AND plus_b UNION SELECT src, dst, resp2, 1, true FROM h WHERE m1 <> 1 AND NOT plus_b""")
def _(spark, sf):
    return I.rule_plus_one(*_state(spark, sf))


@query("rule_forward", _RR + " SELECT DISTINCT src, dst, resp1 AS resp, 1 AS mask FROM ps WHERE same AND delta = 1 AND m1 NOT IN (1, 2, 4) AND m2 & 2 = 0")
def _(spark, sf):
    return I.rule_forward(*_state(spark, sf)).select(_M)


@query("classify_routers")
def _(spark, sf):
    return I.classify_routers(_rr(spark, sf), T.tr_probes(spark, sf)).select("src", "dst", "resp", I.type_name().alias("type"))


@query("rr_links", _RR + """, q AS (SELECT *, CASE m1 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 4 THEN 'N' ELSE 'U' END AS t1, CASE m2 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 4 THEN 'N' ELSE 'U' END AS t2, rr2[-1] AS l, CASE WHEN len(rr2) > 1 THEN rr2[-2] END AS b4, rr1[-1] AS pl FROM ps WHERE same),
  e AS (SELECT 'alias' AS kind, resp1 AS a, b4 AS b, 0 AS link_type FROM q WHERE t1 = 'A' AND t2 = 'B' UNION SELECT 'alias', resp2, l, 0 FROM q WHERE t2 = 'B' UNION SELECT 'link', b4, resp2, 1 FROM q WHERE t1 = 'A' AND t2 = 'B'
   UNION SELECT 'alias', resp1, l, 0 FROM q WHERE t1 = 'A' AND t2 = 'A' UNION SELECT 'link', l, resp2, 1 FROM q WHERE t1 = 'A' AND t2 = 'A'
   UNION SELECT 'link', resp1, resp2, 2 FROM q WHERE (t1 = 'A' AND t2 IN ('N', 'U')) OR t1 IN ('N', 'U') UNION SELECT 'link', pl, resp2, 1 FROM q WHERE t1 = 'B')
  SELECT * FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND (kind = 'link' OR a <> b)""")
def _(spark, sf):
    return I.rr_links(*_state(spark, sf))


@query("hidden_chain", _RR + """, u AS (SELECT d.*, mask FROM d JOIN st USING (src, dst, resp) WHERE ttl > 1 AND (src, dst, ttl, resp, rr) NOT IN (SELECT (src, dst, ttl + 1, resp2, rr2) FROM p WHERE same) AND (mask = 2 OR mask & 1 = 1)),
  v AS (SELECT *, CASE WHEN mask = 2 THEN rr[1:len(rr) - 1] ELSE rr END AS body FROM u),
  w AS (SELECT *, list_concat([src], body) AS steps FROM v)
  SELECT steps[i] AS a, body[i] AS b, 5 AS link_type FROM w, range(1, 10) r(i) WHERE i <= len(body) AND body[i] NOT IN (SELECT resp FROM d)
  UNION SELECT steps[-1], CASE WHEN mask = 2 THEN coalesce(rr[-1], resp) ELSE resp END, 1 FROM w""")
def _(spark, sf):
    return I.hidden_chain(*_kept(spark, sf))


_IT = "WITH " + SQL["rr"] + ", a AS (SELECT src, dst, ttl, resp, qty % 4 AS it, false AS plain FROM rrp UNION ALL SELECT src, dst, ttl, resp, qty % 4, true FROM trp)"


def _it(spark, sf):
    r = T.rr_probes(spark, sf).select("src", "dst", "ttl", "resp", (F.col("qty") % 4).alias("it"), "rr")
    t = T.tr_probes(spark, sf).select("src", "dst", "ttl", "resp", (F.col("qty") % 4).alias("it"), F.lit(None).cast("array<bigint>").alias("rr"))
    return r.unionByName(t)


@query("tr_fallback_links", _IT + " SELECT DISTINCT x.resp AS ip1, y.resp AS ip2, 3 AS link_type FROM a x JOIN a y ON x.src = y.src AND x.dst = y.dst AND x.ttl + 1 = y.ttl AND x.it % 2 = y.it % 2 AND y.plain AND x.resp <> y.resp")
def _(spark, sf):
    return I.tr_fallback_links(_it(spark, sf))


@query("ensure_reachability", _IT + f""", l AS (SELECT DISTINCT y.resp AS ip2 FROM a x JOIN a y ON x.src = y.src AND x.dst = y.dst AND x.ttl + 1 = y.ttl AND y.plain AND x.resp % 5 = 0),
  h AS (SELECT DISTINCT src, dst, ttl, it, resp FROM a), f AS (SELECT *, min((ttl, it)) OVER (PARTITION BY src, dst, resp) AS fi FROM h),
  o AS (SELECT *, resp IN (SELECT ip2 FROM l) OR (ttl, it) > fi OR resp = src AS ok FROM f),
  z AS (SELECT *, last_value(CASE WHEN ok THEN resp END IGNORE NULLS) OVER (PARTITION BY src, dst ORDER BY ttl, it, resp) AS lst FROM o)
  SELECT DISTINCT coalesce(lst, src) AS ip1, resp AS ip2, 4 AS link_type FROM z WHERE NOT ok""")
def _(spark, sf):
    a = _it(spark, sf)
    x = a.where("resp % 5 = 0").select("src", "dst", "ttl").distinct()
    y = a.where("rr IS NULL").select("src", "dst", (F.col("ttl") - 1).alias("ttl"), F.col("resp").alias("ip2"))
    return I.ensure_reachability(a, y.join(x, ["src", "dst", "ttl"], "left_semi").select("ip2").distinct())


@query("nat_split", _IT + """, c AS (SELECT DISTINCT src, dst, ttl, it, resp, resp = dst AS nat FROM a)
  SELECT DISTINCT src, dst, ttl, it, resp, CASE WHEN ttl > 1 AND (src, dst, ttl - 1) IN (SELECT (src, dst, ttl) FROM c WHERE nat) THEN concat_ws(':', resp, src, dst, ttl, it) ELSE CAST(resp AS VARCHAR) END AS router FROM c""")
def _(spark, sf):
    return I.nat_split(_it(spark, sf).withColumn("class", F.when(F.col("resp") == F.col("dst"), "NAT").otherwise("ROUTER")))


_TYPES = ["A", "B", "N", "A-OR-N", "B-OR-N", "HA", "DropsRR", "MPLS", "China"]


@query("merge_router_types", f"""WITH m AS (SELECT DISTINCT l_partkey AS router, {_TYPES}[1 + l_suppkey % 9] AS t FROM lineitem),
  win AS (SELECT * FROM (VALUES ('HA','A'), ('HA','B'), ('A','DropsRR'), ('A','A-OR-N'), ('B','DropsRR'), ('B','B-OR-N'), ('N','A-OR-N'), ('N','B-OR-N')) v(w, l)),
  opp AS (SELECT * FROM (VALUES ('HA','N'), ('A','B'), ('A','B-OR-N'), ('A','N'), ('B','A'), ('B','A-OR-N'), ('B','N'), ('A-OR-N','B'), ('B-OR-N','A'), ('N','A'), ('N','B')) v(x, y)),
  k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN win ON o.t = w WHERE o.router = m.router AND l = m.t)),
  v AS (SELECT DISTINCT k.router FROM k JOIN k o ON k.router = o.router JOIN opp ON k.t = x AND o.t = y)
  SELECT router, string_agg(t, ',' ORDER BY t) AS types, router IN (SELECT router FROM v) AND router NOT IN (SELECT router FROM m WHERE t = 'MPLS') AS violation FROM k GROUP BY router""")
def _(spark, sf):
    m = T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("router"), F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("l_suppkey") % 9 + 1).cast("int")).alias("type"))
    return I.merge_router_types(m).select("router", F.array_join("types", ",").alias("types"), "violation")
