"""Registered queries: whole runs."""

from ..operators import chains as C
from . import repair as R
from . import tables as T
from .graph import _COMP
from .registry import query
from .union import M, _C

_VOTE = """, v AS (SELECT ip1, ip2, side, least(count(DISTINCT split_part(model, '-', 2)), count(DISTINCT split_part(model, '-', 3))) AS vote FROM bel GROUP BY 1, 2, 3),
  g AS (SELECT ip1, ip2, coalesce(max(vote) FILTER (side = 'link'), 0) AS link_votes, coalesce(max(vote) FILTER (side = 'alias'), 0) AS alias_votes FROM v GROUP BY 1, 2),
  won AS (SELECT *, CASE WHEN alias_votes > link_votes THEN 'alias' WHEN link_votes > alias_votes THEN 'link' ELSE 'TIE' END AS winner, greatest(link_votes, alias_votes) / (link_votes + alias_votes) AS share FROM g)"""
_PLAIN = M.replace("mf AS (", "m0 AS (") + """, rre AS (SELECT DISTINCT model, a1 AS ip FROM m0 WHERE pred = 'other' AND a3 = 'rrend'),
  mf AS (SELECT * FROM m0 WHERE NOT (pred = 'alias' AND ((model, a1) IN (SELECT (model, ip) FROM rre) OR (model, a2) IN (SELECT (model, ip) FROM rre))))"""
_SETTLED = _C.replace(M, _PLAIN).replace("WITH ", "WITH RECURSIVE ", 1) + _VOTE + """,
  kl AS (SELECT a1, a2, CAST(a3 AS INTEGER) AS ty, model FROM mf WHERE pred = 'link' AND (least(a1, a2), greatest(a1, a2)) NOT IN (SELECT (ip1, ip2) FROM won WHERE winner <> 'link')),
  ka AS (SELECT DISTINCT a1, a2 FROM mf WHERE pred = 'alias' AND (least(a1, a2), greatest(a1, a2)) NOT IN (SELECT (ip1, ip2) FROM won WHERE winner <> 'alias')),
  e AS (SELECT a1 AS a, a2 AS b FROM ka UNION SELECT ip, ip FROM (SELECT a1 AS ip FROM kl UNION SELECT a2 FROM kl UNION SELECT a1 FROM mf WHERE pred IN ('other', 'type'))), """ + _COMP


@query("settled_votes", _SETTLED + " SELECT * FROM won")
def _(spark, sf):
    return C.merge_and_settle(T.model_facts(spark, sf))[0]


@query("settled_routers", _SETTLED + """, tg AS (SELECT DISTINCT root, pred, a3 FROM comp JOIN mf ON mf.a1 = comp.ip AND pred IN ('other', 'type')),
  lb AS (SELECT root, CASE WHEN bool_or(pred = 'other' AND lower(a3) = 'source') THEN 'S' WHEN bool_or(pred = 'other' AND lower(a3) = 'nat') THEN 'N' WHEN bool_or(pred = 'other' AND lower(a3) = 'endhost') THEN 'E' WHEN bool_or(pred = 'other' AND lower(a3) = 'hidden') THEN 'H' ELSE 'R' END AS kind,
    string_agg(DISTINCT upper(a3), '_' ORDER BY upper(a3)) FILTER (pred = 'type') AS ty, string_agg(DISTINCT upper(a3), '_' ORDER BY upper(a3)) FILTER (pred = 'other' AND lower(a3) NOT IN ('source', 'nat', 'endhost', 'hidden')) AS ot FROM tg GROUP BY root)
  SELECT comp.root AS router, ip, concat_ws('_', coalesce(kind, 'R') || comp.root, ty, ot) AS label FROM comp LEFT JOIN lb ON lb.root = comp.root""")
def _(spark, sf):
    return C.merge_and_settle(T.model_facts(spark, sf))[1]


@query("settled_links", _SETTLED + """ SELECT least(x.root, y.root) AS r1, greatest(x.root, y.root) AS r2, min(ty) AS link_type, count(DISTINCT (least(a1, a2), greatest(a1, a2))) AS n_links, count(DISTINCT model) AS n_models
  FROM kl JOIN comp x ON x.ip = a1 JOIN comp y ON y.ip = a2 WHERE x.root <> y.root GROUP BY 1, 2""")
def _(spark, sf):
    return C.merge_and_settle(T.model_facts(spark, sf))[2]


# the steps of the chain read one another's rows: fi (probes with flaky variants), sp (spoof), fk (flaky), lz (lazy)
_FI = R._FLAKY[len(R.RR):R._FLAKY.index(",\n  pr AS")]
_WALK = R._FLAKY[R._FLAKY.index(",\n  pr AS"):].replace("FROM fi a JOIN fi b", "FROM sp a JOIN sp b")
_SP = R._SPOOF[len(R.RR):].replace("FROM rrp", "FROM fi") + ", sp AS (SELECT DISTINCT src, dst, ttl, resp, rr FROM (SELECT src, dst, ttl, resp, rr FROM u WHERE resp <> dst UNION ALL SELECT src, dst, ttl, coalesce(by_tr, by_rr, resp), rr FROM s))"
_FK = ", fk AS (SELECT * FROM sp WHERE (src, dst, ttl, resp, rr) NOT IN (SELECT (src, dst, ttl, resp, y) FROM w WHERE tag IS NOT NULL))"
_REPAIRED = R.RR + _FI + _SP + _WALK + _FK + ", " + R.lazy_rounds("fk") + ", " + R._MOVED + R._PAIRS[len(R.RR):].replace("FROM rrp", "FROM lz") + """,
  fx AS (SELECT DISTINCT x.resp AS ip FROM fnd, unnest(s) q(x) WHERE f IS NOT NULL AND list_contains(x.rr, f.rr[-1])),
  chk AS (SELECT src, dst FROM fnd WHERE f IS NOT NULL UNION SELECT src, dst FROM (SELECT src, dst FROM lz WHERE len(rr) > 0 GROUP BY src, dst, ttl, rr[-1] HAVING count(DISTINCT resp) > 1)),
  o AS (SELECT * FROM lz WHERE len(list_distinct(rr)) = len(rr) AND len(rr) < 9 AND (src, dst, ttl, resp, rr) NOT IN (SELECT (src, dst, ttl, resp1, rr1) FROM pairs WHERE NOT full_)),
  gp AS (SELECT o.src, o.dst, o.ttl, o.resp AS resp1, o.rr, b.ttl AS ttl2, b.resp AS resp2, b.rr AS rr2, row_number() OVER (PARTITION BY o.src, o.dst, o.ttl, o.resp, o.rr ORDER BY b.ttl, b.resp, b.rr) AS i
    FROM o JOIN lz b ON o.src = b.src AND o.dst = b.dst AND b.ttl >= o.ttl + 2 WHERE b.resp NOT IN (FROM fx) AND CASE WHEN len(o.rr) = 0 OR len(b.rr) = 0 THEN true
      WHEN o.rr[-1] = o.resp THEN (least(len(o.rr), len(b.rr)) = 1 OR o.rr[1:least(len(o.rr), len(b.rr)) - 1] = b.rr[1:least(len(o.rr), len(b.rr)) - 1])
      ELSE o.rr[1:least(len(o.rr), len(b.rr))] = b.rr[1:least(len(o.rr), len(b.rr))] END)
  SELECT 'probePair' AS pred, src, dst, ttl, resp1, resp2, CAST(NULL AS INTEGER) AS length, CAST(delta AS INTEGER) AS delta, CAST(n AS INTEGER) AS n FROM pairs WHERE NOT full_ AND ((src, dst) NOT IN (SELECT (src, dst) FROM chk)
      OR ((src, dst, ttl, resp1) IN (SELECT (src, dst, ttl, resp) FROM trp) AND (src, dst, ttl + 1, resp2) IN (SELECT (src, dst, ttl, resp) FROM trp)))
  UNION ALL SELECT DISTINCT 'trPair', src, dst, ttl, resp1, resp2, NULL, NULL, NULL FROM pairs WHERE full_
  UNION ALL SELECT 'gap', src, dst, ttl, resp1, resp2, CAST(least(ttl2 - ttl, 9 - len(rr)) AS INTEGER), CAST(len(rr2) - len(rr) AS INTEGER), CAST(len(rr2) AS INTEGER) FROM gp WHERE i = 1"""


@query("repair_chain", _REPAIRED)
def _(spark, sf):
    return C.trace_facts(C.repair_chain(R._flaky_input(spark, sf), T.tr_probes(spark, sf)))
