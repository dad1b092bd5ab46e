"""Registered queries: scoring against ground truth, clean-ups, constraints."""

from pyspark.sql import functions as F

from ..operators import constraints as C
from ..operators import validate as V
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL

_B = "WITH " + SQL["truth"] + ", " + SQL["observed"] + ", " + SQL["links_observed"] + ", " + SQL["links_truth"] + """,
 lab AS (SELECT coalesce(o.ip, t.ip) AS ip, o.router AS o, t.router AS t FROM observed o FULL JOIN truth t ON o.ip = t.ip),
 op AS (SELECT a.ip AS ip1, b.ip AS ip2 FROM observed a JOIN observed b ON a.router = b.router AND a.ip < b.ip),
 tp AS (SELECT a.ip AS ip1, b.ip AS ip2 FROM truth a JOIN truth b ON a.router = b.router AND a.ip < b.ip),
 os AS (SELECT * FROM (SELECT min(ip) OVER (PARTITION BY router) AS ip1, ip AS ip2 FROM observed) WHERE ip1 <> ip2),
 ts AS (SELECT * FROM (SELECT min(ip) OVER (PARTITION BY router) AS ip1, ip AS ip2 FROM truth) WHERE ip1 <> ip2)"""


def _pair(spark, sf):
    return T.routers_observed(spark, sf), T.routers_true(spark, sf)


_AC = _B + """, ac AS (SELECT coalesce(o.ip1, t.ip1) AS ip1, coalesce(o.ip2, t.ip2) AS ip2, o.ip1 IS NOT NULL AS io, t.ip1 IS NOT NULL AS it FROM op o FULL JOIN tp t ON o.ip1 = t.ip1 AND o.ip2 = t.ip2),
 acs AS (SELECT ac.ip1, ac.ip2, CASE WHEN io AND it THEN 'common' WHEN it THEN 'missing' WHEN a.t <> b.t THEN 'wrong' ELSE 'observed_only' END AS status FROM ac JOIN lab a ON a.ip = ac.ip1 JOIN lab b ON b.ip = ac.ip2)"""


@query("truth_alias_compare", _AC + " SELECT * FROM acs")
def _(spark, sf):
    return V.truth_alias_compare(*_pair(spark, sf))


def _st(o, t, phase):
    return f"""SELECT '{phase}' AS phase, count(*) FILTER ((ip1, ip2) IN (SELECT (ip1, ip2) FROM {t})) AS common, count(*) FILTER ((ip1, ip2) NOT IN (SELECT (ip1, ip2) FROM {t}) AND a.t <> b.t) AS wrong,
      count(*) FILTER ((ip1, ip2) NOT IN (SELECT (ip1, ip2) FROM {t})) AS extra, (SELECT count(*) FROM {t} WHERE (ip1, ip2) NOT IN (SELECT (ip1, ip2) FROM {o})) AS missed FROM {o} JOIN lab a ON a.ip = ip1 JOIN lab b ON b.ip = ip2"""


@query("alias_stats", _B + " " + _st("os", "ts", "pre") + " UNION ALL " + _st("op", "tp", "post"))
def _(spark, sf):
    return V.alias_stats(*_pair(spark, sf))


_LC = _B + """, orr AS (SELECT ip1, ip2 FROM lo WHERE link_type <= 2), trr AS (SELECT ip1, ip2 FROM lt WHERE link_type <= 2), otr AS (SELECT ip1, ip2 FROM lo WHERE link_type = 3),
 kt AS (SELECT ip, router FROM truth),
 lc AS (SELECT o.ip1, o.ip2, 'RR' AS kind, CASE WHEN (o.ip1, o.ip2) IN (SELECT (ip1, ip2) FROM trr) THEN 'common' WHEN a.router = b.router THEN 'wrong' ELSE 'extra' END AS status FROM orr o LEFT JOIN kt a ON a.ip = o.ip1 LEFT JOIN kt b ON b.ip = o.ip2
  UNION ALL SELECT ip1, ip2, 'TR', 'extra' FROM otr WHERE ip1 NOT IN (SELECT ip FROM kt)
  UNION ALL SELECT t.ip1, t.ip2, 'RR', CASE WHEN EXISTS (SELECT 1 FROM orr x JOIN kt k ON k.ip = x.ip1 WHERE k.router = a.router AND x.ip2 = t.ip2) THEN 'alt_rr'
     WHEN EXISTS (SELECT 1 FROM otr x JOIN kt k ON k.ip = x.ip1 WHERE k.router = a.router AND x.ip2 = t.ip2) THEN 'tr' ELSE 'missing' END FROM trr t LEFT JOIN kt a ON a.ip = t.ip1 WHERE (t.ip1, t.ip2) NOT IN (SELECT (ip1, ip2) FROM orr))"""


def _links(spark, sf):
    return V.truth_link_compare(T.graph_links(spark, sf, "observed"), T.graph_links(spark, sf, "truth"), T.routers_true(spark, sf))


@query("truth_link_compare", _LC + " SELECT * FROM lc")
def _(spark, sf):
    return _links(spark, sf)


@query("link_stats", _LC + " SELECT count(*) FILTER (status = 'common') AS common, count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (status IN ('wrong', 'extra')) AS extra, count(*) FILTER (status = 'missing') AS missed, count(*) FILTER (status = 'tr') AS tr_links, count(*) FILTER (status = 'alt_rr') AS alt_rr_links FROM lc")
def _(spark, sf):
    return V.link_stats(_links(spark, sf))


@query("router_mapping", _AC + """, mp AS (SELECT a.t, a.o FROM acs JOIN lab a ON a.ip = ip1 WHERE status IN ('common', 'wrong') UNION SELECT b.t, a.o FROM acs JOIN lab a ON a.ip = ip1 JOIN lab b ON b.ip = ip2 WHERE status = 'wrong'
   UNION SELECT a.t, x.o FROM acs JOIN lab a ON a.ip = ip1 JOIN lab b ON b.ip = ip2, (SELECT 1) z, LATERAL (SELECT unnest([a.o, b.o]) AS o) x WHERE status = 'missing' AND a.o IS NOT NULL AND b.o IS NOT NULL),
  pt AS (SELECT t, count(*) AS parts, min(o) AS o FROM mp GROUP BY t), po AS (SELECT o, count(*) AS nt FROM mp GROUP BY o), e AS (SELECT DISTINCT router AS t FROM truth), g AS (SELECT e.t, parts, nt FROM e LEFT JOIN pt ON e.t = pt.t LEFT JOIN po ON pt.o = po.o)
  SELECT count(*) AS n_truth, count(*) FILTER (parts IS NULL) AS missed, count(*) FILTER (parts = 1 AND nt = 1) AS good, count(*) FILTER (parts = 1 AND nt > 1) AS bad, count(*) FILTER (parts > 1) AS split,
   CAST(coalesce(sum(parts - 1) FILTER (parts > 1), 0) AS BIGINT) AS superfluous, (SELECT count(DISTINCT router) FROM observed) AS n_observed FROM g""")
def _(spark, sf):
    return V.router_mapping(*_pair(spark, sf))


@query("cluster_similarity", _B + """, k AS (SELECT * FROM lab WHERE o IS NOT NULL AND t IS NOT NULL), p AS (SELECT (a.o = b.o) = (a.t = b.t) AS good FROM k a JOIN k b ON a.ip < b.ip)
  SELECT count(*) FILTER (good) AS score, count(*) AS pairs, count(*) FILTER (good) / count(*) AS similarity FROM p""")
def _(spark, sf):
    return V.cluster_similarity(*_pair(spark, sf))


_CL = _B + ", sz AS (SELECT router, count(*) AS n FROM observed GROUP BY router), lk2 AS (SELECT * FROM lo)"


@query("clean_graph", _CL + " SELECT router, ip FROM observed JOIN sz USING (router) WHERE n > 1 OR ip IN (SELECT ip1 FROM lk2) OR ip IN (SELECT ip2 FROM lk2)")
def _(spark, sf):
    return V.clean_graph(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"))


_DF = _CL + ", kp AS (SELECT ip FROM observed JOIN sz USING (router) WHERE n > 1)"


@query("defringe_graph", _DF + " SELECT ip1, ip2, link_type FROM lo WHERE ip1 IN (FROM kp) AND ip2 IN (FROM kp)")
def _(spark, sf):
    return V.defringe_graph(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"))[1].select("ip1", "ip2", "link_type")


@query("defringe_graph_routers", _DF + " SELECT router, ip FROM observed WHERE ip IN (FROM kp)")
def _(spark, sf):
    return V.defringe_graph(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"))[0].select("router", "ip")


_RT = _B + ", ti AS (SELECT ip FROM truth WHERE ip % 5 < 3)"


@query("restrict_to_truth", _RT + " SELECT router, ip FROM observed WHERE router IN (SELECT router FROM observed WHERE ip IN (FROM ti))")
def _(spark, sf):
    return V.restrict_to_truth(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"), T.routers_true(spark, sf).where("ip % 5 < 3"))[0]


@query("restrict_to_truth_links", _RT + " SELECT ip1, ip2, link_type FROM lo WHERE ip1 IN (FROM ti) AND ip2 IN (FROM ti)")
def _(spark, sf):
    return V.restrict_to_truth(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"), T.routers_true(spark, sf).where("ip % 5 < 3"))[1].select("ip1", "ip2", "link_type")


@query("duplicate_interfaces", "SELECT l_suppkey AS ip, count(DISTINCT l_linenumber) AS n_routers, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ip"), F.col("l_linenumber").alias("router"))
    return V.duplicate_interfaces(li)


_IF = "WITH i AS (SELECT p_partkey // 5 AS router, 1073741824 + p_partkey * 5 AS ip, 29 + p_partkey % 3 AS len FROM part WHERE p_size % 4 <> 0 AND p_partkey % 10 <> 9)"


@query("truth_facts", _IF + """ SELECT 'alias' AS pred, a.ip AS ip1, b.ip AS ip2 FROM i a JOIN i b ON a.router = b.router AND a.ip <> b.ip UNION SELECT 'link', ip, xor(ip, 1) FROM i WHERE len = 31 UNION SELECT 'link', ip, xor(ip, 3) FROM i WHERE len = 30
  UNION SELECT 'link', ip, ((ip >> 3) << 3) + k FROM i, range(1, 7) t(k) WHERE len = 29 AND ((ip >> 3) << 3) + k <> ip""")
def _(spark, sf):
    k = F.col("p_partkey")
    i = T.table(spark, sf, "part").select(
        F.floor(k / 5).cast("bigint").alias("router"), F.when(k % 10 == 9, ROUTER_BASE + k).otherwise(1073741824 + k * 5).alias("ip"),
        (29 + k % 3).cast("int").alias("len"), (F.col("p_size") % 4 != 0).alias("up"))
    return V.truth_facts(i)


def _candidates(spark, sf):
    """Candidate models, one per trace: aliases, links, types, overridden evidence, off-by-one pairs and probes."""
    f = T.model_facts(spark, sf)
    a1, a2, none = F.col("a1"), F.col("a2"), F.lit(None).cast("bigint")
    fact = lambda pred, x, y, z: F.struct(F.lit(pred).alias("pred"), x.alias("a1"), y.alias("a2"), z.alias("a3"))
    is_pair = F.col("pred").isin("link", "alias", "badAlias")
    near = is_pair & (F.abs(a1 - a2) == 1)
    made = F.array(
        F.when(F.col("pred").isin("link", "type", "badAlias"), F.struct("pred", "a1", "a2", "a3")),
        F.when(is_pair, fact("alias", a1, a2, F.lit("rule"))),
        F.when(near, fact("offbyone", a1, a2, F.lit(""))), F.when(near, fact("offbyone", a2, a1, F.lit(""))),
        F.when(is_pair, fact("tr", a1, none, a1.cast("string"))),
        F.when(is_pair, fact("rr", a2, 1 + a2 % 2, a1.cast("string"))))
    return f.select("model", F.explode(made).alias("e")).where("e IS NOT NULL").select("model", "e.*")


_V = "WITH " + SQL["facts"] + """, pair AS (SELECT model, a1, a2 FROM mf WHERE pred IN ('link', 'alias', 'badAlias')),
 ob AS (SELECT DISTINCT model, a1 AS x, a2 AS y FROM pair WHERE abs(a1 - a2) = 1 UNION SELECT model, a2, a1 FROM pair WHERE abs(a1 - a2) = 1), al AS (SELECT DISTINCT model, a1 AS x, a2 AS y FROM pair),
 lk AS (SELECT DISTINCT model, a1 AS x, a2 AS y, a3 FROM mf WHERE pred = 'link'), prb AS (SELECT DISTINCT model, a1 AS x, a2 AS y FROM pair),
 vr AS (SELECT al.model, 'alias_link' AS rule FROM al JOIN lk ON al.model = lk.model AND al.x = lk.x AND al.y = lk.y UNION ALL SELECT al.model, 'alias_link' FROM al JOIN lk ON al.model = lk.model AND al.x = lk.y AND al.y = lk.x
  UNION ALL SELECT al.model, 'offbyone_alias' FROM al JOIN ob USING (model, x, y) UNION ALL SELECT o.model, 'offbyone_alias' FROM ob o JOIN al a ON a.model = o.model AND a.x = o.x JOIN al b ON b.model = o.model AND b.x = a.y AND b.y = o.y
  UNION ALL SELECT o.model, 'offbyone_alias' FROM ob o JOIN al a ON a.model = o.model AND a.x = o.x JOIN al b ON b.model = o.model AND b.y = a.y AND b.x = o.y UNION ALL SELECT o.model, 'offbyone_alias' FROM ob o JOIN al a ON a.model = o.model AND a.y = o.x JOIN al b ON b.model = o.model AND b.x = a.x AND b.y = o.y
  UNION ALL SELECT o.model, 'offbyone_link' FROM ob o JOIN prb p ON p.model = o.model AND p.x = o.x AND p.y = o.y WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.model = o.model AND lk.x = o.y AND lk.y = o.x AND lk.a3 = '1')
  UNION ALL SELECT model, 'type_n' FROM (SELECT DISTINCT model, a1 FROM mf WHERE pred = 'type' AND a3 = 'n')
  UNION ALL SELECT model, CASE a3 WHEN 'mercatorsource' THEN 'bad_alias_merc' WHEN 'name' THEN 'bad_alias_name' ELSE 'bad_alias' END FROM (SELECT DISTINCT model, a1, a2, a3 FROM mf WHERE pred = 'badAlias')),
 vio AS (SELECT model, CASE WHEN rule = 'alias_link' THEN 10 ELSE 5 END AS level, rule, count(*) AS n FROM vr GROUP BY ALL),
 cost AS (SELECT m.model, CAST(coalesce(sum(n) FILTER (level = 10), 0) AS BIGINT) AS l10, CAST(0 AS BIGINT) AS l7, CAST(coalesce(sum(n * CASE rule WHEN 'type_n' THEN 2 WHEN 'offbyone_alias' THEN 3 ELSE 1 END) FILTER (level = 5), 0) AS BIGINT) AS l5
   FROM (SELECT DISTINCT model FROM mf WHERE pred IN ('link', 'alias', 'badAlias', 'type')) m LEFT JOIN vio USING (model) GROUP BY m.model)"""
_W = {"type_n": 2, "offbyone_alias": 3}


@query("violations", _V + " SELECT * FROM vio")
def _(spark, sf):
    return C.violations(_candidates(spark, sf))


@query("model_cost", _V + " SELECT * FROM cost")
def _(spark, sf):
    return C.model_cost(_candidates(spark, sf), _W)


@query("best_model", _V + " SELECT src, m.model, l10, l7, l5 FROM (SELECT split_part(model, '-', 2) AS src, cost.*, row_number() OVER (PARTITION BY split_part(model, '-', 2) ORDER BY l10, l7, l5, model) AS i FROM cost) m WHERE i = 1")
def _(spark, sf):
    c = C.model_cost(_candidates(spark, sf), _W)
    return C.best_model(c.withColumn("src", F.split_part("model", F.lit("-"), F.lit(2))), ["src"])


@query("weight_sweep", _V + """, cd AS (SELECT split_part(model, '-', 2) AS test, model, CAST(split_part(model, '-', 3) AS BIGINT) % 3 = 0 AS golden FROM cost),
  pv AS (SELECT test, golden, cd.model, coalesce(sum(n) FILTER (rule = 'alias_link'), 0) AS al, coalesce(sum(n) FILTER (rule = 'type_n'), 0) AS tn, coalesce(sum(n) FILTER (rule = 'offbyone_alias'), 0) AS oa, coalesce(sum(n) FILTER (rule = 'offbyone_link'), 0) AS ol,
    coalesce(sum(n) FILTER (rule = 'bad_alias_merc'), 0) AS bm, coalesce(sum(n) FILTER (rule = 'bad_alias_name'), 0) AS bn, coalesce(sum(n) FILTER (rule = 'bad_alias'), 0) AS ba FROM cd LEFT JOIN vio USING (model) GROUP BY ALL),
  x AS (SELECT w1, w2, test, min((al, tn * w1 + oa * w2 + ol + bm + bn + ba)) FILTER (golden) AS g, min((al, tn * w1 + oa * w2 + ol + bm + bn + ba)) FILTER (NOT golden) AS b FROM pv, range(1, 4) a(w1), range(1, 3) c(w2) GROUP BY w1, w2, test)
  SELECT w1 AS w_type_n, w2 AS w_offbyone_alias, bool_and(coalesce(g IS NOT NULL AND (b IS NULL OR g < b), false)) AS passed, count(*) FILTER (NOT coalesce(g IS NOT NULL AND (b IS NULL OR g < b), false)) AS n_failed FROM x GROUP BY 1, 2""")
def _(spark, sf):
    f = _candidates(spark, sf)
    m = f.where("pred IN ('link', 'alias', 'badAlias', 'type')").select("model").distinct()
    part = lambda i: F.split_part("model", F.lit("-"), F.lit(i))
    cand = m.select(part(2).alias("test"), "model", (part(3).cast("bigint") % 3 == 0).alias("golden"))
    s = C.weight_sweep(C.violations(f), cand, {"type_n": (1, 3), "offbyone_alias": (1, 2)})
    return s.select("w_type_n", "w_offbyone_alias", "passed", "n_failed")
