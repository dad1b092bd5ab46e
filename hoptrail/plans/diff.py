"""Registered queries: comparisons of addresses, alias pairs and graphs."""

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import graph as G
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL

_IPS = f"""l AS (SELECT DISTINCT l_partkey + {ROUTER_BASE} AS ip FROM lineitem WHERE l_partkey % 2 = 0), r AS (SELECT DISTINCT l_partkey + {ROUTER_BASE} AS ip FROM lineitem WHERE l_partkey % 2 = 1 OR l_partkey % 3 = 0)"""


def _part_ips(spark, sf, cond):
    return T.table(spark, sf, "lineitem").where(cond).select((F.col("l_partkey") + ROUTER_BASE).alias("ip")).distinct()


@query("diff_ips", "WITH " + _IPS + " SELECT ip, '-' AS side FROM l WHERE ip NOT IN (FROM r) UNION ALL SELECT ip, '+' FROM r WHERE ip NOT IN (FROM l)")
def _(spark, sf):
    return D.diff_ips(_part_ips(spark, sf, "l_partkey % 2 = 0"), _part_ips(spark, sf, "l_partkey % 2 = 1 OR l_partkey % 3 = 0"))


def _pairs(spark, sf, cond):
    return T.table(spark, sf, "lineitem").where(cond).select(
        (F.col("l_suppkey") + ROUTER_BASE).alias("ip1"), (F.col("l_partkey") + ROUTER_BASE).alias("ip2"))


def _p(cond, name):
    return f"{name} AS (SELECT DISTINCT least(l_suppkey, l_partkey) + {ROUTER_BASE} AS ip1, greatest(l_suppkey, l_partkey) + {ROUTER_BASE} AS ip2 FROM lineitem WHERE {cond})"


# three overlapping parts that together hold every row
_C = ["l_partkey % 3 <> 0 OR l_partkey % 30 = 0 AND l_orderkey % 2 = 0", "l_orderkey % 2 = 0", "l_partkey % 3 <> 1 OR l_partkey % 30 = 1 AND l_orderkey % 2 = 0"]
_L, _M, _R = (_p(c, n) for c, n in zip(_C, "lmr"))
_LI = ", li AS (SELECT ip1 AS ip FROM l UNION SELECT ip2 FROM l), ri AS (SELECT ip1 AS ip FROM r UNION SELECT ip2 FROM r)"


@query("diff_aliases", f"WITH {_L}, {_R}{_LI} SELECT ip1, ip2, 'both' AS side FROM (FROM l INTERSECT FROM r) UNION ALL SELECT ip1, ip2, 'left' FROM (FROM l EXCEPT FROM r) WHERE ip1 IN (FROM ri) AND ip2 IN (FROM ri) UNION ALL SELECT ip1, ip2, 'right' FROM (FROM r EXCEPT FROM l) WHERE ip1 IN (FROM li) AND ip2 IN (FROM li)")
def _(spark, sf):
    return D.diff_aliases(_pairs(spark, sf, _C[0]), _pairs(spark, sf, _C[2]))


@query("diff_aliases_skipped", f"WITH {_L}, {_R}{_LI} SELECT DISTINCT ip, 'left' AS side FROM (SELECT unnest([ip1, ip2]) AS ip FROM (FROM l EXCEPT FROM r)) WHERE ip NOT IN (FROM ri) UNION ALL SELECT DISTINCT ip, 'right' FROM (SELECT unnest([ip1, ip2]) AS ip FROM (FROM r EXCEPT FROM l)) WHERE ip NOT IN (FROM li)")
def _(spark, sf):
    return D.skipped_ips(_pairs(spark, sf, _C[0]), _pairs(spark, sf, _C[2]))


_3 = f"WITH {_L}, {_M}, {_R}, t AS (SELECT *, 1 AS b FROM l UNION ALL SELECT *, 2 FROM m UNION ALL SELECT *, 4 FROM r), k AS (SELECT ip1, ip2, CAST(bit_or(b) AS INTEGER) AS mask FROM t GROUP BY ALL), i AS (SELECT ip, CAST(bit_or(b) AS INTEGER) AS mask FROM (SELECT ip1 AS ip, b FROM t UNION ALL SELECT ip2, b FROM t) GROUP BY ip)"


def _three(spark, sf):
    return [_pairs(spark, sf, c) for c in _C]


@query("diff_aliases3", _3 + " SELECT * FROM k WHERE ip1 IN (SELECT ip FROM i WHERE mask = 7) AND ip2 IN (SELECT ip FROM i WHERE mask = 7)")
def _(spark, sf):
    return D.diff_aliases3(*_three(spark, sf))


@query("diff_aliases3_raw", _3 + " SELECT * FROM k")
def _(spark, sf):
    return D.diff_aliases3(*_three(spark, sf), raw=True)


@query("diff_aliases3_ips", _3 + " SELECT * FROM i")
def _(spark, sf):
    return D.diff_ips3(*_three(spark, sf))


def _graph(spark, sf, routers, which):
    a = G.alias_pairs_from_sets(routers).select(F.lit("alias").alias("item"), "ip1", "ip2", F.lit(0).alias("link_type"))
    return a.unionByName(T.graph_links(spark, sf, which).select(F.lit("link").alias("item"), "ip1", "ip2", "link_type"))


_G = SQL["truth"] + ", " + SQL["observed"] + ", " + SQL["links_observed"] + ", " + SQL["links_truth"] + """,
 l AS (SELECT 'alias' AS item, a.ip AS ip1, b.ip AS ip2 FROM truth a JOIN truth b ON a.router = b.router AND a.ip < b.ip UNION SELECT 'link', ip1, ip2 FROM lt),
 r AS (SELECT 'alias' AS item, a.ip AS ip1, b.ip AS ip2 FROM observed a JOIN observed b ON a.router = b.router AND a.ip < b.ip UNION SELECT 'link', ip1, ip2 FROM lo),
 li AS (SELECT ip1 AS ip FROM l UNION SELECT ip2 FROM l), ri AS (SELECT ip1 AS ip FROM r UNION SELECT ip2 FROM r)"""


@query("diff_graphs", "WITH " + _G + """ SELECT 'REMOVING' AS op, item, ip1, ip2 FROM (FROM l EXCEPT FROM r) WHERE ip1 IN (FROM ri) AND ip2 IN (FROM ri)
  UNION ALL SELECT 'ADDING', item, ip1, ip2 FROM (FROM r EXCEPT FROM l) WHERE ip1 IN (FROM li) AND ip2 IN (FROM li) UNION ALL SELECT 'COMMON', item, ip1, ip2 FROM (FROM l INTERSECT FROM r)
  UNION ALL SELECT 'REMOVING', 'ip', ip, NULL FROM li WHERE ip NOT IN (FROM ri) UNION ALL SELECT 'ADDING', 'ip', ip, NULL FROM ri WHERE ip NOT IN (FROM li)""")
def _(spark, sf):
    return D.diff_graphs(_graph(spark, sf, T.routers_true(spark, sf), "truth"), _graph(spark, sf, T.routers_observed(spark, sf), "observed"), common=True)


_OBR = SQL["links_observed"] + ", " + SQL["observed"] + """, x AS (SELECT lo.*, coalesce(a.router, CAST(ip1 AS VARCHAR)) AS r1, coalesce(b.router, CAST(ip2 AS VARCHAR)) AS r2 FROM lo LEFT JOIN observed a ON ip1 = a.ip LEFT JOIN observed b ON ip2 = b.ip)"""


@query("graph_subset", "WITH " + _OBR + f""", hit AS (SELECT DISTINCT router FROM observed WHERE ip >> 4 = {(ROUTER_BASE + 32) >> 4}), l AS (SELECT * FROM x WHERE ip1 >> 4 = {(ROUTER_BASE + 32) >> 4} OR ip2 >> 4 = {(ROUTER_BASE + 32) >> 4})
  SELECT router, ip FROM observed WHERE router IN (FROM hit) UNION SELECT r1, ip1 FROM l WHERE r1 NOT IN (FROM hit) UNION SELECT r2, ip2 FROM l WHERE r2 NOT IN (FROM hit)""")
def _(spark, sf):
    o = T.routers_observed(spark, sf)
    return D.graph_subset(o, G.link_ends(T.graph_links(spark, sf, "observed"), o), [(ROUTER_BASE + 32, 28)])[0]


@query("graph_subset_links", "WITH " + _OBR + f" SELECT r1, ip1, r2, ip2, link_type FROM x WHERE ip1 >> 4 = {(ROUTER_BASE + 32) >> 4} OR ip2 >> 4 = {(ROUTER_BASE + 32) >> 4}")
def _(spark, sf):
    o = T.routers_observed(spark, sf)
    return D.graph_subset(o, G.link_ends(T.graph_links(spark, sf, "observed"), o), [(ROUTER_BASE + 32, 28)])[1].select("r1", "ip1", "r2", "ip2", "link_type")


@query("union_facts", "SELECT l_suppkey AS a, l_linenumber AS b FROM lineitem WHERE l_quantity > 25 UNION SELECT l_partkey, l_linenumber FROM lineitem WHERE l_quantity <= 25")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return D.union_facts(li.where("l_quantity > 25").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").alias("b")),
                         li.where("l_quantity <= 25").select(F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("b")))


@query("subset_compare", "WITH " + _G + f""", t1 AS (SELECT ip, 'A' AS type FROM truth WHERE ip % 9 <> 0), t2 AS (SELECT ip, CASE WHEN ip % 4 = 0 THEN 'B' ELSE 'A' END AS type FROM observed), k AS (SELECT ip FROM t1),
  a AS (SELECT ip1, ip2, (ip1, ip2) IN (SELECT (ip1, ip2) FROM l WHERE item = 'alias') AS have FROM r WHERE item = 'alias' AND ip1 IN (FROM k)),
  n AS (SELECT ip1, ip2, (ip1, ip2) IN (SELECT (ip1, ip2) FROM lt) AS have FROM lo WHERE ip1 IN (FROM k) AND ip2 IN (FROM k)), t AS (SELECT t2.ip, t2.type, t1.type AS t1 FROM t2 LEFT JOIN t1 USING (ip)),
  o AS (SELECT 'aliases' AS what, count(*) AS total, count(*) FILTER (NOT have) AS missing FROM a UNION ALL SELECT 'links', count(*), count(*) FILTER (NOT have) FROM n
   UNION ALL SELECT 'types', count(t1), count(*) FILTER (t1 <> type) FROM t UNION ALL SELECT 'ips', count(*), count(*) FILTER (t1 IS NULL) FROM t)
  SELECT what, total, missing, CASE WHEN total > 0 THEN missing / total ELSE 0 END AS share FROM o""")
def _(spark, sf):
    tr, ob = T.routers_true(spark, sf), T.routers_observed(spark, sf)
    t1 = tr.where("ip % 9 <> 0").select("ip", F.lit("A").alias("type"))
    t2 = ob.select("ip", F.when(F.col("ip") % 4 == 0, "B").otherwise("A").alias("type"))
    return D.subset_compare(G.alias_pairs_from_sets(tr), T.graph_links(spark, sf, "truth"), t1, G.alias_pairs_from_sets(ob), T.graph_links(spark, sf, "observed"), t2)


@query("score_alias_labels", f"""WITH p AS (SELECT DISTINCT l_linestatus AS input, least(l_suppkey, l_partkey) AS ip1, greatest(l_suppkey, l_partkey) AS ip2 FROM lineitem),
  lab AS (SELECT least(l_suppkey, l_partkey) AS ip1, greatest(l_suppkey, l_partkey) AS ip2, min(CASE WHEN l_tax < 0.02 THEN 'bad' ELSE 'good' END) AS label FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
  SELECT input, count(*) FILTER (label = 'bad') AS bad, count(*) FILTER (label = 'good') AS good, count(*) AS total, 100.0 * count(*) FILTER (label = 'bad') / count(label) AS false_pct FROM p LEFT JOIN lab USING (ip1, ip2) GROUP BY input""".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    p = li.select(F.col("l_linestatus").alias("input"), F.col("l_suppkey").alias("ip1"), F.col("l_partkey").alias("ip2"))
    lab = li.where("l_quantity > 25").select(F.col("l_suppkey").alias("ip1"), F.col("l_partkey").alias("ip2"), F.when(F.col("l_tax") < 0.02, "bad").otherwise("good").alias("label"))
    return D.score_alias_labels(p, lab)


@query("attach_hostnames", "SELECT DISTINCT l_partkey AS ip, coalesce(s_name, '??') AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_partkey")
def _(spark, sf):
    ips = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ip")).distinct()
    return D.attach_hostnames(ips, T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ip"), F.col("s_name").alias("name")))
