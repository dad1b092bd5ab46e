"""Registered queries: components, searches, degrees, merged graphs."""

from pyspark.sql import functions as F

from ..operators import graph as G
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SOURCE_BASE, SQL

R_ = "WITH RECURSIVE "
# components by lowest reachable address, over undirected edges e(a, b)
_COMP = """n0 AS (SELECT DISTINCT ip FROM (SELECT a AS ip FROM e UNION ALL SELECT b FROM e)),
 rc AS (SELECT ip, ip AS r FROM n0 UNION SELECT e2.b, rc.r FROM rc JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) e2 ON e2.a = rc.ip WHERE rc.r < e2.b),
 comp AS (SELECT ip, min(r) AS root FROM rc GROUP BY ip)"""
_AL = SQL["aliases"] + ", e AS (SELECT ip1 AS a, ip2 AS b FROM al), " + _COMP


def _ends(spark, sf, which="all"):
    return G.link_ends(T.graph_links(spark, sf, which), T.routers_observed(spark, sf))


_ENDS = SQL["links"] + ", " + SQL["observed"] + """, ends AS (SELECT lk.*, coalesce(a.router, CAST(ip1 AS VARCHAR)) AS r1, coalesce(b.router, CAST(ip2 AS VARCHAR)) AS r2
  FROM lk LEFT JOIN observed a ON ip1 = a.ip LEFT JOIN observed b ON ip2 = b.ip),
 deg AS (SELECT router, count(*) AS degree FROM (SELECT r1 AS router FROM ends WHERE link_type <> 4 UNION ALL SELECT r2 FROM ends WHERE link_type <> 4) GROUP BY router)"""


@query("connected_components", R_ + _AL + " SELECT ip, root FROM comp")
def _(spark, sf):
    return G.connected_components(T.alias_pairs_small(spark, sf))


@query("alias_pairs_from_sets", R_ + SQL["truth"] + " SELECT a.router, a.ip AS ip1, b.ip AS ip2 FROM truth a JOIN truth b ON a.router = b.router AND a.ip < b.ip")
def _(spark, sf):
    return G.alias_pairs_from_sets(T.routers_true(spark, sf))


@query("transitive_aliases", R_ + _AL + """, s AS (SELECT root, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM al JOIN comp ON al.ip1 = comp.ip GROUP BY root),
  own AS (SELECT ip1, ip2, string_agg(DISTINCT source, ',' ORDER BY source) AS own FROM al GROUP BY ALL)
  SELECT a.ip AS ip1, b.ip AS ip2, own IS NULL AS derived, coalesce(own, sources) AS sources FROM comp a JOIN comp b ON a.root = b.root AND a.ip < b.ip JOIN s ON s.root = a.root
  LEFT JOIN own ON own.ip1 = a.ip AND own.ip2 = b.ip""")
def _(spark, sf):
    return G.transitive_aliases(T.alias_pairs_small(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("transitive_classes", R_ + _AL + """ SELECT comp.root, comp.ip, sources FROM comp JOIN (SELECT root, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM al JOIN comp ON al.ip1 = comp.ip GROUP BY root) USING (root)""")
def _(spark, sf):
    return G.transitive_classes(T.alias_pairs_small(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("degree_distribution", R_ + _ENDS + " SELECT router, degree, row_number() OVER (ORDER BY degree, router) - 1 AS rank, 100.0 * (row_number() OVER (ORDER BY degree, router) - 1) / count(*) OVER () AS pct FROM deg")
def _(spark, sf):
    return G.degree_distribution(_ends(spark, sf))


_SRC = "router IN (SELECT router FROM observed WHERE (ip - %d) %% 37 = 0)" % ROUTER_BASE


def _sources(spark, sf):
    return T.routers_observed(spark, sf).where((F.col("ip") - ROUTER_BASE) % 37 == 0).select("router").distinct()


@query("degree_ccdf", R_ + _ENDS + f", d2 AS (SELECT * FROM deg WHERE NOT {_SRC}) SELECT router, degree, row_number() OVER (ORDER BY degree, router) - 1 AS rank, 100 - 100.0 * (row_number() OVER (ORDER BY degree, router) - 1) / count(*) OVER () AS pct FROM d2")
def _(spark, sf):
    return G.degree_distribution(_ends(spark, sf), _sources(spark, sf), True)


_BFS = _ENDS + f""", u AS (SELECT DISTINCT r1 AS a, r2 AS b FROM ends WHERE link_type <> 4 AND r1 <> r2 UNION SELECT DISTINCT r2, r1 FROM ends WHERE link_type <> 4 AND r1 <> r2),
 w AS (SELECT router, 0 AS dist FROM (SELECT DISTINCT router FROM observed WHERE {_SRC}) UNION SELECT u.b, dist + 1 FROM w JOIN u ON u.a = w.router WHERE dist < (SELECT count(DISTINCT a) FROM u)),
 dd AS (SELECT router, min(dist) AS dist FROM w GROUP BY router)"""


@query("degree_bias", R_ + _BFS + """, ad AS (SELECT DISTINCT r1 AS a, r2 AS b FROM ends WHERE link_type <> 4 UNION SELECT DISTINCT r2, r1 FROM ends WHERE link_type <> 4),
  g AS (SELECT a AS router, count(*) AS degree FROM ad GROUP BY a), x AS (SELECT g.*, coalesce(dist, 1073741824) AS dist FROM g LEFT JOIN dd USING (router)),
  md AS (SELECT dist AS m FROM (SELECT dist, row_number() OVER (ORDER BY dist) - 1 AS i, count(*) OVER () AS n FROM x) WHERE i = n // 2),
  z AS (SELECT 'all' AS series, x.* FROM x UNION ALL SELECT CASE WHEN dist < m THEN 'near' ELSE 'far' END, x.* FROM x, md)
  SELECT series, router, degree, CAST(dist AS INTEGER) AS dist, 1 - (row_number() OVER (PARTITION BY series ORDER BY degree, dist, router) - 1) / (count(*) OVER (PARTITION BY series)) AS p FROM z WHERE dist > 0 AND dist < 1073741824""")
def _(spark, sf):
    return G.degree_bias(_ends(spark, sf), _sources(spark, sf))


@query("bfs_distance", R_ + _BFS + " SELECT router, dist FROM dd")
def _(spark, sf):
    e = _ends(spark, sf).where("link_type <> 4").select(F.col("r1").alias("a"), F.col("r2").alias("b"))
    return G.bfs(e, _sources(spark, sf))


@query("rr_coverage", R_ + _BFS.replace("dist < (SELECT count(DISTINCT a) FROM u)", "dist < 9") + """, k AS (SELECT r1 AS r FROM ends WHERE link_type <= 2 UNION SELECT r2 FROM ends WHERE link_type <= 2)
  SELECT t AS total, f AS n_flood, 100.0 * f / t AS pct_flood, c AS n_close, 100.0 * c / t AS pct_close FROM (SELECT (SELECT count(DISTINCT router) FROM observed) AS t, (SELECT count(*) FROM dd) AS f, (SELECT count(*) FROM k) AS c)""")
def _(spark, sf):
    v = T.routers_observed(spark, sf).where((F.col("ip") - ROUTER_BASE) % 37 == 0).select("ip")
    return G.rr_coverage(T.routers_observed(spark, sf), _ends(spark, sf), v)


_TL = ["A", "B", "N", "U", "C", "MPLS"]


def _typed(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in _TL]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return T.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("router")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 10, t))).alias("types"))


_TYPED = f"tp AS (SELECT l_partkey AS router, coalesce(list_sort(list_distinct(list(CASE WHEN l_quantity > 10 THEN {_TL}[1 + l_suppkey % 6] END))), []) AS types FROM lineitem GROUP BY 1)"


@query("router_type_histogram", "WITH " + _TYPED + " SELECT array_to_string(types, '_') AS type, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM tp WHERE len(types) > 0) AS pct FROM tp GROUP BY 1")
def _(spark, sf):
    return G.router_type_histogram(_typed(spark, sf))


@query("router_type_histogram_simple", "WITH " + _TYPED + """, h AS (SELECT list_contains(types, 'A') AS a, list_contains(types, 'B') AS b, list_contains(types, 'N') AS n, list_contains(types, 'U') AS u, list_contains(types, 'C') AS c, list_contains(types, 'MPLS') AS m FROM tp),
  l AS (SELECT 'A_B' AS type FROM h WHERE a AND b UNION ALL SELECT 'A' FROM h WHERE a AND NOT b UNION ALL SELECT 'B' FROM h WHERE b AND NOT a UNION ALL SELECT 'U' FROM h WHERE u AND NOT (a OR b OR c)
   UNION ALL SELECT CASE WHEN a THEN 'A_N' WHEN b THEN 'B_N' WHEN c THEN 'C_N' ELSE 'N' END FROM h WHERE n UNION ALL SELECT 'C' FROM h WHERE c UNION ALL SELECT 'MPLS' FROM h WHERE m)
  SELECT type, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM tp WHERE len(types) > 0) AS pct FROM l GROUP BY 1""")
def _(spark, sf):
    return G.router_type_histogram(_typed(spark, sf), True)


_LBL = ["source", "nat", "endhost", "hidden", "mpls", "lazy", "flaky"]


@query("router_label", f"""WITH m AS (SELECT l_partkey AS router, {_LBL}[1 + l_partkey % 7] AS tag, CASE (l_partkey // 7 + l_linenumber // 4) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'n' END AS type FROM lineitem),
  k AS (SELECT router, CASE WHEN bool_or(tag = 'source') THEN 'S' WHEN bool_or(tag = 'nat') THEN 'N' WHEN bool_or(tag = 'endhost') THEN 'E' WHEN bool_or(tag = 'hidden') THEN 'H' ELSE 'R' END AS kind,
   string_agg(DISTINCT upper(type), '_' ORDER BY upper(type)) AS ty, string_agg(DISTINCT upper(tag), '_' ORDER BY upper(tag)) FILTER (tag IN ('mpls', 'lazy', 'flaky')) AS ot FROM m GROUP BY router)
  SELECT router, concat_ws('_', kind || CAST(router AS VARCHAR), ty, ot) AS label FROM k""")
def _(spark, sf):
    turn = (F.floor(F.col("l_partkey") / 7) + F.floor(F.col("l_linenumber") / 4)) % 3
    m = T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("router"), F.lit(0).alias("ip"), F.element_at(F.array(*[F.lit(x) for x in _LBL]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("tag"),
        F.when(turn == 0, "a").when(turn == 1, "b").otherwise("n").alias("type"))
    return G.router_label(m)


_MERGE = SQL["truth"] + ", " + SQL["observed"] + ", " + SQL["links_observed"] + ", " + SQL["links_truth"] + """,
 sets AS (SELECT 'a' || router AS router, ip FROM truth UNION ALL SELECT 'b' || router, ip FROM observed),
 e AS (SELECT min(ip) OVER (PARTITION BY router) AS a, ip AS b FROM sets), """ + _COMP + ", bl AS (SELECT ip1, ip2, min(link_type) AS link_type FROM (FROM lo UNION ALL FROM lt) GROUP BY ALL)"


def _merge_in(spark, sf):
    t = T.routers_true(spark, sf).select(F.lit("a").alias("graph"), "router", "ip")
    o = T.routers_observed(spark, sf).select(F.lit("b").alias("graph"), "router", "ip")
    return t.unionByName(o), T.graph_links(spark, sf, "observed").unionByName(T.graph_links(spark, sf, "truth"))


@query("merge_adjacency", R_ + _MERGE + " SELECT coalesce(a.root, ip1) AS r1, ip1, coalesce(b.root, ip2) AS r2, ip2, link_type FROM bl LEFT JOIN comp a ON a.ip = ip1 LEFT JOIN comp b ON b.ip = ip2")
def _(spark, sf):
    return G.merge_adjacency(*_merge_in(spark, sf))[1]


@query("merge_adjacency_routers", R_ + _MERGE + " SELECT ip, root FROM comp")
def _(spark, sf):
    return G.merge_adjacency(*_merge_in(spark, sf))[0]


@query("merge_links_aliases", R_ + SQL["truth"] + ", " + SQL["observed"] + ", " + SQL["links_observed"] + """, used AS (SELECT ip FROM observed UNION SELECT ip1 FROM lo UNION SELECT ip2 FROM lo),
  sets AS (SELECT 's' || router AS router, ip FROM truth WHERE ip IN (FROM used) UNION ALL SELECT 'g' || router, ip FROM observed), e AS (SELECT min(ip) OVER (PARTITION BY router) AS a, ip AS b FROM sets), """ + _COMP + """
  SELECT coalesce(a.root, ip1) AS r1, ip1, coalesce(b.root, ip2) AS r2, ip2, link_type FROM lo LEFT JOIN comp a ON a.ip = ip1 LEFT JOIN comp b ON b.ip = ip2""")
def _(spark, sf):
    return G.merge_links_aliases(T.routers_observed(spark, sf), T.graph_links(spark, sf, "observed"), T.routers_true(spark, sf))[1]


@query("contract_stub_as", R_ + _ENDS + f""", asn AS (SELECT s_suppkey + {ROUTER_BASE} AS ip, CAST(s_suppkey // 10 AS VARCHAR) AS asn FROM supplier WHERE s_suppkey >= 10),
  stub AS (SELECT DISTINCT asn FROM asn WHERE (ip - {ROUTER_BASE}) % 37 = 0), mk AS (SELECT * FROM asn WHERE asn IN (FROM stub)),
  wh AS (SELECT router, 'AS' || min(asn) AS node FROM observed o LEFT JOIN mk ON o.ip = mk.ip GROUP BY router HAVING count(*) = count(asn) AND min(asn) = max(asn)),
  x AS (SELECT coalesce('AS' || a.asn, n1.node, r1) AS a, coalesce('AS' || b.asn, n2.node, r2) AS b FROM ends LEFT JOIN mk a ON a.ip = ip1 LEFT JOIN mk b ON b.ip = ip2 LEFT JOIN wh n1 ON n1.router = r1 LEFT JOIN wh n2 ON n2.router = r2 WHERE link_type <> 4 AND ip1 <> ip2)
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM x WHERE a <> b""")
def _(spark, sf):
    asn = T.table(spark, sf, "supplier").where("s_suppkey >= 10").select(
        (F.col("s_suppkey") + ROUTER_BASE).alias("ip"), F.floor(F.col("s_suppkey") / 10).cast("string").alias("asn"))
    src = asn.where((F.col("ip") - ROUTER_BASE) % 37 == 0).select("ip")
    return G.contract_stub_as(T.routers_observed(spark, sf), _ends(spark, sf), asn, src)
