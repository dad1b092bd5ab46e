"""Registered queries: merging models and settling contradictions."""

from pyspark.sql import functions as F

from ..operators import union as U
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL

M = "WITH " + SQL["facts"]
_C = M + """, lp AS (SELECT least(a1, a2) AS ip1, greatest(a1, a2) AS ip2, model, CAST(a3 AS INTEGER) AS ty FROM mf WHERE pred = 'link'),
 ap AS (SELECT least(a1, a2) AS ip1, greatest(a1, a2) AS ip2, model FROM mf WHERE pred = 'alias'),
 cf AS (SELECT * FROM (SELECT ip1, ip2, min(ty) AS link_type, count(DISTINCT model) AS n_link FROM lp GROUP BY 1, 2) JOIN (SELECT ip1, ip2, count(DISTINCT model) AS n_alias FROM ap GROUP BY 1, 2) USING (ip1, ip2) WHERE link_type <= 2),
 bel AS (SELECT DISTINCT ip1, ip2, 'link' AS side, model FROM lp WHERE (ip1, ip2) IN (SELECT (ip1, ip2) FROM cf) UNION ALL SELECT DISTINCT ip1, ip2, 'alias', model FROM ap WHERE (ip1, ip2) IN (SELECT (ip1, ip2) FROM cf)),
 bip AS (SELECT ip, count(*) AS n FROM (SELECT ip1 AS ip FROM cf UNION ALL SELECT ip2 FROM cf) GROUP BY ip),
 cn AS (SELECT model, pred, CASE WHEN pred IN ('alias', '-alias', 'badAlias', 'badNotAlias') THEN least(a1, a2) ELSE a1 END AS a1, CASE WHEN pred IN ('alias', '-alias', 'badAlias', 'badNotAlias') THEN greatest(a1, a2) ELSE a2 END AS a2, a3 FROM mf),
 sup AS (SELECT 'link' AS pred, a1, a2, CAST(min(CAST(a3 AS INTEGER)) AS VARCHAR) AS a3, count(DISTINCT a3) AS n_types, count(DISTINCT model) AS n_models FROM cn WHERE pred = 'link' GROUP BY a1, a2
   UNION ALL SELECT pred, a1, a2, k, NULL, n FROM (SELECT pred, a1, a2, count(DISTINCT model) AS n, list(DISTINCT a3) AS ks FROM cn WHERE pred IN ('alias', '-alias', 'badAlias') GROUP BY 1, 2, 3), unnest(ks) x(k)
   UNION ALL SELECT pred, a1, NULL, a3, NULL, count(DISTINCT model) FROM cn WHERE pred IN ('other', 'type') GROUP BY pred, a1, a3)"""


def _conf(spark, sf):
    f = T.model_facts(spark, sf)
    c = U.alias_link_conflicts(f)
    return f, c, U.conflict_believers(f, c)


@query("fact_support", _C + " SELECT * FROM sup")
def _(spark, sf):
    return U.fact_support(T.model_facts(spark, sf))


@query("alias_types", _C + " SELECT a1 AS ip1, a2 AS ip2, string_agg(DISTINCT a3, ',' ORDER BY a3) AS sources FROM cn WHERE pred = 'alias' GROUP BY a1, a2")
def _(spark, sf):
    return U.alias_types(T.model_facts(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("exclude_rrend", M + """, t AS (SELECT DISTINCT model, a1 AS ip FROM mf WHERE pred = 'other' AND a3 = 'rrend'), x AS (SELECT * FROM mf WHERE NOT (pred = 'alias' AND ((model, a1) IN (SELECT (model, ip) FROM t) OR (model, a2) IN (SELECT (model, ip) FROM t))))
  SELECT pred, count(*) AS n, CAST(sum(a1) AS BIGINT) AS s FROM x GROUP BY pred""")
def _(spark, sf):
    return U.exclude_rrend(T.model_facts(spark, sf)).groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.sum("a1").alias("s"))


@query("alias_link_conflicts", _C + " SELECT * FROM cf")
def _(spark, sf):
    return _conf(spark, sf)[1]


@query("conflict_believers", _C + " SELECT * FROM bel")
def _(spark, sf):
    return _conf(spark, sf)[2]


@query("conflicted_ips", _C + " SELECT * FROM bip")
def _(spark, sf):
    return U.conflicted_ips(_conf(spark, sf)[1])


@query("bad_traces", _C + " SELECT model, count(*) AS n FROM bel GROUP BY model")
def _(spark, sf):
    return U.bad_traces(_conf(spark, sf)[2])


@query("models_to_fix", _C + " SELECT DISTINCT model FROM bel")
def _(spark, sf):
    return U.models_to_fix(_conf(spark, sf)[2])


@query("bad_traces_by_source", _C + " SELECT split_part(model, '-', 2) AS source, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM bel) AS pct FROM bel GROUP BY 1")
def _(spark, sf):
    return U.bad_traces_by_source(U.bad_traces(_conf(spark, sf)[2]))


@query("good_facts", _C + " SELECT * FROM sup WHERE a1 NOT IN (SELECT ip FROM bip) AND (a2 IS NULL OR a2 NOT IN (SELECT ip FROM bip))")
def _(spark, sf):
    return U.good_facts(T.model_facts(spark, sf)).select("pred", "a1", "a2", "a3", "n_types", "n_models")


@query("fact_provenance", _C + " SELECT pred, a1, a2, a3, array_to_string(list_sort(list(DISTINCT model))[1:6], ' ') AS models FROM cn GROUP BY pred, a1, a2, a3")
def _(spark, sf):
    return U.fact_provenance(T.model_facts(spark, sf)).withColumn("models", F.array_join("models", " "))


def _typed(spark, sf):
    """Solver input of each trace as typed rows: probes, recorded entries, pairs, links and tags."""
    b = T._base(spark, sf)
    pid = F.concat(F.col("src").cast("string"), F.lit("_"), F.col("ttl").cast("string"))
    nxt = F.concat(F.col("src").cast("string"), F.lit("_"), (F.col("ttl") + 1).cast("string"))
    none = F.lit(None)
    row = lambda p, i1, i2, a, c: F.struct(F.lit(p).alias("pred"), i1.cast("bigint").alias("ip1"), i2.cast("bigint").alias("ip2"), a.cast("string").alias("id1"), c.cast("string").alias("id2"))
    r, two = F.col("tr_resp"), F.col("tr_resp") + 1 + F.col("part") % 3
    rows = F.array(row("tr", r, none, pid, none), row("potentialProbePair", none, none, pid, nxt), row("rr", two, none, pid, none),
                   row("link", r, two, none, none), row("other", r, none, none, none))
    return b.select(F.col("trace").cast("string").alias("model"), F.explode(rows).alias("r")).select("model", "r.*")


@query("conflicted_facts", _C + f""", ty AS (SELECT CAST(trace AS VARCHAR) AS model, p AS pred, CASE p WHEN 'rr' THEN tr_resp + 1 + part % 3 WHEN 'potentialProbePair' THEN NULL ELSE tr_resp END AS ip1,
    CASE WHEN p = 'link' THEN tr_resp + 1 + part % 3 END AS ip2, CASE WHEN p IN ('tr', 'rr', 'potentialProbePair') THEN src || '_' || ttl END AS id1, CASE WHEN p = 'potentialProbePair' THEN src || '_' || (ttl + 1) END AS id2
    FROM base, unnest(['tr', 'potentialProbePair', 'rr', 'link', 'other']) x(p)),
  ids AS (SELECT DISTINCT model, id1 AS id FROM ty WHERE pred IN ('tr', 'rr') AND ip1 IN (SELECT ip FROM bip))
  SELECT pred, count(*) AS n, count(DISTINCT model) AS m FROM ty WHERE (pred IN ('link', 'other') AND (ip1 IN (SELECT ip FROM bip) OR (pred = 'link' AND ip2 IN (SELECT ip FROM bip))))
   OR (pred NOT IN ('link', 'other') AND ((model, id1) IN (SELECT (model, id) FROM ids) OR (id2 IS NOT NULL AND (model, id2) IN (SELECT (model, id) FROM ids)))) GROUP BY pred""")
def _(spark, sf):
    d = U.conflicted_facts(_typed(spark, sf), U.conflicted_ips(_conf(spark, sf)[1]))
    return d.groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("m"))


@query("resolve_by_vote", _C + """, v AS (SELECT ip1, ip2, side, least(count(DISTINCT split_part(model, '-', 2)), count(DISTINCT split_part(model, '-', 3))) AS vote FROM bel GROUP BY 1, 2, 3),
  g AS (SELECT ip1, ip2, coalesce(max(vote) FILTER (side = 'link'), 0) AS link_votes, coalesce(max(vote) FILTER (side = 'alias'), 0) AS alias_votes FROM v GROUP BY 1, 2)
  SELECT *, CASE WHEN alias_votes > link_votes THEN 'alias' WHEN link_votes > alias_votes THEN 'link' ELSE 'TIE' END AS winner, greatest(link_votes, alias_votes) / (link_votes + alias_votes) AS share FROM g""")
def _(spark, sf):
    return U.resolve_by_vote(_conf(spark, sf)[2])


@query("characterize_conflicts", _C + """, t AS (SELECT DISTINCT model, a1 AS ip FROM mf WHERE pred = 'other' AND a3 = 'rrend'), h AS (SELECT *, (model, ip1) IN (SELECT (model, ip) FROM t) OR (model, ip2) IN (SELECT (model, ip) FROM t) AS o FROM bel),
  g AS (SELECT ip1, ip2, coalesce(100.0 * avg(o::INT) FILTER (side = 'link'), 0) AS link_pct, coalesce(100.0 * avg(o::INT) FILTER (side = 'alias'), 0) AS alias_pct, count(*) FILTER (side = 'link') AS n_link, count(*) FILTER (side = 'alias') AS n_alias FROM h GROUP BY 1, 2)
  SELECT *, greatest(link_pct, alias_pct) / CASE WHEN least(link_pct, alias_pct) = 0 THEN 0.001 ELSE least(link_pct, alias_pct) END AS certainty FROM g""")
def _(spark, sf):
    f, _, b = _conf(spark, sf)
    return U.characterize_conflicts(b, f)


_REP = _C + ", rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip1, ip2, side ORDER BY model) AS i FROM bel) WHERE i <= 3), rf AS (SELECT DISTINCT ip1, ip2, pred, a1, a2, a3 FROM (SELECT DISTINCT ip1, ip2, model FROM rep) JOIN mf USING (model))"


@query("faction_representatives", _REP + " SELECT * FROM rf")
def _(spark, sf):
    f, _, b = _conf(spark, sf)
    return U.representative_facts(U.faction_representatives(b, 3), f)


def _solved(spark, sf):
    """Facts of one re-solve per conflict: those of the first believer of either side."""
    f, c, b = _conf(spark, sf)
    rep = U.faction_representatives(b, 1).where("(ip1 + ip2) % 3 <> 0 OR side = 'link'")
    return c, U.representative_facts(rep, f)


_RES = _REP.replace("i <= 3", "i <= 1 AND ((ip1 + ip2) % 3 <> 0 OR side = 'link')") + """, s AS (SELECT ip1, ip2, bool_or(pred = 'link') AS l, bool_or(pred = 'alias') AS a FROM rf WHERE pred IN ('link', 'alias') AND least(a1, a2) = ip1 AND greatest(a1, a2) = ip2 GROUP BY 1, 2),
  res AS (SELECT ip1, ip2, CASE WHEN l AND a THEN 'multiple' WHEN a THEN 'alias' WHEN l THEN 'link' ELSE 'none' END AS outcome, CASE WHEN l AND NOT a THEN 0 END AS link_type FROM cf LEFT JOIN s USING (ip1, ip2))"""


@query("resolve_from_models", _RES + " SELECT * FROM res")
def _(spark, sf):
    return U.resolve_from_models(*_solved(spark, sf))


@query("outcome_counts", _RES + " SELECT outcome, count(*) AS n FROM res GROUP BY outcome")
def _(spark, sf):
    return U.outcome_counts(U.resolve_from_models(*_solved(spark, sf)))


@query("facts_to_potentials", M + " SELECT CASE pred WHEN 'link' THEN 'potentialLink' WHEN 'alias' THEN 'potentialAlias' WHEN '-alias' THEN 'potentialNotAlias' ELSE pred END AS pred, a1, a2, a3, count(*) AS n FROM mf WHERE pred IN ('link', 'alias', '-alias', 'other') GROUP BY ALL")
def _(spark, sf):
    return U.facts_to_potentials(T.model_facts(spark, sf)).groupBy("pred", "a1", "a2", "a3").agg(F.count(F.lit(1)).alias("n"))


@query("prefer_fixed_model", """SELECT o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 3 = 0 AND CAST(floor(o_totalprice) AS BIGINT) % 100 > 42 THEN 'fixed-' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'clique-' || o_orderkey END AS path FROM orders""")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.floor("o_totalprice") % 100).alias("size"))
    path = lambda k: F.concat(F.lit(k), F.col("dst").cast("string")).alias("path")
    return U.prefer_fixed_model(o.select("src", "dst"), o.where("dst % 3 = 0").select("*", path("fixed-")), o.where("dst % 2 = 0").select("*", path("clique-")))
