"""Registered queries: writers. Text writers show their lines; table writers write to scratch and read back."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import ensure_checkpoint_dir
from ..sinks import writers as S
from ..sources import text as X
from . import sources as Q
from . import tables as T
from .registry import query
from .tables import ROUTER_BASE, SQL

L = F.lit


def scratch(spark) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    import uuid
    return f"{base}/out-{uuid.uuid4().hex}"


def _fresh(spark, write):
    out = scratch(spark)
    write(out)
    return spark.read.parquet(out)


def _lines(spark, write):
    """What a writer of text left, line by line."""
    out = scratch(spark)
    write(out)
    return spark.read.text(out)


@query("write_traces", "WITH " + SQL["rr"] + " SELECT 'd' || ttl % 3 AS dataset, count(*) AS n, CAST(sum(len(rr)) AS BIGINT) AS entries, CAST(sum(resp) AS BIGINT) AS s FROM rrp GROUP BY 1")
def _(spark, sf):
    p = T.rr_probes(spark, sf).select("src", "dst", "ttl", "resp", "rr").withColumn("dataset", F.concat(L("d"), (F.col("ttl") % 3).cast("string")))
    d = _fresh(spark, lambda out: S.write_traces(p, out))
    return d.groupBy("dataset").agg(F.count(L(1)).alias("n"), F.sum(F.size("rr")).alias("entries"), F.sum("resp").alias("s"))


_EN = "WITH " + SQL["links"] + ", " + SQL["observed"] + """, ends AS (SELECT lk.*, coalesce(a.router, CAST(ip1 AS VARCHAR)) AS r1, coalesce(b.router, CAST(ip2 AS VARCHAR)) AS r2 FROM lk LEFT JOIN observed a ON ip1 = a.ip LEFT JOIN observed b ON ip2 = b.ip),
 bst AS (SELECT e.* FROM ends e JOIN (SELECT r1, r2, min(link_type) AS m FROM ends GROUP BY 1, 2) b ON e.r1 = b.r1 AND e.r2 = b.r2 AND link_type = m)"""
_NM = "['RR', 'STR', 'TR', 'UNKNOWN', 'HIDDEN'][link_type]"


def _graph(spark, sf):
    o = T.routers_observed(spark, sf)
    return o.withColumn("kind", L("Router")), G.link_ends(T.graph_links(spark, sf), o)


@query("write_adjacency", _EN + f""" SELECT 'Router ' || router || ' nAlly=' || count(*) || ' ' || string_agg(CAST(ip AS VARCHAR), ' ' ORDER BY CAST(ip AS VARCHAR) DESC) AS value FROM observed GROUP BY router
  UNION ALL SELECT 'Link  ' || r1 || ':' || ip1 || ' -- ' || r2 || ':' || ip2 || ' : ' || {_NM} FROM bst""")
def _(spark, sf):
    return _lines(spark, lambda out: S.write_adjacency(*_graph(spark, sf), out))


@query("write_facts", "SELECT 'tr(' || l_orderkey || ',' || l_linenumber || ',' || l_suppkey || ').' AS value FROM lineitem")
def _(spark, sf):
    return _lines(spark, lambda out: S.write_facts(T.table(spark, sf, "lineitem"), "tr", ["l_orderkey", "l_linenumber", "l_suppkey"], out))


@query("write_trace_facts", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS rr, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS BIGINT) AS id FROM orders)
  SELECT 'trace' AS pred, id, '10.0.0.1,10.9.' || o_custkey % 250 || '.7' AS args FROM o WHERE rr = 1 UNION ALL SELECT 'tr', id, l_linenumber || ',10.1.1.' || l_suppkey % 250 FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE rr = 0
  UNION ALL SELECT 'rr', id, '10.1.1.' || l_suppkey % 250 || ',' || l_linenumber || ',' || i || ',10.2.' || i || '.' || l_partkey % 250 FROM o JOIN lineitem ON l_orderkey = o_orderkey, range(1, 3) x(i) WHERE rr = 1""")
def _(spark, sf):
    z, s = L(0).cast("bigint"), lambda c: c.cast("string")
    k, n = F.col("o_orderkey"), F.col("l_partkey")
    file = L("f").alias("file")
    head = T.table(spark, sf, "orders").select(file, F.struct(k.alias("a"), z.alias("b"), z.alias("c")).alias("pos"), F.concat(
        L("10.0.0.1:35343-10.9."), s(F.col("o_custkey") % 250), L(".7:80 -\tSending train=0 type=DATA safettl=11 RR="), s(F.when(k % 2 == 0, 1).otherwise(0)), L(" rto=1")).alias("value"))
    rec = T.table(spark, sf, "lineitem").select(file, F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"), F.monotonically_increasing_id().alias("c")).alias("pos"), F.concat(
        L("- RECV TTL "), s(F.col("l_linenumber")), L(" it=0 from 10.1.1."), s(F.col("l_suppkey") % 250), L(" (255)\tROUTER\t rtt=0.1 s t=1.5 RR, hop 1 10.2.1."), s(n % 250), L(" , hop 2 10.2.2."), s(n % 250), L(" ,  Macro")).alias("value"))
    d = _lines(spark, lambda out: S.write_trace_facts(head.unionByName(rec), out))
    part = lambda i: F.regexp_extract("value", r"^(\w+)\((\d+),(.*)\)\.$", i)
    return d.select(part(1).alias("pred"), part(2).cast("bigint").alias("id"), part(3).alias("args"))


@query("load_alias_tables", "SELECT verdict, count(*) AS n, count(DISTINCT ip1) AS ips FROM (" + Q._VERDICTS + ") WHERE verdict <> 'UNKNOWN' GROUP BY verdict")
def _(spark, sf):
    d = _fresh(spark, lambda out: S.load_alias_tables(X.read_alias_verdicts(Q.verdict_lines(spark, sf)), out))
    return d.groupBy("verdict").agg(F.count(L(1)).alias("n"), F.count_distinct("ip1").alias("ips"))


@query("write_ttl_distance", "WITH " + SQL["ttl"] + " SELECT vantage, 2 * count(*) AS n FROM ttld GROUP BY vantage")
def _(spark, sf):
    def twice(out):
        S.write_ttl_distance(T.ttl_distance(spark, sf), out)
        S.write_ttl_distance(T.ttl_distance(spark, sf), out)
    return _fresh(spark, twice).groupBy("vantage").agg(F.count(L(1)).alias("n"))


def _drawing(spark, routers, links, **options):
    """The drawing as written; a line's part follows from how it starts."""
    v = F.col("value")
    node = v.contains("[fillcolor=") | v.startswith("subgraph ")
    part = F.when(v.contains("graph Internet {"), 0).when(v == "}", 3).when(node, 1).otherwise(2)
    return _lines(spark, lambda out: S.export_dot(routers, links, out, **options)).select(part.alias("part"), "value")


_CLR = "['blue', 'purple', 'black', 'orange', 'red'][link_type]"


@query("export_dot", _EN + f""" SELECT 0 AS part, 'graph Internet {{ rankdir=LR' AS value UNION ALL SELECT 3, '}}' UNION ALL SELECT 2, '"' || r1 || '":"' || ip1 || '" -- "' || r2 || '":"' || ip2 || '" [color=' || {_CLR} || ']' FROM ends WHERE link_type <> 4
  UNION ALL SELECT 1, '"' || router || '" [fillcolor=white,label = "' || router || ' ' || string_agg(' | <' || ip || '> ' || ip, '' ORDER BY CAST(ip AS VARCHAR)) || '"]' FROM observed GROUP BY router""")
def _(spark, sf):
    return _drawing(spark, *_graph(spark, sf), skip_unknown=True)


@query("export_dot_neato", _EN + f""", c AS (SELECT ip, sum(k) AS k FROM (SELECT ip1 AS ip, 1 AS k FROM ends UNION ALL SELECT ip2, -1 FROM ends) GROUP BY ip) SELECT 0 AS part, 'graph Internet {{ overlap=scale' AS value UNION ALL SELECT 3, '}}'
  UNION ALL SELECT 2, '"' || r1 || '":"' || ip1 || '" -- "' || r2 || '":"' || ip2 || '" [color=' || {_CLR} || ',dir=forward]' FROM ends
  UNION ALL SELECT 1, '"' || router || '" [fillcolor=white,label = "' || router || ' ' || string_agg(' | <' || o.ip || '> ' || o.ip, '' ORDER BY coalesce(k, 0), CAST(o.ip AS VARCHAR)) || '"]' FROM observed o LEFT JOIN c ON c.ip = o.ip GROUP BY router""")
def _(spark, sf):
    return _drawing(spark, *_graph(spark, sf), style="neato")


@query("export_dot_cluster", _EN + f""", lb AS (SELECT s_suppkey + {ROUTER_BASE} AS ip, 'N' || s_nationkey AS label FROM supplier WHERE s_suppkey % 2 = 0) SELECT 0 AS part, 'digraph Internet {{' AS value UNION ALL SELECT 3, '}}' UNION ALL SELECT 2, '"' || ip1 || '" -> "' || ip2 || '" [color=' || {_CLR} || ',dir=forward];' FROM ends
  UNION ALL SELECT 1, 'subgraph "cluster' || router || '" {{ ' || string_agg('"' || o.ip || '";', ' ' ORDER BY CAST(o.ip AS VARCHAR)) || ' label="' || coalesce(string_agg(DISTINCT label, ',' ORDER BY label), router) || '"; }}' FROM observed o LEFT JOIN lb ON lb.ip = o.ip GROUP BY router""")
def _(spark, sf):
    lb = T.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + ROUTER_BASE).alias("ip"), F.concat(L("N"), F.col("s_nationkey").cast("string")).alias("label"))
    return _drawing(spark, *_graph(spark, sf), style="cluster", labels=lb)


from .union import _C as _UNION  # noqa: E402


@query("write_union_outputs", _UNION + """ SELECT 'good' AS output, count(*) AS n FROM sup WHERE a1 NOT IN (SELECT ip FROM bip) AND (a2 IS NULL OR a2 NOT IN (SELECT ip FROM bip)) UNION ALL SELECT 'conflicts', count(*) FROM bip
  UNION ALL SELECT 'conflict-facts', count(*) FROM (SELECT DISTINCT * FROM mf WHERE a1 IN (SELECT ip FROM bip)) UNION ALL SELECT 'conflict-debug', count(*) FROM bel UNION ALL SELECT 'badtraces', count(DISTINCT model) FROM bel""")
def _(spark, sf):
    base = scratch(spark)
    S.write_union_outputs(T.model_facts(spark, sf), base)
    out = None
    for n in ("good", "conflicts", "conflict-facts", "conflict-debug", "badtraces"):
        d = spark.read.parquet(f"{base}.{n}").agg(F.count(L(1)).alias("n")).select(L(n).alias("output"), "n")
        out = d if out is None else out.unionByName(d)
    return out
