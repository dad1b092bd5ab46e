"""Writers: tables as partitioned Parquet, graphs and facts as text.

Text writers first build a DataFrame of lines, so the work stays distributed; a router's line holds its addresses and
is as long as the router is large, which the format asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe as pf
from ..operators import series as S
from ..operators.ranking import global_prefix_sum

# Colours of graph export.
LINK_COLOR = {"HIDDEN": "red", "RR": "blue", "STR": "purple", "TR": "black", "UNKNOWN": "orange"}
NODE_COLOR = {"HIDDEN": "pink", "Router": "white", "Endhost": "cyan", "NAT": "red", "Source": "purple"}


def write_traces(probes: DataFrame, path: str, dataset: str | None = None, mode: str = "append") -> None:
    """Parquet partitioned by dataset and sorted by (src, dst) inside files, so a pair's rows are found by statistics.

    Rows are range-partitioned, which spreads a dataset, a source or a trace that holds most rows over many files.
    """
    d = probes if dataset is None else probes.withColumn("dataset", F.lit(dataset))
    order = ["dataset", "src", "dst", "ttl"]
    d.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("dataset").parquet(path)


def write_traces_table(probes: DataFrame, name: str, buckets: int, mode: str = "overwrite") -> None:
    """Table bucketed by (src, dst): later joins and groupings of traces need no shuffle."""
    probes.write.mode(mode).bucketBy(buckets, "src", "dst").sortBy("src", "dst", "ttl").saveAsTable(name)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("value").write.mode(mode).text(path)


def printable_links(links: DataFrame) -> DataFrame:
    """Links between routers (r1, ip1, r2, ip2, link_type) that no better link of the same router pair hides."""
    best = links.groupBy("r1", "r2").agg(F.min("link_type").alias("best"))
    return links.join(best, ["r1", "r2"]).where("link_type = best").drop("best")


def _router_rows(routers: DataFrame) -> DataFrame:
    return routers.groupBy("router", "kind").agg(F.sort_array(F.collect_set(F.col("ip").cast("string")), asc=False).alias("ips"))


def adjacency_lines(routers: DataFrame, links: DataFrame) -> DataFrame:
    """`routers(router, kind, ip)` and `links(r1, ip1, r2, ip2, link_type)` as graph text lines."""
    r = _router_rows(routers).select(F.concat_ws(
        " ", "kind", "router", F.concat(F.lit("nAlly="), F.size("ips").cast("string")), F.array_join("ips", " ")).alias("value"))
    l = printable_links(links).select(F.concat(
        F.lit("Link  "), F.col("r1"), F.lit(":"), F.col("ip1").cast("string"), F.lit(" -- "), F.col("r2"), F.lit(":"), F.col("ip2").cast("string"),
        F.lit(" : "), pf.link_type_name("link_type")).alias("value"))
    return r.unionByName(l)


def write_adjacency(routers: DataFrame, links: DataFrame, path: str) -> None:
    write_lines(adjacency_lines(routers, links), path)


def fact_lines(facts: DataFrame, pred: str, columns: list[str]) -> DataFrame:
    """Rows as `pred(a,b,...).`; a null trailing column is left out."""
    return facts.select(F.concat(F.lit(f"{pred}("), F.concat_ws(",", *[F.col(c).cast("string") for c in columns]), F.lit(").")).alias("value"))


def write_facts(facts: DataFrame, pred: str, columns: list[str], path: str, mode: str = "append") -> None:
    write_lines(fact_lines(facts, pred, columns), path, mode)


def trace_facts(lns: DataFrame) -> DataFrame:
    """Older fact form of probe logs: trace(id,src,dst), tr(id,ttl,ip), rr(id,ip,ttl,idx,hop).

    The id grows with every record-route train over all files in order; lines of other trains keep the latest id.
    """
    v = F.col("value")
    ip = r"\d{1,3}(?:\.\d{1,3}){3}"
    flag = F.nullif(F.regexp_extract(v, r"Sending.* RR=(\d)", 1), F.lit("")).cast("int")
    d = lns.select("file", "pos", "value", flag.alias("flag")).where(flag.isNotNull() | v.contains("RECV"))
    d = d.withColumn("one", F.coalesce((F.col("flag") == 1).cast("bigint"), F.lit(0)))
    d = global_prefix_sum(d, ["file", "pos"], "one", "id").drop("total")
    d = S.last_known(S.in_runs(d, ["file"], ["pos"]), ["file"], ["pos"], "flag", "mode")
    w = F.split(F.trim("value"), r"\s+")
    heads = d.where("flag = 1").select(
        F.lit("trace").alias("pred"), "id", F.array(F.regexp_extract(v, rf"^({ip})", 1), F.regexp_extract(v, rf"-({ip})[:\s]", 1)).alias("args"))
    r = d.where("flag IS NULL AND coalesce(mode, 0) IN (0, 1)").withColumn("ip", F.get(w, F.lit(6))).withColumn("ttl", F.get(w, F.lit(3)))
    tr = r.where("coalesce(mode, 0) = 0").select(F.lit("tr").alias("pred"), "id", F.array("ttl", "ip").alias("args"))
    hops = F.regexp_extract_all(v, F.lit(rf"hop \d+ {ip} ,"), 0)
    rr = r.where("mode = 1").select("id", "ip", "ttl", F.explode(hops).alias("h")).select(
        F.lit("rr").alias("pred"), "id", F.array("ip", "ttl", F.split("h", " ")[1], F.split("h", " ")[2]).alias("args"))
    return heads.unionByName(tr).unionByName(rr)


def write_trace_facts(lns: DataFrame, path: str) -> None:
    t = trace_facts(lns)
    write_lines(t.select(F.concat("pred", F.lit("("), F.concat_ws(",", F.col("id").cast("string"), "args"), F.lit(").")).alias("value")), path)


def alias_tables(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict").isin("ALIAS", "NOT")).select("ip1", "ip2", "source", "verdict")


def load_alias_tables(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    """ALIAS and NOT verdicts as Parquet by verdict; UNKNOWN ones are dropped."""
    alias_tables(verdicts).write.mode(mode).partitionBy("verdict").parquet(path)


def write_ttl_distance(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def dot_lines(routers: DataFrame, links: DataFrame, style: str = "record", skip_unknown: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """Graph text for a drawing tool as (part, value) lines; parts 0 to 3 are heading, nodes, edges and end.

    Styles: `record` (addresses as fields of a router), `neato` (fields ordered by out minus in count) and `cluster`
    (addresses grouped per router, titled by ``labels(ip, label)`` where known).
    """
    color = lambda col, table: F.coalesce(*[F.when(col == k, F.lit(c)) for k, c in table.items()])
    l = links.where(F.col("link_type") != pf.UNKNOWN) if skip_unknown else links
    l = l.withColumn("c", color(pf.link_type_name("link_type"), LINK_COLOR))
    q = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    col = lambda n: F.col(n).cast("string")
    if style == "cluster":
        edges = l.select(q('"', col("ip1"), '" -> "', col("ip2"), '" [color=', F.col("c"), ",dir=forward];").alias("value"))
    else:
        more = "" if style == "record" else ",dir=forward"
        edges = l.select(q('"', col("r1"), '":"', col("ip1"), '" -- "', col("r2"), '":"', col("ip2"), '" [color=', F.col("c"), more, "]").alias("value"))
    d = routers.select("router", "kind", "ip").distinct()
    if style == "neato":
        ends = l.select(F.explode(F.array(F.struct(F.col("ip1").alias("ip"), F.lit(1).alias("k")), F.struct(F.col("ip2").alias("ip"), F.lit(-1).alias("k")))).alias("e"))
        cnt = ends.groupBy(F.col("e.ip").alias("ip")).agg(F.sum("e.k").alias("k"))
        d = d.join(cnt, "ip", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    else:
        d = d.withColumn("k", F.lit(0))
    if labels is not None:
        d = d.join(labels.groupBy("ip").agg(F.min("label").alias("label")), "ip", "left")
    else:
        d = d.withColumn("label", F.lit(None).cast("string"))
    g = d.groupBy("router", "kind").agg(F.sort_array(F.collect_list(F.struct("k", col("ip").alias("ip")))).alias("e"), F.array_sort(F.collect_set("label")).alias("labels"))
    ips = F.transform("e", lambda x: x["ip"])
    if style == "cluster":
        title = F.when(F.size("labels") > 0, F.array_join("labels", ",")).otherwise(F.col("router").cast("string"))
        body = F.array_join(F.transform(ips, lambda x: q('"', x, '";')), " ")
        nodes = g.select(q('subgraph "cluster', col("router"), '" { ', body, ' label="', title, '"; }').alias("value"))
    else:
        fields = F.array_join(F.transform(ips, lambda x: q(" | <", x, "> ", x)), "")
        nodes = g.select(q('"', col("router"), '" [fillcolor=', color(F.col("kind"), NODE_COLOR), ',label = "', col("router"), " ", fields, '"]').alias("value"))
    spark = routers.sparkSession
    one = lambda n, text: spark.range(1).select(F.lit(n).alias("part"), F.lit(text).alias("value"))
    head = {"cluster": "digraph Internet {", "neato": "graph Internet { overlap=scale", "record": "graph Internet { rankdir=LR"}[style]
    return one(0, head).unionByName(nodes.select(F.lit(1).alias("part"), "value")).unionByName(edges.select(F.lit(2).alias("part"), "value")).unionByName(one(3, "}"))


def export_dot(routers: DataFrame, links: DataFrame, path: str, **options) -> None:
    """Writes the drawing text in order; the parts of the folder concatenate to one file."""
    write_lines(dot_lines(routers, links, **options).sort("part", "value"), path)


def write_union_outputs(facts: DataFrame, base: str) -> None:
    """Good facts, conflicts, facts in conflict, believers and bad traces of one merge, as five named folders."""
    from ..operators import union as U
    from ..session import cut_lineage

    conflicts = cut_lineage(U.alias_link_conflicts(facts))
    believers = cut_lineage(U.conflict_believers(facts, conflicts))
    ips = U.conflicted_ips(conflicts)
    touched = facts.join(ips.select(F.col("ip").alias("a1")), "a1", "left_semi").select(facts.columns).distinct()
    save = lambda d, n: d.write.mode("overwrite").parquet(f"{base}.{n}")
    save(U.good_facts(facts), "good")
    save(ips, "conflicts")
    save(touched, "conflict-facts")
    save(believers, "conflict-debug")
    save(U.bad_traces(believers), "badtraces")
