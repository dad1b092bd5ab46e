"""Scoring an observed graph against ground truth, and the clean-ups before it.

`truth(router, ip)` and `observed(router, ip)`. Counts over pairs come from the contingency table of the two router
labels, so no pair lists are built for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..functions import probe as pf
from .graph import alias_pairs_from_sets, star_edges

PAIR = ["ip1", "ip2"]


def _labels(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per address: its observed and its true router (null where unknown)."""
    o = observed.groupBy("ip").agg(F.min("router").alias("o"))
    t = truth.groupBy("ip").agg(F.min("router").alias("t"))
    return o.join(t, "ip", "full_outer")


def _two(n):
    return F.col(n) * (F.col(n) - 1) / 2


def truth_alias_compare(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """Every alias pair of either graph: common, wrong (true routers differ), observed_only or missing."""
    lab = _labels(observed, truth)
    op = alias_pairs_from_sets(observed).select(*PAIR, F.lit(True).alias("in_o")).distinct()
    tp = alias_pairs_from_sets(truth).select(*PAIR, F.lit(True).alias("in_t")).distinct()
    j = op.join(tp, PAIR, "full_outer")
    for i in ("1", "2"):
        j = j.join(lab.select(F.col("ip").alias(f"ip{i}"), F.col("t").alias(f"t{i}")), f"ip{i}", "left")
    status = (
        F.when(F.col("in_o") & F.col("in_t"), "common").when(F.col("in_t"), "missing")
        .when(F.col("t1") != F.col("t2"), "wrong").otherwise("observed_only"))
    return j.select(*PAIR, status.alias("status"))


def _cells(observed: DataFrame, truth: DataFrame) -> DataFrame:
    return _labels(observed, truth).groupBy("o", "t").agg(F.count(F.lit(1)).alias("n"))


def alias_stats(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """Common, wrong, extra and missed alias pairs before closure (each address with its router's lowest) and after.

    As in the listing form, wrong pairs are also extra ones.
    """
    lab = _labels(observed, truth)
    po, pt = (star_edges(x).select(*PAIR, F.lit(True).alias(n)) for x, n in ((observed, "in_o"), (truth, "in_t")))
    j = po.join(pt, PAIR, "full_outer")
    for i in ("1", "2"):
        j = j.join(lab.select(F.col("ip").alias(f"ip{i}"), F.col("t").alias(f"t{i}")), f"ip{i}", "left")
    o, t = F.coalesce("in_o", F.lit(False)), F.coalesce("in_t", F.lit(False))
    pre = j.agg(F.lit("pre").alias("phase"), F.count_if(o & t).alias("common"), F.count_if(o & ~t & (F.col("t1") != F.col("t2"))).alias("wrong"),
                F.count_if(o & ~t).alias("extra"), F.count_if(t & ~o).alias("missed"))
    c = _cells(observed, truth)
    per_o = c.where("o IS NOT NULL").groupBy("o").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).alias("known"))
    s_o = per_o.agg(F.coalesce(F.sum(_two("all")), F.lit(0)).alias("po"), F.coalesce(F.sum(_two("known")), F.lit(0)).alias("pk"))
    s_t = c.where("t IS NOT NULL").groupBy("t").agg(F.sum("n").alias("all")).agg(F.coalesce(F.sum(_two("all")), F.lit(0)))
    s_c = c.where("o IS NOT NULL AND t IS NOT NULL").agg(F.coalesce(F.sum(_two("n")), F.lit(0)))
    b = s_o.select("po", "pk", s_t.scalar().alias("pt"), s_c.scalar().alias("both"))
    post = b.select(F.lit("post").alias("phase"), F.col("both").alias("common"), (F.col("pk") - F.col("both")).alias("wrong"),
                    (F.col("po") - F.col("both")).alias("extra"), (F.col("pt") - F.col("both")).alias("missed"))
    return pre.unionByName(post.select("phase", *[F.col(x).cast("bigint") for x in ("common", "wrong", "extra", "missed")]))


def truth_link_compare(obs_links: DataFrame, truth_links: DataFrame, truth: DataFrame) -> DataFrame:
    """Directed links of either graph: common, wrong (both ends on one true router), extra, missing, or covered.

    A true RR link that was not observed is `alt_rr` or `tr` when a sibling address of its near end has an observed RR
    or TR link to the far end. `links(ip1, ip2, link_type)`; RR covers the types RR and STR.
    """
    tr_of = truth.groupBy("ip").agg(F.min("router").alias("t"))
    rr = lambda d: d.where(F.col("link_type") <= pf.STR).select(*PAIR).distinct()
    obs_rr, truth_rr = rr(obs_links), rr(truth_links)
    obs_tr = obs_links.where(F.col("link_type") == pf.TR).select(*PAIR).distinct()
    near = tr_of.select(F.col("ip").alias("ip1"), F.col("t").alias("t1"))
    far = tr_of.select(F.col("ip").alias("ip2"), F.col("t").alias("t2"))
    o = obs_rr.join(truth_rr.withColumn("hit", F.lit(True)), PAIR, "left").join(near, "ip1", "left").join(far, "ip2", "left")
    seen = o.select(*PAIR, F.lit("RR").alias("kind"), F.when(F.col("hit"), "common").when(F.col("t1") == F.col("t2"), "wrong").otherwise("extra").alias("status"))
    stray = obs_tr.join(near, "ip1", "left_anti").select(*PAIR, F.lit("TR").alias("kind"), F.lit("extra").alias("status"))
    by_router = lambda d, n: d.join(near, "ip1").select("t1", "ip2", F.lit(True).alias(n)).distinct()
    m = truth_rr.join(obs_rr, PAIR, "left_anti").join(near, "ip1", "left")
    m = m.join(by_router(obs_rr, "alt"), ["t1", "ip2"], "left").join(by_router(obs_tr, "tr"), ["t1", "ip2"], "left")
    lost = m.select(*PAIR, F.lit("RR").alias("kind"), F.when(F.col("alt"), "alt_rr").when(F.col("tr"), "tr").otherwise("missing").alias("status"))
    return seen.unionByName(stray).unionByName(lost)


def link_stats(compared: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return compared.agg(n("common").alias("common"), n("wrong").alias("wrong"), n("wrong", "extra").alias("extra"),
                        n("missing").alias("missed"), n("tr").alias("tr_links"), n("alt_rr").alias("alt_rr_links"))


def router_mapping(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """How true routers map to observed ones: good, bad (merged with others), split, superfluous parts, missed.

    A cell (true, observed) of the contingency table is a mapping when an alias pair speaks for it: two addresses in
    the cell, or an observed router with several true ones, or a true router with several observed ones.
    """
    c = _cells(observed, truth).where("o IS NOT NULL AND t IS NOT NULL")
    per_o = c.groupBy("o").agg(F.count(F.lit(1)).alias("nt"))
    per_t = c.groupBy("t").agg(F.count(F.lit(1)).alias("no"))
    m = c.join(per_o, "o").join(per_t, "t").where("n >= 2 OR nt >= 2 OR no >= 2").select("t", "o", "nt")
    g = m.groupBy("t").agg(F.count(F.lit(1)).alias("parts"), F.max("nt").alias("merged"))
    every = truth.select(F.col("router").alias("t")).distinct().join(g, "t", "left")
    one = F.col("parts") == 1
    s = every.agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if(F.col("parts").isNull()).alias("missed"),
        F.count_if(one & (F.col("merged") == 1)).alias("good"), F.count_if(one & (F.col("merged") > 1)).alias("bad"),
        F.count_if(F.col("parts") > 1).alias("split"), F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts") - 1)), F.lit(0)).alias("superfluous"))
    return s.withColumn("n_observed", observed.select(F.count_distinct("router")).scalar())


def cluster_similarity(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of address pairs, known to both graphs, whose same-router relation is right."""
    c = _cells(observed, truth).where("o IS NOT NULL AND t IS NOT NULL")
    half = lambda d: d.agg(F.coalesce(F.sum(_two("n")), F.lit(0))).scalar()
    same_o = half(c.groupBy("o").agg(F.sum("n").alias("n")))
    same_t = half(c.groupBy("t").agg(F.sum("n").alias("n")))
    both = half(c)
    s = c.agg(F.sum("n").alias("n")).select(_two("n").alias("pairs"), same_o.alias("so"), same_t.alias("st"), both.alias("b"))
    score = F.col("pairs") - F.col("so") - F.col("st") + 2 * F.col("b")
    return s.select(score.cast("bigint").alias("score"), F.col("pairs").cast("bigint").alias("pairs"), F.try_divide(score, "pairs").alias("similarity"))


def _sizes(routers: DataFrame) -> DataFrame:
    return routers.groupBy("router").agg(F.count_distinct("ip").alias("n"))


def clean_graph(routers: DataFrame, links: DataFrame) -> DataFrame:
    """Without addresses that have no alias and no link in or out."""
    linked = links.select(F.explode(F.array(*PAIR)).alias("ip")).distinct().withColumn("linked", F.lit(True))
    d = routers.join(_sizes(routers), "router").join(linked, "ip", "left")
    return d.where((F.col("n") > 1) | F.col("linked")).select("router", "ip")


def defringe_graph(routers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without links that end at an address with no alias, then without such addresses."""
    kept = routers.join(_sizes(routers).where("n > 1").select("router"), "router", "left_semi")
    ips = kept.select("ip").distinct()
    for c in PAIR:
        links = links.join(ips.withColumnRenamed("ip", c), c, "left_semi")
    return kept, links


def restrict_to_truth(routers: DataFrame, links: DataFrame, truth_ips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routers with a true address (with all their addresses), and links with both ends true."""
    t = truth_ips.select("ip").distinct()
    kept = routers.join(routers.join(t, "ip", "left_semi").select("router").distinct(), "router", "left_semi")
    for c in PAIR:
        links = links.join(t.withColumnRenamed("ip", c), c, "left_semi")
    return kept, links


def duplicate_interfaces(routers: DataFrame) -> DataFrame:
    return routers.groupBy("ip").agg(F.count_distinct("router").alias("n_routers"), F.min("router").alias("first"), F.max("router").alias("last")).where("n_routers > 1")


def truth_facts(interfaces: DataFrame) -> DataFrame:
    """(pred, ip1, ip2) of interfaces that are up: alias pairs of a router in both orders and links to possible peers."""
    d = interfaces.where(F.col("up") & ~ipf.is_bogon("ip") & ~ipf.is_loopback("ip"))
    pairs = alias_pairs_from_sets(d)
    al = pairs.select(F.lit("alias").alias("pred"), F.explode(F.array(F.struct(F.col("ip1").alias("a"), F.col("ip2").alias("b")),
                                                                   F.struct(F.col("ip2").alias("a"), F.col("ip1").alias("b")))).alias("e"))
    links = d.select(F.lit("link").alias("pred"), F.col("ip").alias("ip1"), F.explode(ipf.link_peer_addresses("ip", "len")).alias("ip2"))
    return al.select("pred", F.col("e.a").alias("ip1"), F.col("e.b").alias("ip2")).unionByName(links).distinct()
