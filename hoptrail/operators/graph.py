"""Graph operators: components, searches, degrees, merging of graphs.

`routers(router, kind, types, ip)`, `links(ip1, ip2, link_type)`; alias evidence is `(ip1, ip2, source)`.
Alias classes are kept as stars (representative, member); pairs are listed only where pairs are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probe as pf
from ..session import cut_lineage
from .ranking import global_prefix_sum, global_rank


def _edge_state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def connected_components(pairs: DataFrame, nodes: DataFrame | None = None, a: str = "ip1", b: str = "ip2") -> DataFrame:
    """(ip, root): root is the lowest address of the component.

    Alternates the large-star and small-star steps: the number of rounds grows with the logarithm of the component
    size, each is an aggregation by node (which combines map-side, so a hub node is no hot spot) and a join of the
    edges with one row per node.
    """
    e = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut_lineage(e)
    before = _edge_state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        after = _edge_state(edges)
        if after == before:
            break
        before = after
    ends = pairs.select(F.explode(F.array(a, b)).alias("ip"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("ip"))
    roots = edges.select(F.col("u").alias("ip"), F.col("v").alias("root"))
    return ends.distinct().join(roots, "ip", "left").select("ip", F.coalesce("root", "ip").alias("root"))


def star_edges(sets: DataFrame, router: str = "router") -> DataFrame:
    """Router sets as edges to their lowest address: as many rows as members."""
    low = sets.groupBy(router).agg(F.min("ip").alias("ip1"))
    return sets.select(router, F.col("ip").alias("ip2")).join(low, router).where("ip1 <> ip2").select("ip1", "ip2").distinct()


def alias_pairs_from_sets(sets: DataFrame, router: str = "router") -> DataFrame:
    """All unordered pairs inside each router: the listing form of alias classes, quadratic in the router's size."""
    d = sets.select(router, "ip").distinct()
    two = d.withColumnRenamed("ip", "ip2")
    return d.withColumnRenamed("ip", "ip1").join(two, router).where("ip1 < ip2").select(router, "ip1", "ip2")


def transitive_classes(aliases: DataFrame) -> DataFrame:
    """Closure of the alias relation as stars: (root, ip, sources of the whole class)."""
    comp = cut_lineage(connected_components(aliases))
    per_pair = aliases.join(comp, aliases.ip1 == comp.ip).select("root", "source")
    src = per_pair.groupBy("root").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return comp.join(src, "root")


def transitive_aliases(aliases: DataFrame) -> DataFrame:
    """Closure pairs (ip1 < ip2, never an address with itself). Given pairs keep their sources, derived pairs carry
    the union of the sources of their class."""
    given = aliases.select(F.least("ip1", "ip2").alias("ip1"), F.greatest("ip1", "ip2").alias("ip2"), "source").where(
        "ip1 <> ip2").groupBy("ip1", "ip2").agg(F.array_sort(F.collect_set("source")).alias("own"))
    classes = transitive_classes(aliases)
    pairs = alias_pairs_from_sets(classes.withColumnRenamed("root", "router"))
    src = classes.select(F.col("root").alias("router"), "sources").distinct()
    return pairs.join(src, "router").join(given, ["ip1", "ip2"], "left").select(
        "ip1", "ip2", F.col("own").isNull().alias("derived"), F.coalesce("own", "sources").alias("sources"))


def link_ends(links: DataFrame, ip2router: DataFrame) -> DataFrame:
    """Links with the routers of both ends (an address without a router stands for itself)."""
    m = ip2router.groupBy("ip").agg(F.min("router").alias("router"))
    one = links.join(m.select(F.col("ip").alias("ip1"), F.col("router").alias("r1")), "ip1", "left")
    two = one.join(m.select(F.col("ip").alias("ip2"), F.col("router").alias("r2")), "ip2", "left")
    return two.withColumn("r1", F.coalesce("r1", F.col("ip1").cast("string"))).withColumn(
        "r2", F.coalesce("r2", F.col("ip2").cast("string")))


def bfs(adj: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Hop distance (router, dist) over undirected `adj(a, b)` from any source; a step touches the frontier only."""
    both = cut_lineage(adj.select("a", "b").unionByName(adj.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    frontier = cut_lineage(sources.select("router").distinct().withColumn("dist", F.lit(0)))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.select(F.col("router").alias("a")).join(both, "a").select(F.col("b").alias("router")).distinct()
        frontier = cut_lineage(nxt.join(seen, "router", "left_anti").withColumn("dist", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def _chain_ends(both: DataFrame, inner: DataFrame) -> DataFrame:
    """(a, b, tip, far): a walk that enters the inner router `b` from `a` first meets an anchor at `tip`, `far` links on.

    Inner routers have two neighbours, so a walk has one way on. Walks double their length each round: one that stands
    at an inner router goes on by the walk from there. Rings of inner routers alone have no anchor and no row.
    """
    step = both.join(inner, both.b == inner.router).select(
        "a", "b", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("tip"))
    marked = step.join(inner.select(F.col("router").alias("tip"), F.lit(False).alias("done")), "tip", "left")
    walks = cut_lineage(marked.select("a", "b", F.col("b").alias("last"), "tip", F.lit(1).cast("bigint").alias("far"),
                                      F.coalesce("done", F.lit(True)).alias("done")))
    longest, length = walks.count(), 1
    while length <= longest and not walks.where("NOT done").isEmpty():
        on = walks.select(F.col("a").alias("last"), F.col("b").alias("tip"), F.col("last").alias("last2"), F.col("tip").alias("tip2"),
                          F.col("far").alias("far2"), F.col("done").alias("done2"))
        going = walks.where("NOT done").join(on, ["last", "tip"]).select(
            "a", "b", F.col("last2").alias("last"), F.col("tip2").alias("tip"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        walks = cut_lineage(walks.where("done").unionByName(going))
        length *= 2
    return walks.where("done").select("a", "b", "tip", "far")


SHALLOW = 16  # hops that a plain search goes before chains are worth finding; the result is the same either way


def distances(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """Hop distance (router, dist) like `bfs`, also for graphs with long chains.

    A plain search comes first and is all that graphs of fewer than `SHALLOW` hops need. In deeper ones, routers with two
    neighbours that are no sources stand on chains. Chains become single links with a length, found by doubling; a
    search over the other routers relaxes only those whose distance fell, and routers on chains take the nearer of both
    ends. Rounds grow with the logarithm of the longest chain and the number of junctions on a path.
    """
    adj = cut_lineage(adj.select("a", "b").distinct())
    reached = bfs(adj, sources, SHALLOW)
    if reached.where(F.col("dist") == SHALLOW).isEmpty():
        return reached
    pairs = adj.unionByName(adj.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut_lineage(pairs.distinct())
    start = cut_lineage(sources.select("router").distinct())
    near = both.groupBy(F.col("a").alias("router")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    inner = cut_lineage(near.where("n = 2").drop("n").join(start, "router", "left_anti"))
    ends = _chain_ends(both, inner)
    anchors = both.join(inner.select(F.col("router").alias("a")), "a", "left_anti")
    plain = anchors.join(inner.select(F.col("router").alias("b")), "b", "left_anti").select("a", "b", F.lit(1).cast("bigint").alias("far"))
    chained = ends.join(inner.select(F.col("router").alias("a")), "a", "left_anti").select("a", F.col("tip").alias("b"), (F.col("far") + 1).alias("far"))
    links = cut_lineage(plain.unionByName(chained).groupBy("a", "b").agg(F.min("far").alias("far")))
    known = changed = start.withColumn("dist", F.lit(0).cast("bigint"))
    nearest = lambda d: d.groupBy("router").agg(F.min("dist").alias("dist"))
    rounds = 0
    while True:
        rounds += 1
        met = changed.join(links, changed.router == links.a).groupBy("b").agg(F.min(F.col("dist") + F.col("far")).alias("new"))
        old = nearest(known).withColumnRenamed("router", "b")
        changed = cut_lineage(met.join(old, "b", "left").where("dist IS NULL OR new < dist").select(F.col("b").alias("router"), F.col("new").alias("dist")))
        if changed.isEmpty():
            break
        known = known.unionByName(changed)
        if rounds % 8 == 0:
            known = cut_lineage(nearest(known))
    known = nearest(known)
    # an inner router is entered from both its neighbours, so it has a walk to either end of its chain
    to_tip = ends.select(F.col("b").alias("router"), "tip", "far")
    on_chains = to_tip.join(known.withColumnRenamed("router", "tip"), "tip").groupBy("router").agg(F.min(F.col("dist") + F.col("far")).alias("dist"))
    return known.unionByName(on_chains).select("router", F.col("dist").cast("int").alias("dist"))


def degrees(ends: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Link ends per router over `(r1, r2, link_type)` without UNKNOWN links; sources are not counted."""
    d = ends.where(F.col("link_type") != pf.UNKNOWN).select(F.explode(F.array("r1", "r2")).alias("router")).groupBy(
        "router").agg(F.count(F.lit(1)).alias("degree"))
    return d if sources is None else d.join(sources.select("router").distinct(), "router", "left_anti")


def degree_distribution(ends: DataFrame, sources: DataFrame | None = None, complementary: bool = False) -> DataFrame:
    """Routers by degree with their rank and its share in percent (CDF, or 100 minus it)."""
    r = global_rank(degrees(ends, sources), ["degree", "router"])
    pct = 100 * F.col("rank") / F.col("total")
    return r.select("router", "degree", "rank", (100 - pct if complementary else pct).alias("pct"))


def degree_bias(ends: DataFrame, sources: DataFrame) -> DataFrame:
    """Degree CCDF of all, near (distance under the median) and far routers; sources and unreached ones left out."""
    adj = ends.where(F.col("link_type") != pf.UNKNOWN).select(F.col("r1").alias("a"), F.col("r2").alias("b")).distinct()
    dist = distances(adj, sources)
    both = adj.unionByName(adj.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = both.groupBy(F.col("a").alias("router")).agg(F.count(F.lit(1)).alias("degree"))
    far_away = 1 << 30
    d = cut_lineage(deg.join(dist, "router", "left").withColumn("dist", F.coalesce("dist", F.lit(far_away))))
    counts = d.groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
    c = global_prefix_sum(counts, ["dist"], "n")
    median = c.where(F.col("cum") > F.floor(F.col("total") / 2)).agg(F.min("dist")).first()[0]
    series = F.explode(F.array(F.lit("all"), F.when(F.col("dist") < median, "near").otherwise("far")))
    rows = d.where((F.col("dist") > 0) & (F.col("dist") < far_away)).select(series.alias("series"), "router", "degree", "dist")
    r = global_rank(rows, ["series", "degree", "dist", "router"])
    per = r.groupBy("series").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    return r.join(per, "series").select(
        "series", "router", "degree", "dist", (1 - (F.col("rank") - F.col("first")) / F.col("n")).alias("p"))


def rr_coverage(routers: DataFrame, ends: DataFrame, vantage_ips: DataFrame, hops: int = 9) -> DataFrame:
    """Routers within ``hops`` of a router that holds a vantage address, and routers with a RR or STR link."""
    known = ends.where(F.col("link_type") != pf.UNKNOWN)
    start = routers.join(vantage_ips.select("ip").distinct(), "ip", "left_semi").select("router").distinct()
    reach = bfs(known.select(F.col("r1").alias("a"), F.col("r2").alias("b")), start, hops)
    close = known.where(F.col("link_type") <= pf.STR).select(F.explode(F.array("r1", "r2")).alias("router")).distinct()
    mark = lambda d, k: d.select("router", F.lit(k).alias("k"))
    every = mark(routers.select("router").distinct(), "t").unionByName(mark(reach, "f")).unionByName(mark(close, "c"))
    n = lambda k: F.count_if(F.col("k") == k)
    pct = lambda k: F.try_divide(100.0 * n(k), n("t"))
    return every.agg(n("t").alias("total"), n("f").alias("n_flood"), pct("f").alias("pct_flood"), n("c").alias("n_close"),
                     pct("c").alias("pct_close"))


def router_type_histogram(routers: DataFrame, simplified: bool = False) -> DataFrame:
    """`routers(router, types)` -> counts and percent of typed routers per type label."""
    t = F.col("types")
    has = lambda x: F.array_contains(t, x)
    if not simplified:
        labels = F.array(F.array_join(F.array_sort(t), "_"))
    else:
        fold = [
            F.when(has("A") & has("B"), "A_B"), F.when(has("A") & ~has("B"), "A"), F.when(has("B") & ~has("A"), "B"),
            F.when(has("U") & ~(has("A") | has("B") | has("C")), "U"),
            F.when(has("N") & has("A"), "A_N").when(has("N") & has("B"), "B_N").when(has("N") & has("C"), "C_N").when(has("N"), "N"),
        ]
        rest = F.filter(t, lambda x: ~x.isin("A", "B", "U", "N"))
        labels = F.concat(F.filter(F.array(*fold), lambda x: x.isNotNull()), rest)
    labels = F.when(F.size(t) > 0, F.concat(labels, F.array(F.lit("*")))).otherwise(labels)
    c = routers.select(F.explode(labels).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    typed = F.max(F.when(F.col("type") == "*", F.col("n"))).over(W.partitionBy(F.lit(1)))  # one row per type label
    return c.withColumn("n_typed", typed).where("type <> '*'").select(
        "type", "n", F.try_divide(100.0 * F.col("n"), F.col("n_typed")).alias("pct"))


def router_label(members: DataFrame) -> DataFrame:
    """`members(router, ip, type, tag)` -> name by kind (S > N > E > H > R), type letters, then other tags."""
    kinds = {"source": "S", "nat": "N", "endhost": "E", "hidden": "H"}
    g = members.groupBy("router").agg(
        F.array_sort(F.collect_set(F.upper("type"))).alias("types"), F.array_sort(F.collect_set(F.lower("tag"))).alias("tags"))
    kind = F.lit("R")
    for tag, letter in reversed(list(kinds.items())):
        kind = F.when(F.array_contains("tags", tag), letter).otherwise(kind)
    other = F.transform(F.filter("tags", lambda x: ~x.isin(*kinds)), lambda x: F.upper(x))
    return g.select("router", F.array_join(F.concat(F.array(F.concat(kind, F.col("router").cast("string"))), "types", other), "_").alias("label"))


def merge_adjacency(routers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of many graphs: `routers(graph, router, ip)` sharing an address unify; the best type of a link stays.

    Returns (ip, root) and links between roots' addresses.
    """
    r = routers.select(F.concat_ws("/", "graph", "router").alias("router"), "ip")
    comp = connected_components(star_edges(r), routers)
    best = links.groupBy("ip1", "ip2").agg(F.min("link_type").alias("link_type"))
    m = comp.select("ip", F.col("root").alias("router"))
    one = best.join(m.select(F.col("ip").alias("ip1"), F.col("router").alias("r1")), "ip1", "left")
    two = one.join(m.select(F.col("ip").alias("ip2"), F.col("router").alias("r2")), "ip2", "left")
    return comp, two.select(F.coalesce("r1", "ip1").alias("r1"), "ip1", F.coalesce("r2", "ip2").alias("r2"), "ip2", "link_type")


def merge_links_aliases(routers: DataFrame, links: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph re-grouped by outside alias sets; set members the graph does not use are ignored."""
    used = routers.select("ip").unionByName(links.select(F.explode(F.array("ip1", "ip2")).alias("ip"))).distinct()
    s = sets.join(used, "ip", "left_semi")
    g = routers.select(F.lit("g").alias("graph"), F.col("router").cast("string").alias("router"), "ip").unionByName(
        s.select(F.lit("s").alias("graph"), F.col("router").cast("string").alias("router"), "ip"))
    return merge_adjacency(g, links)


def contract_stub_as(routers: DataFrame, links: DataFrame, asn: DataFrame, sources: DataFrame) -> DataFrame:
    """Routers wholly inside one stub AS (an AS of a source) become that AS node; unique undirected edges remain.

    `routers(router, ip)`, `links(r1, ip1, r2, ip2, link_type)`, `asn(ip, asn)`, `sources(ip)`. A link end whose own
    address is in a stub AS becomes the AS node too. UNKNOWN and self links are left out.
    """
    a = asn.where("asn <> '0' AND asn <> ''")
    stub = a.join(sources.select("ip").distinct(), "ip", "left_semi").select("asn").distinct().withColumn("stub", F.lit(True))
    marked = a.join(stub, "asn").select("ip", "asn")
    m = routers.join(marked, "ip", "left").groupBy("router").agg(
        F.count_if(F.col("asn").isNull()).alias("outside"), F.min("asn").alias("lo"), F.max("asn").alias("hi"))
    whole = m.where("outside = 0 AND lo = hi").select("router", F.concat(F.lit("AS"), F.col("lo")).alias("node"))
    d = links.where((F.col("link_type") != pf.UNKNOWN) & (F.col("ip1") != F.col("ip2")))
    for i in ("1", "2"):
        d = d.join(whole.select(F.col("router").alias(f"r{i}"), F.col("node").alias(f"n{i}")), f"r{i}", "left")
        d = d.join(marked.select(F.col("ip").alias(f"ip{i}"), F.concat(F.lit("AS"), F.col("asn")).alias(f"s{i}")), f"ip{i}", "left")
    a1, a2 = F.coalesce("s1", "n1", "r1"), F.coalesce("s2", "n2", "r2")
    return d.select(F.least(a1, a2).alias("a"), F.greatest(a1, a2).alias("b")).where("a <> b").distinct()
