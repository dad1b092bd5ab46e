"""Operators along traces: links between hops, gaps, counts, visibility.

Input `probes(src, dst, ttl, resp, rr, ...)`; a null ``rr`` marks a plain (TR) probe. Repeated probes are collapsed
before any join, so a trace with very many rows joins only its distinct (ttl, responder) entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probe as pf

TRACE = ["src", "dst"]


def scan_traces(traces: DataFrame, where: str) -> DataFrame:
    """User predicate over a traces table; predicate and columns reach the Parquet scan."""
    return traces.where(where)


def add_source_hop(probes: DataFrame) -> DataFrame:
    """Adds, per trace, the source answering for itself at TTL 0, as a plain and as a record-route probe."""
    t = probes.select(*TRACE).distinct().withColumn("ttl", F.lit(0)).withColumn("resp", F.col("src"))
    kinds = F.explode(F.array(F.lit(None).cast("array<bigint>"), F.array().cast("array<bigint>")))
    return probes.select(*TRACE, "ttl", "resp", "rr").unionByName(t.withColumn("rr", kinds))


def hop_set(probes: DataFrame) -> DataFrame:
    return probes.select(*TRACE, "ttl", "resp").distinct()


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with a place in a trace, before they are joined with their neighbours. Spark would infer such a filter from the
    keys of either side by itself, but then the sides differ and each computes its rows again; so they share one shuffle."""
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in keys or [*TRACE, "ttl"]))


def moved(at: str, step: int):
    """A place's neighbour. The place is known, so the 0 never comes up; it only tells Spark that no null can."""
    return F.coalesce(F.col(at) + step, F.lit(0)).alias(at)


def tr_hop_pairs(tr: DataFrame) -> DataFrame:
    """Every responder at a TTL with every responder one TTL later of the same trace."""
    h = hop_set(placed(tr))
    nxt = h.select(*TRACE, moved("ttl", -1), F.col("resp").alias("ip2"))
    return h.withColumnRenamed("resp", "ip1").join(nxt, [*TRACE, "ttl"])


def tr_links(tr: DataFrame) -> DataFrame:
    return (
        tr_hop_pairs(tr).where("ip1 <> ip2").select("ip1", "ip2").distinct()
        .withColumn("link_type", F.lit(pf.TR))
    )


def tr_self_links(tr: DataFrame) -> DataFrame:
    return tr_hop_pairs(tr).where("ip1 = ip2").select(F.col("ip1").alias("ip")).distinct().withColumn(
        "tag", F.lit("selflink")
    )


def tr_links_sequential(tr: DataFrame) -> DataFrame:
    """Link from the row before when that has the TTL before; a first row at TTL 1 links from the source.

    Rows of a trace are ordered by (ttl, resp), so only the highest responder of a TTL and the lowest of the next
    meet; two values per (trace, ttl) are enough.
    """
    e = tr.groupBy(*TRACE, "ttl").agg(F.min("resp").alias("lo"), F.max("resp").alias("hi"))
    w = W.partitionBy(*TRACE).orderBy("ttl")
    e = e.withColumn("pttl", F.lag("ttl").over(w)).withColumn("phi", F.lag("hi").over(w))
    ip1 = F.when(F.col("pttl").isNull() & (F.col("ttl") == 1), F.col("src")).when(
        F.col("pttl") == F.col("ttl") - 1, F.col("phi")
    )
    return (
        e.select(ip1.alias("ip1"), F.col("lo").alias("ip2")).where("ip1 IS NOT NULL").distinct()
        .withColumn("link_type", F.lit(pf.TR))
    )


def hop_chain_links(hops: DataFrame, null_ip: int = 0) -> DataFrame:
    """`hops(trace, src, idx, ip)` -> undirected links between consecutive hops; an unknown hop breaks the chain."""
    hops = placed(hops, "trace", "idx")
    known = hops.where(F.col("ip") != null_ip)
    prev = known.select("trace", moved("idx", 1), F.col("ip").alias("prev"))
    # an unknown hop may be the first; `any` has all uses read the same columns, so that they share one shuffle
    first = hops.groupBy("trace").agg(
        F.min("idx").alias("idx"), F.min_by("src", "idx").alias("prev"), F.bool_or(F.col("ip") != null_ip).alias("any"))
    first = first.where((F.col("prev") != null_ip) & F.col("any")).select("trace", "idx", "prev")
    return (
        known.select("trace", "idx", "ip").join(prev.unionByName(first), ["trace", "idx"])
        .select(F.least("ip", "prev").alias("ip1"), F.greatest("ip", "prev").alias("ip2")).distinct()
        .withColumn("link_type", F.lit(pf.TR))
    )


def tr_gap(tr: DataFrame, max_ttl: int | None = None) -> DataFrame:
    """Hops whose next TTL is silent, with the nearest later answered TTL (at most ``max_ttl`` where given)."""
    h = hop_set(tr)
    ttls = h.select(*TRACE, "ttl").distinct()
    w = W.partitionBy(*TRACE).orderBy("ttl")
    gaps = ttls.withColumn("next_ttl", F.lead("ttl").over(w)).where(
        F.col("next_ttl") > F.col("ttl") + 1
    )
    if max_ttl is not None:
        gaps = gaps.where(F.col("next_ttl") <= max_ttl)
    return h.join(gaps, [*TRACE, "ttl"]).withColumn("gap", F.col("next_ttl") - F.col("ttl"))


def add_endhost_link(probes: DataFrame) -> DataFrame:
    """UNKNOWN link from the last responder that is not the destination to the destination.

    Among responders at the last TTL the lowest address is taken; a trace without such a responder links its source.
    """
    last = probes.groupBy(*TRACE).agg(
        F.max_by(
            F.when(F.col("resp") != F.col("dst"), F.col("resp")),
            F.when(F.col("resp") != F.col("dst"), F.struct(F.col("ttl"), -F.col("resp"))),
        ).alias("last")
    )
    return (
        last.select(F.coalesce("last", "src").alias("ip1"), F.col("dst").alias("ip2")).where("ip1 <> ip2").distinct()
        .withColumn("link_type", F.lit(pf.UNKNOWN))
    )


def probe_counts(probes: DataFrame) -> DataFrame:
    """Identical probes of a source, whatever the destination, with their number."""
    return probes.groupBy("src", "ttl", "resp", "rr").agg(F.count(F.lit(1)).alias("n"))


def probe_ids(probes: DataFrame) -> DataFrame:
    """Stable id `src_<digest>` per distinct probe."""
    d = probes.select("src", "ttl", "resp", "rr").distinct()
    text = F.concat_ws("|", F.col("src").cast("string"), F.col("ttl").cast("string"), F.col("resp").cast("string"),
                       F.coalesce(F.array_join(F.col("rr").cast("array<string>"), ","), F.lit("tr")))
    return d.withColumn("id", F.concat(F.col("src").cast("string"), F.lit("_"), F.sha1(text)))


def first_probe_wins(probes: DataFrame, line_no: str = "line_no") -> DataFrame:
    """First line per (trace, ttl, it)."""
    keys = [*TRACE, "ttl", "it"]
    rest = [c for c in probes.columns if c not in keys]
    return probes.groupBy(*keys).agg(F.min_by(F.struct(*rest), line_no).alias("_r")).select(*keys, "_r.*")


def route_change(tr: DataFrame) -> DataFrame:
    return hop_set(tr).groupBy(*TRACE, "ttl").agg(F.count(F.lit(1)).alias("n_resp")).where("n_resp > 1")


def ip_visibility(probes: DataFrame) -> DataFrame:
    """T: only answered; R: only recorded; B: both."""
    a = probes.select(F.col("resp").alias("ip"), F.lit(1).alias("bit"))
    r = probes.where("rr IS NOT NULL").select(F.explode("rr").alias("ip"), F.lit(2).alias("bit"))
    return merge_bits(a.unionByName(r))


def merge_bits(df: DataFrame) -> DataFrame:
    b = df.groupBy("ip").agg(F.bit_or("bit").alias("bits"))
    return b.select("ip", F.when(F.col("bits") == 1, "T").when(F.col("bits") == 2, "R").otherwise("B").alias("label"))


def merge_visibility(labels: DataFrame) -> DataFrame:
    """Labels of several inputs combined: any difference, or a B, gives B."""
    bit = F.when(F.col("label") == "T", 1).when(F.col("label") == "R", 2).otherwise(3)
    return merge_bits(labels.select("ip", bit.alias("bit")))


def visibility_totals(labels: DataFrame) -> DataFrame:
    c = lambda l: F.count_if(F.col("label") == l)
    return labels.agg(
        F.count(F.lit(1)).alias("total"), (c("T") + c("B")).alias("n_tr"), (c("R") + c("B")).alias("n_rr"),
        c("T").alias("tr_only"), c("R").alias("rr_only"),
    )


def drops_rr(probes: DataFrame, iterations: int, distance: int = 10) -> DataFrame:
    """TTLs under the record-route distance where no RR answer came but at least half the iterations were answered."""
    return (
        probes.where(F.col("ttl") < distance).groupBy(*TRACE, "ttl")
        .agg(F.count_if(F.col("rr").isNotNull()).alias("n_rr"), F.count_if(F.col("rr").isNull()).alias("n_tr"))
        .where((F.col("n_rr") == 0) & (F.col("n_tr") >= iterations / 2)).select(*TRACE, "ttl", "n_tr")
    )


def best_link(links: DataFrame) -> DataFrame:
    return links.groupBy("ip1", "ip2").agg(F.min("link_type").alias("link_type"))


def clique_traces(traces: DataFrame, ips: DataFrame) -> DataFrame:
    """Traces whose source and destination are both listed."""
    s, d = ips.select(F.col("ip").alias("src")), ips.select(F.col("ip").alias("dst"))
    return traces.where("src <> dst").join(s, "src", "left_semi").join(d, "dst", "left_semi")


def enumerate_cliques(traces: DataFrame) -> DataFrame:
    """Unordered pairs of sources with traces between them.

    A pair job over sources without a trace between them has no facts, so only pairs that occur are listed; the work
    grows with the traces, not with the square of the sources.
    """
    src = traces.select(F.col("src").alias("ip")).distinct()
    return clique_traces(traces.select("src", "dst").distinct(), src).select(
        F.least("src", "dst").alias("src1"), F.greatest("src", "dst").alias("src2")
    ).distinct()


def enumerate_srcdst(traces: DataFrame) -> DataFrame:
    """Consecutive source pairs (every other one, the last wraps to the first) with the destinations either traced."""
    from .ranking import global_rank

    pairs = traces.select("src", "dst").distinct()
    ranked = global_rank(pairs.select("src").distinct(), ["src"])
    even = ranked.where("rank % 2 = 0").select(F.col("rank").alias("slot"), F.col("src").alias("src1"), "total")
    even = even.withColumn("mate", (F.col("slot") + 1) % F.col("total"))
    mate = ranked.select(F.col("rank").alias("mate"), F.col("src").alias("src2"))
    slots = even.join(mate, "mate").select("slot", "src1", "src2")
    member = slots.select("slot", "src1", "src2", F.explode(F.array_distinct(F.array("src1", "src2"))).alias("src"))
    return member.join(pairs, "src").select("slot", "src1", "src2", "dst").distinct()


def trace_display(probes: DataFrame, kind: str = "all") -> DataFrame:
    """Reduced view with counts: `all`, `rr` or `tr` probes."""
    p = probes if kind == "all" else probes.where("rr IS NOT NULL" if kind == "rr" else "rr IS NULL")
    shown = F.when(F.col("rr").isNull(), "-").otherwise(F.array_join(F.col("rr").cast("array<string>"), " "))
    return p.groupBy("src", "dst", "ttl", "resp", shown.alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def type_c_router(rr_probes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Addresses that in every record-route answer were themselves the last recorded entry."""
    own = (F.size("rr") > 0) & (F.try_element_at("rr", F.lit(-1)) == F.col("resp"))
    c = rr_probes.groupBy(F.col("resp").alias("ip")).agg(F.bool_and(F.coalesce(own, F.lit(False))).alias("own"))
    c = c.where("own").select("ip")
    return c if excluded is None else c.join(excluded.select("ip").distinct(), "ip", "left_anti")


def rr_index_reversed(rr_probes: DataFrame) -> DataFrame:
    """`(probe columns, idx, ip)` with idx 1 the latest recorded address."""
    keep = [c for c in rr_probes.columns if c != "rr"]
    return rr_probes.select(*keep, F.posexplode(F.reverse("rr")).alias("pos", "ip")).select(
        *keep, (F.col("pos") + 1).alias("idx"), "ip"
    )


def rpt_bandwidth(probes: DataFrame, payload: int = 9334) -> DataFrame:
    """Bandwidth from a Macro/Pollo pair per (trace, ttl, it): bytes between them over the time between them.

    Input needs `it, ptype, t (seconds), is_rr, line_no`; the last line of a type counts.
    """
    pick = lambda k: F.max_by(
        F.when(F.col("ptype") == k, F.struct("t", "resp")), F.when(F.col("ptype") == k, F.col("line_no"))
    )
    g = probes.groupBy(*TRACE, "ttl", "it").agg(
        pick("Macro").alias("m"), pick("Pollo").alias("p"), F.max_by("is_rr", "line_no").alias("is_rr")
    )
    top = probes.groupBy(*TRACE).agg(F.max("ttl").alias("maxttl"))
    g = g.where("m IS NOT NULL AND p IS NOT NULL").join(top, TRACE)
    size = F.lit(payload) + F.when(F.col("is_rr"), 80).otherwise(40) * (F.col("maxttl") - F.col("ttl"))
    delta = F.col("p.t") - F.col("m.t")
    return g.select(
        *TRACE, "ttl", "it", F.col("m.resp").alias("ip"), delta.alias("delta"), size.alias("bytes"),
        F.try_divide(size, delta).alias("bw"), (F.col("m.resp") != F.col("p.resp")).alias("flap"),
    )


def multi_address_hosts(routers: DataFrame) -> DataFrame:
    """Sources and end hosts with more than one address, one row per address."""
    h = routers.where(F.col("kind").isin("Source", "Endhost"))
    many = h.groupBy("router").agg(F.count_distinct("ip").alias("n")).where("n > 1").select("router")
    return h.join(many, "router", "left_semi").select("router", "kind", "ip")


def pending_targets(targets: DataFrame, traced: DataFrame) -> DataFrame:
    return targets.join(traced.select(*TRACE).distinct(), TRACE, "left_anti")
