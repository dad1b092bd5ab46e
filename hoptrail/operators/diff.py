"""Set comparisons of addresses, alias pairs and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe as pf
from .addresses import touches_prefix

PAIR = ["ip1", "ip2"]


def diff_ips(left: DataFrame, right: DataFrame) -> DataFrame:
    """`-` only left, `+` only right."""
    bit = left.select("ip", F.lit(1).alias("bit")).unionByName(right.select("ip", F.lit(2).alias("bit")))
    b = bit.groupBy("ip").agg(F.bit_or("bit").alias("bits")).where("bits < 3")
    return b.select("ip", F.when(F.col("bits") == 1, "-").otherwise("+").alias("side"))


def _canon(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least(*PAIR).alias("ip1"), F.greatest(*PAIR).alias("ip2")).distinct()


def _ips(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(*PAIR)).alias("ip")).distinct()


def _seen(df: DataFrame, ips: DataFrame, name: str) -> DataFrame:
    for c in PAIR:
        df = df.join(ips.select(F.col("ip").alias(c), F.lit(True).alias(f"{name}_{c}")), c, "left")
    return df


def diff_aliases(left: DataFrame, right: DataFrame, intersect_only: bool = True) -> DataFrame:
    """`(ip1, ip2, side)`, side left/right/both. With ``intersect_only`` a one-sided pair is listed only if both its
    addresses occur on the other side; for the addresses that do not see `skipped_ips`."""
    pair = lambda d, bit: d.select(F.least(*PAIR).alias("ip1"), F.greatest(*PAIR).alias("ip2"), F.lit(bit).alias("bit"))
    tagged = pair(left, 1).unionByName(pair(right, 2))
    d = tagged.groupBy(*PAIR).agg(F.bit_or("bit").alias("bits"))
    if intersect_only:
        known = _ip_masks(tagged).where("mask = 3").select("ip", F.lit(True).alias("known"))
        for c in PAIR:
            d = d.join(known.withColumnsRenamed({"ip": c, "known": f"known_{c}"}), c, "left")
        d = d.where("bits = 3 OR known_ip1 AND known_ip2")
    return d.select(*PAIR, F.when(F.col("bits") == 3, "both").when(F.col("bits") == 1, "left").otherwise("right").alias("side"))


def skipped_ips(left: DataFrame, right: DataFrame) -> DataFrame:
    """Addresses of one-sided pairs that the other side does not know: (ip, side)."""
    l, r = _canon(left), _canon(right)
    one = lambda a, b, s: _ips(a.join(b, PAIR, "left_anti")).join(_ips(b), "ip", "left_anti").withColumn("side", F.lit(s))
    return one(l, r, "left").unionByName(one(r, l, "right"))


def diff_aliases3(left: DataFrame, middle: DataFrame, right: DataFrame, raw: bool = False) -> DataFrame:
    """`(ip1, ip2, mask)` over bits left=1, middle=2, right=4; unless ``raw`` only pairs whose addresses all three know."""
    tagged = None
    for bit, d in ((1, left), (2, middle), (4, right)):
        t = _canon(d).withColumn("bit", F.lit(bit))
        tagged = t if tagged is None else tagged.unionByName(t)
    m = tagged.groupBy(*PAIR).agg(F.bit_or("bit").cast("int").alias("mask"))
    if raw:
        return m
    full = _ip_masks(tagged).where("mask = 7").select("ip")
    for c in PAIR:
        m = m.join(full.withColumnRenamed("ip", c), c, "left_semi")
    return m.select(*PAIR, "mask")


def _ip_masks(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode(F.array(*PAIR)).alias("ip"), "bit").groupBy("ip").agg(F.bit_or("bit").cast("int").alias("mask"))


def diff_ips3(left: DataFrame, middle: DataFrame, right: DataFrame) -> DataFrame:
    tagged = None
    for bit, d in ((1, left), (2, middle), (4, right)):
        t = d.select(*PAIR, F.lit(bit).alias("bit"))
        tagged = t if tagged is None else tagged.unionByName(t)
    return _ip_masks(tagged)


def diff_graphs(left: DataFrame, right: DataFrame, prefixes: list[tuple[int, int]] | None = None, common: bool = False) -> DataFrame:
    """Transitions between two graphs given as `(item, ip1, ip2, link_type)`, item alias or link.

    `op` is REMOVING or ADDING (COMMON on request). An item with an address the other graph does not know is reported
    as that address only (item ip). Both sides follow the same rule, no address is its own alias, and UNKNOWN links do
    not count for the choice by prefix.
    """
    def pick(g):
        g = g.where("item <> 'alias' OR ip1 <> ip2")
        return g if not prefixes else g.where(touches_prefix(PAIR, prefixes) & ((F.col("item") != "link") | (F.col("link_type") != pf.UNKNOWN)))

    l, r = pick(left).select("item", *PAIR).distinct(), pick(right).select("item", *PAIR).distinct()
    li, ri = _ips(l), _ips(r)
    bits = l.withColumn("bit", F.lit(1)).unionByName(r.withColumn("bit", F.lit(2))).groupBy("item", *PAIR).agg(F.bit_or("bit").alias("bits"))
    known = _seen(_seen(bits, li, "l"), ri, "r")
    both = lambda n: F.coalesce(F.col(f"{n}_ip1"), F.lit(False)) & F.coalesce(F.col(f"{n}_ip2"), F.lit(False))
    op = F.when((F.col("bits") == 1) & both("r"), "REMOVING").when((F.col("bits") == 2) & both("l"), "ADDING")
    if common:
        op = op.when(F.col("bits") == 3, "COMMON")
    items = known.withColumn("op", op).where("op IS NOT NULL").select("op", "item", *PAIR)
    ip = lambda a, b, o: a.join(b, "ip", "left_anti").select(
        F.lit(o).alias("op"), F.lit("ip").alias("item"), F.col("ip").alias("ip1"), F.lit(None).cast("bigint").alias("ip2"))
    return items.unionByName(ip(li, ri, "REMOVING")).unionByName(ip(ri, li, "ADDING"))


def graph_subset(routers: DataFrame, links: DataFrame, prefixes: list[tuple[int, int]]):
    """Sub-graph that touches the prefixes. Routers with an interesting address stay whole; a router that only a chosen
    link names is re-created from that link's ends. `links(r1, ip1, r2, ip2, link_type)`."""
    hit = routers.where(touches_prefix(["ip"], prefixes)).select("router").distinct()
    kept = routers.join(hit, "router", "left_semi").select("router", "ip")
    l = links.where(touches_prefix(["ip1", "ip2"], prefixes))
    ends = l.select(F.explode(F.array(F.struct(F.col("r1").alias("router"), F.col("ip1").alias("ip")),
                                      F.struct(F.col("r2").alias("router"), F.col("ip2").alias("ip")))).alias("e")).select("e.*").distinct()
    return kept.unionByName(ends.join(hit, "router", "left_anti")).distinct(), l


def union_facts(*facts: DataFrame) -> DataFrame:
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out.distinct()


def subset_compare(aliases1, links1, types1, aliases2, links2, types2) -> DataFrame:
    """What graph 1 lacks of graph 2, as counts and shares: alias pairs whose first address graph 1 knows, links over
    addresses it knows, types of shared addresses, and addresses. `types(ip, type)` lists every address of a graph."""
    known = types1.groupBy("ip").agg(F.min("type").alias("t1"))
    ends = lambda d: d.join(known.select(F.col("ip").alias("ip1")), "ip1", "left_semi").join(
        known.select(F.col("ip").alias("ip2")), "ip2", "left_semi")
    have = lambda d: _canon(d).withColumn("have", F.lit(True))
    firsts = aliases2.join(known.select(F.col("ip").alias("ip1")), "ip1", "left_semi")
    a = _canon(firsts).join(have(aliases1), PAIR, "left")
    canon_l = ends(links2).select(F.least(*PAIR).alias("ip1"), F.greatest(*PAIR).alias("ip2"))
    l = canon_l.join(have(links1), PAIR, "left")
    t = types2.join(known, "ip", "left")
    one = lambda d, what, total, missing: d.agg(F.lit(what).alias("what"), F.count_if(total).alias("total"), F.count_if(missing).alias("missing"))
    miss = F.col("have").isNull()
    rows = (
        one(a, "aliases", F.lit(True), miss).unionByName(one(l, "links", F.lit(True), miss))
        .unionByName(one(t, "types", F.col("t1").isNotNull(), F.col("t1") != F.col("type")))
        .unionByName(one(t, "ips", F.lit(True), F.col("t1").isNull()))
    )
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("missing"), F.col("total")), F.lit(0.0)))


def score_alias_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """`pairs(input, ip1, ip2)` against `labels(ip1, ip2, label good|bad)`: counts and falseP% = 100*bad/(bad+good).

    A pair labelled both ways counts as bad.
    """
    c = lambda d, *more: d.select(*more, F.least(*PAIR).alias("ip1"), F.greatest(*PAIR).alias("ip2")).distinct()
    lab = labels.select(F.least(*PAIR).alias("ip1"), F.greatest(*PAIR).alias("ip2"), "label").groupBy(*PAIR).agg(F.min("label").alias("label"))
    j = c(pairs, "input").join(lab, PAIR, "left")
    n = lambda x: F.count_if(F.col("label") == x)
    return j.groupBy("input").agg(
        n("bad").alias("bad"), n("good").alias("good"), F.count(F.lit(1)).alias("total"),
        F.try_divide(100.0 * n("bad"), n("bad") + n("good")).alias("false_pct"))


def attach_hostnames(df: DataFrame, names: DataFrame, ip: str = "ip") -> DataFrame:
    """Name of each address from a given table, `??` where it has none."""
    n = names.groupBy(F.col("ip").alias(ip)).agg(F.min("name").alias("name"))
    return df.join(n, ip, "left").withColumn("name", F.coalesce("name", F.lit("??")))
