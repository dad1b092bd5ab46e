"""Distances of addresses by reply TTLs seen from several vantage points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe as pf
from ..session import cut_lineage
from .ranking import global_rank


def latest_valid_ttl(rows: DataFrame, newest=("ts",)) -> DataFrame:
    """Per (vantage, ip) the newest row with an expected reply; its TTL by preference UDP, ICMP, TCP, normalized.

    ``newest`` are the columns that order rows; -1 where no preferred TTL is above 0.
    """
    good = lambda p: (F.col(p) >= 0) & (F.col(f"{p}r") == "-")
    valid = rows.where(good("udp") | good("tcp") | good("icmp"))
    pos = lambda p: F.when((F.col(p) > 0) & (F.col(f"{p}r") == "-"), F.col(p))
    d = pf.normalize_ttl(F.coalesce(pos("udp"), pos("icmp"), pos("tcp"), F.lit(-1)))
    return valid.groupBy("vantage", "ip").agg(F.max_by(d, F.struct(*newest)).alias("d"))


def ip_distance(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    """Mean absolute TTL difference over common vantages, and their number; -1 and 0 if there is none."""
    a = coords.select(F.col("ip").alias("ip1"), "vantage", F.col("d").alias("d1"))
    b = coords.select(F.col("ip").alias("ip2"), "vantage", F.col("d").alias("d2"))
    p = pairs.select("ip1", "ip2").distinct()
    m = p.join(a, "ip1").join(b, ["ip2", "vantage"]).groupBy("ip1", "ip2").agg(
        F.avg(F.abs(F.col("d1") - F.col("d2"))).alias("d"), F.count(F.lit(1)).alias("n"))
    return p.join(m, ["ip1", "ip2"], "left").select(
        "ip1", "ip2", F.coalesce("d", F.lit(-1.0)).alias("d"), F.coalesce("n", F.lit(0)).alias("n"))


def link_ip_distance(links: DataFrame, coords: DataFrame, min_n: int = 1) -> DataFrame:
    """Distance per graph link seen by at least ``min_n`` common vantages; self links are skipped."""
    return ip_distance(links.where("ip1 <> ip2"), coords).where(F.col("n") >= min_n)


BLOCK = 2048    # addresses of a block; a task compares two blocks at a time, so its memory does not depend on the table


def _close(a: list, b: list, same: bool, max_d: float):
    """Pairs of two blocks' addresses within the limit, by strips of ``a``; blocks are lists of (ip, places, ds)."""
    places = sorted({p for _, ps, _ in a for p in ps} & {p for _, ps, _ in b for p in ps})
    column = {p: i for i, p in enumerate(places)}

    def dense(rows):
        d, seen = np.zeros((len(rows), len(places))), np.zeros((len(rows), len(places)))
        for i, (_, ps, ds) in enumerate(rows):
            at = [(column[p], x) for p, x in zip(ps, ds) if p in column]
            d[i, [c for c, _ in at]], seen[i, [c for c, _ in at]] = [x for _, x in at], 1
        return np.array([ip for ip, _, _ in rows], np.int64), d, seen

    (ip1, d1, s1), (ip2, d2, s2) = dense(a), dense(b)
    d2, s2 = np.ascontiguousarray(d2.T), np.ascontiguousarray(s2.T)
    for lo in range(0, len(ip1), 32):
        x, s = d1[lo:lo + 32], s1[lo:lo + 32]
        total = np.zeros((len(x), len(ip2)))
        for v in range(len(places)):
            gap = np.abs(x[:, v, None] - d2[v])
            if not (s[:, v].all() and s2[v].all()):
                gap *= s[:, v, None] * s2[v]
            total += gap
        n = s @ s2
        mean = np.divide(total, n, out=np.full_like(total, np.inf), where=n > 0)
        keep = mean <= max_d
        if same:
            keep &= ip1[lo:lo + 32, None] < ip2
        i, j = np.nonzero(keep)
        one, two = ip1[lo + i], ip2[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(mean[i, j]),
                                          pa.array(n[i, j].astype(np.int64))], names=["ip1", "ip2", "d", "n"])


def pairs_within_distance(coords: DataFrame, max_d: float) -> DataFrame:
    """All pairs with a mean difference of at most ``max_d``; `coords(vantage, ip bigint, d)`, one row per vantage and ip.

    At a limit near the mean difference most pairs meet at some vantage, so candidates would outgrow the result by the
    number of vantages. Addresses are dealt to blocks instead, those with the same vantages side by side; blocks with a
    common vantage meet in one row, and a task gives the pairs of two blocks as they are found. Shuffled is each block
    once per partner; pairs are never shuffled.
    """
    spark = coords.sparkSession
    seen = coords.where("ip IS NOT NULL AND vantage IS NOT NULL AND d IS NOT NULL")
    place = global_rank(seen.select("vantage").distinct(), ["vantage"], "place").select("vantage", "place")
    rows = seen.join(place, "vantage").groupBy("ip").agg(F.sort_array(F.collect_list(F.struct("place", F.col("d").cast("double").alias("d")))).alias("v"))
    rows = rows.select("ip", F.col("v.place").alias("places"), F.col("v.d").alias("ds"))
    ranked = global_rank(rows, ["places", "ip"]).withColumn("block", F.floor(F.col("rank") / BLOCK))
    block = cut_lineage(ranked.groupBy("block").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.collect_list(F.struct("ip", "places", "ds")).alias("rows")))
    at = block.select("block", F.explode("places").alias("place"))
    met = at.join(at.select("place", F.col("block").alias("other")), "place").where("block <= other").select("block", "other").distinct()
    sides = met.select("block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("side"))
    # a fixed number of partitions: joining them by size would leave the comparing to a few tasks
    dealt = sides.join(block.select(F.col("block").alias("side"), "rows"), "side").repartition(
        4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "other")
    pairs = dealt.groupBy("block", "other").agg(F.max_by("rows", -F.col("side")).alias("a"), F.max_by("rows", "side").alias("b"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, a, b = (batch.column(c)[k].as_py() for c in ("block", "other", "a", "b"))
                tuples = lambda rows: [(r["ip"], r["places"], r["ds"]) for r in rows]
                yield from _close(tuples(a), tuples(b), i == j, max_d)

    return pairs.mapInArrow(compare, "ip1 bigint, ip2 bigint, d double, n bigint")


def random_pair_distance(coords: DataFrame, k: int, max_threshold: int, seed: int = 0) -> DataFrame:
    """``k`` random address pairs (never an address with itself), listed for every threshold their vantages reach."""
    ranked = global_rank(coords.select("ip").distinct(), ["ip"])
    n = coords.select(F.count_distinct("ip")).scalar()
    digest = lambda salt: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(salt))), 256)
    draw = lambda salt: F.pmod(F.conv(F.substring(digest(salt), 1, 15), 16, 10).cast("bigint"), n)
    p = coords.sparkSession.range(k).withColumn("i1", draw(1)).withColumn("i2", draw(2)).withColumn("n", n)
    p = p.withColumn("i2", F.when(F.col("i1") == F.col("i2"), F.pmod(F.col("i2") + 1, F.col("n"))).otherwise(F.col("i2")))
    for i in ("1", "2"):
        p = p.join(ranked.select(F.col("rank").alias(f"i{i}"), F.col("ip").alias(f"ip{i}")), f"i{i}")
    d = ip_distance(p, coords)
    return d.select(F.explode(F.sequence(F.lit(max_threshold), F.lit(0), F.lit(-1))).alias("threshold"), "ip1", "ip2", "d", "n").where("n >= threshold")
