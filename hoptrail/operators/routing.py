"""Prefixes, route loops and stop lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..functions import probe as pf
from .hops import TRACE
from .ranking import cdf

ROUTE_LOOP_STATE = 109


def _containing(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each distinct address with every listed prefix that contains it.

    An address is cut to every prefix length in use (33 at most) and meets prefixes by (net, len), an equi join.
    """
    lens = prefixes.select(F.collect_set(F.col("len").cast("int"))).scalar()
    d = ips.select("ip").distinct().withColumn("len", F.explode(lens))
    d = d.withColumn("net", F.col("ip").bitwiseAND(ipf.prefix_mask("len")))
    p = prefixes.withColumn("len", F.col("len").cast("int"))
    p = p.withColumn("net", F.col("net").bitwiseAND(ipf.prefix_mask("len")))
    return d.join(p, ["net", "len"])


def ip_to_asn(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(ip, asn, len) by longest prefix; addresses outside all prefixes have no row. A prefix with several origins
    gives the lowest."""
    one = prefixes.groupBy("net", "len").agg(F.min("asn").alias("asn"))
    return _containing(ips, one).groupBy("ip").agg(F.max_by("asn", "len").alias("asn"), F.max("len").alias("len"))


def filter_codes(ips: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(ip, bits): protocols a blacklist forbids for an address, over all prefixes that contain it."""
    return _containing(ips, blacklist.select("net", "len", "bits")).groupBy("ip").agg(F.bit_or("bits").alias("bits"))


def filter_blacklist(ips: DataFrame, blacklist: DataFrame, bits: int = 7) -> DataFrame:
    """Rows whose address lies in no prefix listed for one of the protocols in ``bits``."""
    hit = filter_codes(ips, blacklist).where(F.col("bits").bitwiseAND(F.lit(bits)) != 0).select("ip")
    return ips.join(hit, "ip", "left_anti")


def route_loops(states: DataFrame, lines: DataFrame, last: int = 10, state: int = ROUTE_LOOP_STATE) -> DataFrame:
    """Last lines of every trace that ended in the loop state. `states(trace, state)`, `lines(trace, pos, value)`."""
    loops = states.where(F.col("state") == state).select("trace").distinct()
    w = W.partitionBy("trace").orderBy(F.desc("pos"))
    d = lines.join(loops, "trace", "left_semi").withColumn("back", F.row_number().over(w))
    return d.where(F.col("back") <= last)


def loop_routers(tr: DataFrame, loops: DataFrame) -> DataFrame:
    """(ip, traces): in how many looping traces an address answered at more than one place.

    `tr(src, dst, ttl, resp)` are plain answers, `loops(src, dst)` the traces that loop.
    """
    per = tr.join(loops.select(*TRACE).distinct(), TRACE, "left_semi").groupBy(*TRACE, "resp").agg(F.count(F.lit(1)).alias("n"))
    return per.where("n > 1").groupBy(F.col("resp").alias("ip")).agg(F.count(F.lit(1)).alias("traces"))


def loop_routers_by_as(routers: DataFrame, asn: DataFrame) -> DataFrame:
    """Traces and distinct routers in loops per AS; unknown addresses go to AS 0."""
    return routers.join(asn.select("ip", "asn"), "ip", "left").groupBy(F.coalesce("asn", F.lit("0")).alias("asn")).agg(
        F.sum("traces").alias("traces"), F.count(F.lit(1)).alias("routers"))


def loop_ends(loops: DataFrame, octets: int = 2) -> DataFrame:
    """Looping traces per subnet of the source and of the destination."""
    e = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("ip")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("ip"))))
    d = loops.select(*TRACE).distinct().select(e.alias("e")).select("e.*")
    return d.groupBy("side", ipf.subnet_key(ipf.int_to_ip("ip"), octets).alias("subnet")).agg(F.count(F.lit(1)).alias("n"))


def disjoint_path_summary(paths: DataFrame) -> DataFrame:
    """Average and distribution of path counts per AS pair `(a, b, n)`; a pair with itself is left out."""
    d = paths.where("a <> b")
    c = cdf(d, "n", min_delta=0).groupBy("value").agg(F.max("p").alias("p")).where("p > 0")
    return c.withColumn("average", d.agg(F.avg("n")).scalar())


def stop_list(hops: DataFrame, distance: int = 3) -> DataFrame:
    """(trace, pos, ip): the last responders before the destination answered; pos 0 is the nearest.

    `hops(src, dst, ttl, resp)`; traces the destination never answered have none.
    """
    end = hops.where("resp = dst").groupBy(*TRACE).agg(F.min("ttl").alias("end"))
    d = hops.where("resp <> dst").groupBy(*TRACE, "ttl").agg(F.min("resp").alias("ip")).join(end, TRACE)
    pos = F.col("end") - F.col("ttl") - 1
    return d.where((pos >= 0) & (pos < distance)).select(*TRACE, pos.alias("pos"), "ip")


def stop_at_stoplist(probes: DataFrame, stops: DataFrame) -> DataFrame:
    """Probes up to the first hop in the trace's stop list, or the first full record list on an odd iteration.

    `probes(src, dst, it, ttl, resp, rr)`; every iteration of a trace is cut on its own.
    """
    s = stops.select(*TRACE, F.col("ip").alias("resp"), F.lit(True).alias("listed")).distinct()
    d = probes.join(s, [*TRACE, "resp"], "left")
    full = (F.pmod("it", F.lit(2)) == 1) & (F.coalesce(F.size("rr"), F.lit(0)) >= pf.RR_SLOTS)
    cut = d.where(F.coalesce("listed", F.lit(False)) | full).groupBy(*TRACE, "it").agg(F.min("ttl").alias("stop"))
    return probes.join(cut, [*TRACE, "it"], "left").where("stop IS NULL OR ttl <= stop").drop("stop")


def trace_inventory(expected: DataFrame, bad_sources: DataFrame, files: DataFrame) -> DataFrame:
    """Expected traces by what became of them: bad_source, missing, small (under 10 bytes), loop or good."""
    b = bad_sources.select("src", F.lit(True).alias("bad")).distinct()
    d = expected.join(b, "src", "left").join(files.select(*TRACE, "size", "state"), TRACE, "left")
    kind = (
        F.when(F.col("bad"), "bad_source").when(F.col("size").isNull(), "missing").when(F.col("size") < 10, "small")
        .when(F.col("state") == ROUTE_LOOP_STATE, "loop").otherwise("good"))
    return d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def archive_sizes(spark, path: str) -> DataFrame:
    """Bytes and files per folder, from file metadata only."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("archive")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
