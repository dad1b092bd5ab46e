"""Operators over sets of addresses and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip as ipf

# Addresses and prefixes that do not follow the off-by-one rule.
OFF_BY_ONE_EXCEPTIONS = [r"^198\.32\.8\.84", r"^216\.24\.186\."]


def distinct_ips(probes: DataFrame) -> DataFrame:
    """Every address in the probes: responders, recorded addresses and both ends."""
    ends = F.array("resp", "src", "dst")
    every = F.concat(ends, F.coalesce("rr", F.array().cast("array<bigint>")))
    return probes.select(F.explode(every).alias("ip")).where("ip IS NOT NULL").distinct()


def off_by_one_pairs(ips: DataFrame, exceptions: list[str] | None = None) -> DataFrame:
    """Ordered pairs of present addresses that differ by one inside a /30.

    ``fact`` is `offbyone`, or `offbyoneException` where either address matches a listed pattern. Each address offers
    its only possible partner as a join key, so work is linear.
    """
    # the partner inside the /30: 0-1, 1-0/2, 2-1/3, 3-2
    cand = ips.select("ip", F.explode(F.array(F.col("ip") - 1, F.col("ip") + 1)).alias("other")).where(
        ipf.off_by_one("ip", "other")
    )
    present = ips.select(F.col("ip").alias("other"))
    pairs = cand.join(present, "other", "left_semi").select(F.col("ip").alias("ip1"), F.col("other").alias("ip2"))
    patterns = OFF_BY_ONE_EXCEPTIONS if exceptions is None else exceptions
    hit = F.lit(False)
    for p in patterns:
        hit = hit | ipf.int_to_ip("ip1").rlike(p) | ipf.int_to_ip("ip2").rlike(p)
    return pairs.withColumn("fact", F.when(hit, "offbyoneException").otherwise("offbyone"))


def same_prefix24(ips: DataFrame) -> DataFrame:
    """Ordered pairs of distinct addresses in one /24; a /24 holds at most 256 addresses."""
    d = ips.select("ip").distinct().withColumn("net", F.shiftright("ip", 8))
    a, b = d.withColumnRenamed("ip", "ip1"), d.withColumnRenamed("ip", "ip2")
    return a.join(b, "net").where("ip1 <> ip2").select("ip1", "ip2")


def touches_prefix(cols: list[str], prefixes: list[tuple[int, int]]):
    """Condition: any of the columns lies in any listed prefix; an empty list accepts every row."""
    if not prefixes:
        return F.lit(True)
    cond = F.lit(False)
    for net, length in prefixes:
        for c in cols:
            cond = cond | ipf.prefix_match(F.lit(net).cast("bigint"), F.lit(length), c)
    return cond


def filter_prefixes(df: DataFrame, cols: list[str], prefixes: list[tuple[int, int]]) -> DataFrame:
    return df.where(touches_prefix(cols, prefixes))


def disaggregate_prefixes(prefixes: DataFrame, length: int, skip_asn: tuple[int, ...] = (65333,)) -> DataFrame:
    """First address of every prefix and of each of its sub-prefixes of ``length``, host part 1, unique."""
    p = prefixes.where(~F.col("asn").cast("bigint").isin(list(skip_asn)))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - F.col("len"))
    step = 1 << (32 - length)
    start = F.shiftleft(F.shiftright("net", 32 - length), 32 - length)
    subs = F.sequence(start, F.greatest(F.col("net") + size - 1, start), F.lit(step).cast("bigint"))
    inside = F.filter(subs, lambda s: s >= F.col("net"))
    return (
        p.select(F.explode(F.concat(F.array("net"), inside)).alias("net"))
        .select(F.col("net").bitwiseOR(F.lit(1)).alias("ip")).distinct()
    )
