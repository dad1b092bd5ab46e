"""Round-trip and per-hop delay statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probe import router_clock_ms
from ..session import cut_lineage
from . import series as S


def smooth(rtt: int, mdev: int, x: int, start: str) -> tuple[int, int]:
    """One step of the integer estimator: rtt moves by an eighth of the error, mdev by a quarter; shifts floor."""
    err = x - rtt
    rtt = x if start == "first" and rtt == 0 else rtt + (err >> 3)
    return rtt, mdev + ((abs(err) - mdev) >> 2)


SEGMENT = 384   # samples in a row that bring any two 64-bit estimates to within a few units of each other


def _move(r, x, start: str):
    moved = r + F.shiftright(x - r, 3)
    return F.when(r == 0, x).otherwise(moved) if start == "first" else moved


def _turn(m, r, x):
    return m + F.shiftright(F.abs(x - r) - m, 2)


def _possible_rtt(low, high, start: str):
    """Estimates a segment can end with from any start in [low, high]: a range, and those that restarted on their own.

    A step keeps the order of two estimates, so the two ends of a range bound it. Only an estimate of 0 under `first`
    leaves the order: it takes the sample, and is followed as a value of its own until it is back in the range.
    """
    none = F.array().cast("array<bigint>")

    def step(acc, e):
        x, p, q = e["rtt"], acc["p"], acc["q"]
        moved = lambda r: r + F.shiftright(x - r, 3)
        if start != "first":
            return F.struct(moved(p).alias("p"), moved(q).alias("q"), acc["own"].alias("own"))
        holds_zero, only_zero = (p <= 0) & (q >= 0), (p == 0) & (q == 0)
        p2 = F.when(only_zero, x).otherwise(moved(F.when(p == 0, 1).otherwise(p)))
        q2 = F.when(only_zero, x).otherwise(moved(F.when(q == 0, -1).otherwise(q)))
        own = F.transform(acc["own"], lambda r: _move(r, x, start))
        own = F.when(holds_zero & ~only_zero, F.array_append(own, x)).otherwise(own)
        return F.struct(p2.alias("p"), q2.alias("q"), F.filter(F.array_distinct(own), lambda r: (r < p2) | (r > q2)).alias("own"))

    s = F.aggregate("v", F.struct(low.alias("p"), high.alias("q"), none.alias("own")), step)
    return F.transform(F.array(s), lambda a: F.concat(F.sequence(a["p"], a["q"]), a["own"]))[0]


def _fold(r0, m0, start: str):
    """State (a, p) after a segment that starts with the estimate r0 and the deviation m0."""
    step = lambda acc, e: F.struct(_move(acc["a"], e["rtt"], start).alias("a"), _turn(acc["p"], acc["a"], e["rtt"]).alias("p"))
    return F.aggregate("v", F.struct(r0.alias("a"), m0.alias("p")), step)


def _possible_mdev(r0, low, high, start: str):
    """Deviations a segment can end with from any start in [low, high], its estimates being known."""
    def step(acc, e):
        x, a = e["rtt"], acc["a"]
        return F.struct(_move(a, x, start).alias("a"), _turn(acc["p"], a, x).alias("p"), _turn(acc["q"], a, x).alias("q"))

    s = F.aggregate("v", F.struct(r0.alias("a"), low.alias("p"), high.alias("q")), step)
    return F.transform(F.array(s), lambda a: F.sequence(a["p"], a["q"]))[0]


def _settled(steps: DataFrame) -> DataFrame:
    """(conn, seg, at): the start each segment really has, of `steps(conn, seg, at, to)` from its possible ones.

    A segment with one possible start is settled. The others follow by doubled jumps along `to`, so a chain of N open
    segments takes log N rounds.
    """
    key = ["conn", "seg"]
    sizes = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    known = cut_lineage(steps.join(sizes.where("n = 1"), key).select(*key, "at"))
    left = cut_lineage(sizes.where("n > 1").select(*key))
    jump = steps.select(*key, "at", (F.col("seg") + 1).alias("seg2"), F.col("to").alias("at2"))
    while not left.isEmpty():
        found = known.join(jump, [*key, "at"]).select("conn", F.col("seg2").alias("seg"), F.col("at2").alias("at")).join(left, key)
        found = cut_lineage(found)
        known, left = known.unionByName(found), cut_lineage(left.join(found.select(*key), key, "left_anti"))
        onward = jump.select("conn", F.col("seg").alias("seg2"), F.col("at").alias("at2"), F.col("seg2").alias("seg4"), F.col("at2").alias("at4"))
        jump = cut_lineage(jump.join(onward, ["conn", "seg2", "at2"]).select(*key, "at", F.col("seg4").alias("seg2"), F.col("at4").alias("at2")))
    return known


def rtt_states(samples: DataFrame, order: list[str], start: str = "zero", least: bool = False) -> DataFrame:
    """(conn, seg, v, rtt0, mdev0): each connection's samples in order, cut after every SEGMENT of them, and the state
    before each segment; exact for any length of a connection and any samples.

    A segment's possible ends are few whatever its start, so it is folded from all of them at once. First the estimates
    are settled along the segments, then the deviations, which need the estimates. ``least`` adds the smallest round
    trip up to each sample.
    """
    runs = S.numbered(S.in_runs(samples, ["conn"], order), ["conn"], "_pos")
    if least:
        runs = S.running_min(runs, ["conn"], ["_pos"], "rtt", "base")
    item = F.struct("_pos", F.col("rtt").cast("bigint").alias("rtt"), *order, *(["base"] if least else []))
    segs = cut_lineage(runs.groupBy("conn", F.floor(F.col("_pos") / SEGMENT).alias("seg")).agg(
        F.array_sort(F.collect_list(item)).alias("v")))
    zero = F.lit(0).cast("bigint")
    if segs.where("seg > 0").isEmpty():
        return segs.select("*", zero.alias("rtt0"), zero.alias("mdev0"))
    ends = segs.agg(F.min(F.array_min(F.col("v.rtt"))), F.max(F.array_max(F.col("v.rtt")))).first()
    low, high = min(0, ends[0]), max(0, ends[1])
    first, full = F.col("seg") == 0, F.size("v") == SEGMENT
    bound = lambda x: F.when(first, 0).otherwise(F.lit(x)).cast("bigint")
    heads = segs.where(first).select("conn", "seg", zero.alias("at"))
    after = lambda d, possible: heads.unionByName(d.where(full).select("conn", (F.col("seg") + 1).alias("seg"), F.explode(possible).alias("at")))
    at = after(segs, _possible_rtt(bound(low), bound(high), start))
    steps = cut_lineage(segs.join(at, ["conn", "seg"]).select("conn", "seg", "at", _fold(F.col("at"), zero, start)["a"].alias("to")))
    segs = cut_lineage(segs.join(_settled(steps).withColumnRenamed("at", "rtt0"), ["conn", "seg"]))
    at = after(segs, _possible_mdev(F.col("rtt0"), zero, bound(high - low), start))
    steps = cut_lineage(segs.join(at, ["conn", "seg"]).select("conn", "seg", "at", _fold(F.col("rtt0"), F.col("at"), start)["p"].alias("to")))
    return segs.join(_settled(steps).withColumnRenamed("at", "mdev0"), ["conn", "seg"])


def rtt_ewma(samples: DataFrame, order: list[str], start: str = "zero") -> DataFrame:
    """(conn, srtt, mdev, n): smoothed round trip and deviation after the last sample, in arrival order.

    ``start`` is `zero` (from 0) or `first` (the first sample is taken as it is).
    """
    d = rtt_states(samples.select("conn", "rtt", *order), order, start)
    d = d.select("conn", "seg", F.size("v").cast("bigint").alias("n"), _fold(F.col("rtt0"), F.col("mdev0"), start).alias("s"))
    return d.groupBy("conn").agg(F.max_by("s.a", "seg").alias("srtt"), F.max_by("s.p", "seg").alias("mdev"), F.sum("n").alias("n"))


def _walk(batches, start: str):
    """Adds the states after every sample; all segments of a batch take their next sample together."""
    for b in batches:
        x = b.column("x")
        at, value = x.offsets.to_numpy().astype(np.int64), x.values.to_numpy()
        by_length = np.argsort(at[:-1] - at[1:], kind="stable")
        place, length = at[:-1][by_length], np.diff(at)[by_length]
        r, m = (b.column(c).to_numpy().astype(np.int64)[by_length] for c in ("rtt0", "mdev0"))
        srtt, mdev = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i))      # segments with more than i samples
            now, a = place[:n] + i, r[:n]
            err = value[now] - a
            m[:n] += (np.abs(err) - m[:n]) >> 2
            r[:n] = np.where(a == 0, value[now], a + (err >> 3)) if start == "first" else a + (err >> 3)
            srtt[now], mdev[now] = r[:n], m[:n]
        lists = [pa.ListArray.from_arrays(x.offsets, pa.array(c)) for c in (srtt, mdev)]
        yield pa.RecordBatch.from_arrays([b.column("conn"), b.column("v"), *lists], names=["conn", "v", "srtt", "mdev"])


def rtt_trace(samples: DataFrame, order: list[str], start: str = "first", least: bool = False) -> DataFrame:
    """Every sample with the smoothed values after it (``least``: and the smallest round trip so far, as `base`)."""
    d = rtt_states(samples.select("conn", "rtt", *order), order, start, least)
    d = d.select("conn", "v", F.col("v.rtt").alias("x"), "rtt0", "mdev0")
    types = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ("conn", "v"))
    d = d.mapInArrow(lambda batches: _walk(batches, start), types + ", srtt array<bigint>, mdev array<bigint>")
    d = d.select("conn", F.explode(F.arrays_zip("v", "srtt", "mdev")).alias("e"))
    return d.select("conn", "e.v.rtt", *[f"e.v.{c}" for c in order], *(["e.v.base"] if least else []), "e.srtt", "e.mdev")


def congestion_delay(samples: DataFrame, order: list[str]) -> DataFrame:
    """Smoothed round trip minus the smallest seen so far, per sample."""
    d = rtt_trace(samples, order, "first", least=True)
    return d.select("conn", *order, "rtt", "srtt", "base", (F.col("srtt") - F.col("base")).alias("congestion"))


def rtt_summary(probes: DataFrame, order: list[str]) -> DataFrame:
    """Per connection: sent, received, loss percent, min/avg/max and the smoothed values; a null rtt is a lost probe."""
    n, got = F.count(F.lit(1)), F.count("rtt")
    s = probes.groupBy("conn").agg(
        n.alias("sent"), got.alias("received"), (100.0 * (n - got) / n).alias("loss_pct"), F.min("rtt").alias("min_rtt"),
        F.coalesce(F.avg("rtt"), F.lit(-1.0)).alias("avg_rtt"), F.max("rtt").alias("max_rtt"))
    e = rtt_ewma(probes.where("rtt IS NOT NULL"), order, "zero").select("conn", "srtt", "mdev")
    return s.join(e, "conn", "left")


def hop_stamps(stamps: DataFrame, with_address: bool = False) -> DataFrame:
    """Raw router stamps by position; with addresses the entries alternate (address, stamp)."""
    if not with_address:
        return stamps.select("conn", "probe", F.posexplode("stamps").alias("pos", "stamp")).select(
            "conn", "probe", (F.col("pos") + 1).alias("hop"), "stamp")
    s = F.col("stamps")
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(s) / 2).cast("int")), lambda i: F.struct(
        F.element_at(s, i * 2 - 1).alias("ip"), F.element_at(s, i * 2).alias("stamp")))
    d = stamps.where(F.size(s) >= 2).select("conn", "probe", F.posexplode(pairs).alias("pos", "p"))
    return d.select("conn", "probe", (F.col("pos") + 1).alias("hop"), "p.ip", "p.stamp")


def hop_delay(stamps: DataFrame) -> DataFrame:
    """Differences between successive clocks of a probe, own send and receive times at the ends; hop 0 is the first."""
    full = F.concat(F.array(router_clock_ms("sent")), "stamps", F.array(router_clock_ms("recv")))
    d = stamps.where(F.size("stamps") > 0).withColumn("_f", full)
    diff = F.zip_with(F.expr("slice(_f, 2, size(_f) - 1)"), F.expr("slice(_f, 1, size(_f) - 1)"), lambda b, a: b - a)
    return d.select("conn", "probe", F.col("sent").alias("t"), F.posexplode(diff).alias("hop", "delay"))


def hop_queueing(stamps: DataFrame) -> DataFrame:
    """Delay of a hop minus its smallest delay before; a hop's first probe only sets the minimum."""
    runs = S.in_runs(hop_delay(stamps), ["conn", "hop"], ["t", "probe"])
    d = S.running_min(runs, ["conn", "hop"], ["t", "probe"], "delay", "least", inclusive=False)
    return d.where("least IS NOT NULL").select("conn", "hop", "probe", "delay", (F.col("delay") - F.col("least")).alias("queueing"))


def clock_precision(stamps: DataFrame) -> DataFrame:
    """Smallest positive step of each router clock, per connection and position."""
    d = stamps.select("conn", "probe", F.col("sent").alias("t"), F.posexplode("stamps").alias("hop", "stamp"))
    runs = S.lag_over(S.in_runs(d, ["conn", "hop"], ["t", "probe"]), ["conn", "hop"], ["t", "probe"], {"stamp": "prev"})
    step = F.col("stamp") - F.col("prev")
    return runs.where(step > 0).groupBy("conn", (F.col("hop") + 1).alias("hop")).agg(F.min(step).alias("precision"))
