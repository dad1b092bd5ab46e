"""Aliases by counter velocity: routers that share one identification counter step alike.

Samples are `(ip, t, id)`; a repeated time keeps one id. Series are handled in sorted runs (see `series`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probe import COUNTER_MOD
from . import series as S

MAX_SLOPE_ERR = 0.2
MAX_OFFSET_ERR = 0.2
ALIAS_THRESHOLD = 100.0


def _points(samples: DataFrame) -> DataFrame:
    return samples.groupBy("ip", "t").agg(F.max("id").alias("id"))


def unwrapped(samples: DataFrame) -> DataFrame:
    """Adds the previous sample (pt, pid) and ``ts``: the id as a counter that never wraps."""
    runs = S.in_runs(_points(samples), ["ip"], ["t"])
    d = S.lag_over(runs, ["ip"], ["t"], {"t": "pt", "id": "pid"})
    d = d.withColumn("wrap", F.coalesce((F.col("id") < F.col("pid")).cast("bigint"), F.lit(0)))
    d = S.running_sum(d, ["ip"], ["t"], "wrap", "wraps")
    return d.select("ip", "t", "id", "pt", "pid", (F.col("id") + COUNTER_MOD * F.col("wraps")).alias("ts"))


def ipid_rate(points: DataFrame) -> DataFrame:
    """Guess of the counter rate per address from `unwrapped` points: mean of the rising steps' slopes, the time to
    wrap, and whether the address is usable (a rising step, and no two samples further apart than a wrap)."""
    step = (F.col("id") - F.col("pid")) / (F.col("t") - F.col("pt"))
    rising = F.col("id") > F.col("pid")
    g = points.groupBy("ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rising).alias("n_rising"), F.avg(F.when(rising, step)).alias("guess_slope"),
        F.max(F.col("t") - F.col("pt")).alias("longest"))
    wrap = COUNTER_MOD / F.col("guess_slope")
    return g.withColumn("wrap_time", wrap).withColumn(
        "usable", F.coalesce((F.col("n_rising") > 0) & (F.col("longest") <= F.col("wrap_time")), F.lit(False)))


def ipid_line_fit(samples: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(ip, offset, slope, offset_err, slope_err, n, ok): least squares over the unwrapped counter.

    ``points`` are the `unwrapped` samples, if they are at hand.

    The errors come from residuals of the wrapped ids without wrapping the residual; that is part of the definition.
    ``ok`` is false for too few points, an unusable rate, or errors above a fifth of slope or offset.
    """
    p = unwrapped(samples) if points is None else points
    fit = p.groupBy("ip").agg(
        F.regr_slope("ts", "t").alias("slope"), F.regr_intercept("ts", "t").alias("offset"),
        F.regr_sxx("ts", "t").alias("sxx"), F.sum(F.col("t") * F.col("t")).alias("st2"), F.count(F.lit(1)).alias("n"))
    usable = ipid_rate(p).select("ip", "usable")
    err = F.col("id") - F.pmod(F.col("offset") + F.col("t") * F.col("slope"), F.lit(float(COUNTER_MOD)))
    ss = p.join(fit, "ip").groupBy("ip").agg(F.sum(err * err).alias("ss"))
    f = fit.join(ss, "ip").join(usable, "ip").where("n > 2")
    var = F.col("ss") / (F.col("n") - 2)
    f = f.withColumn("slope_err", F.sqrt(var / F.col("sxx"))).withColumn(
        "offset_err", F.sqrt(var * F.col("st2") / (F.col("n") * F.col("sxx"))))
    ok = F.col("usable") & (F.try_divide("slope_err", "slope") <= MAX_SLOPE_ERR) & (F.try_divide("offset_err", "offset") <= MAX_OFFSET_ERR)
    return f.select("ip", "offset", "slope", "offset_err", "slope_err", "n", F.coalesce(ok, F.lit(False)).alias("ok"))


def slope_distribution(fits: DataFrame) -> DataFrame:
    """Fits by the width of the slope's 95 % confidence interval."""
    ci = 1.96 * F.col("slope_err") / F.sqrt("n")
    return fits.select("ip", "slope", "slope_err", "n", ci.alias("ci95")).orderBy("ci95", "ip")


def fit_residuals(samples: DataFrame, slopes: DataFrame) -> DataFrame:
    """Mean squared difference of observed and predicted ids per address."""
    est = F.pmod(F.col("slope") * F.col("t") + F.col("offset"), F.lit(float(COUNTER_MOD)))
    return samples.join(slopes.select("ip", "slope", "offset"), "ip").groupBy("ip", "slope").agg(
        F.avg(F.pow(F.col("id") - est, 2)).alias("mse"))


def _offset_id(c="offset"):
    whole = F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")
    return F.pmod(whole, F.lit(COUNTER_MOD))


def velocity_candidates(fits: DataFrame, slope_tol: float = 0.05, offset_tol: int = 100) -> DataFrame:
    """Pairs whose slopes agree within ``slope_tol`` (of the larger) and offsets within ``offset_tol``.

    Fits with a slope error above a tenth of the slope are left out. Close slopes have close logarithms, so pairs meet
    by (sign, log-slope cell, offset cell) and its neighbours instead of all with all. ``err`` is the distance in the
    (slope, offset) plane.
    """
    import math

    width = -math.log(1 - slope_tol) * 1.0001
    d = fits.where((F.abs("slope_err") <= 0.1 * F.abs(F.col("slope"))) & (F.col("slope") != 0)).select(
        "ip", "slope", _offset_id().alias("off"), F.signum("slope").alias("sg"),
        F.floor(F.log(F.abs("slope")) / width).alias("cs"))
    d = d.withColumn("co", F.floor(F.col("off") / offset_tol))
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    one = d.select(F.col("ip").alias("ip1"), F.col("slope").alias("s1"), F.col("off").alias("o1"), "sg", near("cs"), "co").select(
        "ip1", "s1", "o1", "sg", "cs", near("co"))
    two = d.select(F.col("ip").alias("ip2"), F.col("slope").alias("s2"), F.col("off").alias("o2"), "sg", "cs", "co")
    ds, do = F.abs(F.col("s1") - F.col("s2")), F.abs(F.col("o1") - F.col("o2"))
    j = one.join(two, ["sg", "cs", "co"]).where(
        (F.col("ip1") < F.col("ip2")) & (ds < slope_tol * F.greatest(F.abs("s1"), F.abs("s2"))) & (do < offset_tol))
    return j.select("ip1", "ip2", F.sqrt(ds * ds + do * do).alias("err"))


def pair_velocity(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """|slope difference| and |offset difference| of listed pairs."""
    f = fits.select("ip", "slope", _offset_id().alias("off"))
    j = pairs.select("ip1", "ip2")
    for i in ("1", "2"):
        j = j.join(f.select(F.col("ip").alias(f"ip{i}"), F.col("slope").alias(f"s{i}"), F.col("off").alias(f"o{i}")), f"ip{i}")
    return j.select("ip1", "ip2", F.abs(F.col("s1") - F.col("s2")).alias("d_slope"), F.abs(F.col("o1") - F.col("o2")).alias("d_offset"))


def _pair_series(pairs: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Both series of each pair in one time order, with the other side's neighbours and range."""
    sides = []
    for me, other in (("1", "2"), ("2", "1")):
        s = pairs.select("ip1", "ip2", F.col(f"ip{me}").alias("ip")).join(points.select("ip", "t", "id", "ts"), "ip")
        sides.append(s.select("ip1", "ip2", "t", F.lit(int(me)).alias("side"), F.col("id").cast("double").alias("id"), F.col(value).cast("double").alias("v")))
    d = sides[0].unionByName(sides[1])
    k = ["ip1", "ip2"]
    rows = d.groupBy(*k, "t").agg(*[
        F.max(F.when(F.col("side") == i, F.struct("t", "id", "v"))).alias(f"p{i}") for i in (1, 2)])
    return S.nearest_known(S.in_runs(rows, k, ["t"]), k, ["t"], {f"p{i}": (f"b{i}", f"a{i}") for i in (1, 2)})


def _interpolated(i: int):
    b, a = F.col(f"b{i}"), F.col(f"a{i}")
    share = F.try_divide(F.col("t") - b["t"], a["t"] - b["t"])
    return F.pmod((a["v"] - b["v"]) * share + b["v"], F.lit(float(COUNTER_MOD)))


def velocity_distance(pairs: DataFrame, points: DataFrame, fits: DataFrame, overlap_only: bool = False) -> DataFrame:
    """(ip1, ip2, d, n): mean counter distance of two addresses over the samples of both.

    Inside the other's range a sample is compared with the value between the other's two neighbours; before it with
    the other's line, the difference wrapped; after it with the line, not wrapped; at equal times directly, counting
    twice. With ``overlap_only`` samples outside the other's range are left out and neighbours are not unwrapped; a
    pair without overlap has no row.
    """
    rows = _pair_series(pairs, points, "id" if overlap_only else "ts")
    f = fits.select("ip", "slope", "offset")
    for i in ("1", "2"):
        rows = rows.join(f.select(F.col("ip").alias(f"ip{i}"), F.col("slope").alias(f"s{i}"), F.col("offset").alias(f"o{i}")), f"ip{i}")
    both = F.col("p1").isNotNull() & F.col("p2").isNotNull()

    def dist(me, other):
        own = F.col(f"p{me}")["id"]
        line = F.pmod(F.col(f"s{other}") * F.col("t") + F.col(f"o{other}"), F.lit(float(COUNTER_MOD)))
        gap = F.abs(line - own)
        wrapped = F.least(gap, COUNTER_MOD - gap)
        before, after = F.col(f"b{other}").isNull(), F.col(f"a{other}").isNull()
        if overlap_only:
            return F.when(~before & ~after, F.abs(_interpolated(other) - own))
        return F.when(before, wrapped).when(after, gap).otherwise(F.abs(_interpolated(other) - own))

    err = (
        F.when(both, F.abs(F.col("p1")["id"] - F.col("p2")["id"]))
        .when(F.col("p1").isNotNull(), dist(1, 2)).otherwise(dist(2, 1)))
    g = rows.select("ip1", "ip2", err.alias("err"), F.when(both, 2).otherwise(1).alias("w")).where("err IS NOT NULL")
    return g.groupBy("ip1", "ip2").agg((F.sum("err") / F.sum("w")).alias("d"), F.sum("w").alias("n"))


def velocity_distance_overlap(pairs: DataFrame, points: DataFrame, fits: DataFrame) -> DataFrame:
    return velocity_distance(pairs, points, fits, True)


def resolve_velocity_aliases(pairs: DataFrame, samples: DataFrame, threshold: float = ALIAS_THRESHOLD) -> DataFrame:
    """Verdict per listed pair from TCP and port-unreachable samples (`kind`): ALIAS! under the threshold."""
    if "kind" in samples.columns:
        samples = samples.where(F.col("kind").rlike("Icmp_t=3_c=3|Tcp"))
    pts = unwrapped(samples)
    fits = ipid_line_fit(samples, pts).where("ok")
    d = velocity_distance(pairs, pts, fits)
    return d.withColumn("verdict", F.when(F.col("d") < threshold, "ALIAS!").otherwise("NOT_ALIAS."))
