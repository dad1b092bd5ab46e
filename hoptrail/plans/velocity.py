"""Registered queries: counter velocity and TTL distance."""

from pyspark.sql import functions as F

from ..operators import distance as D
from ..operators import velocity as V
from . import tables as T
from .registry import query
from .tables import SQL

_U = "WITH RECURSIVE " + SQL["ipid"] + """, pt AS (SELECT ip, t, max(id) AS id FROM ipid GROUP BY 1, 2), lg AS (SELECT *, lag(t) OVER w AS pt, lag(id) OVER w AS pid FROM pt WINDOW w AS (PARTITION BY ip ORDER BY t)),
 un AS (SELECT *, id + 65536 * sum(CASE WHEN id < pid THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY t) AS ts FROM lg),
 rate AS (SELECT ip, count(*) AS n, count(*) FILTER (id > pid) AS n_rising, avg((id - pid) / (t - pt)) FILTER (id > pid) AS guess_slope, max(t - pt) AS longest FROM un GROUP BY ip),
 fit0 AS (SELECT ip, regr_slope(ts, t) AS slope, regr_intercept(ts, t) AS off, regr_sxx(ts, t) AS sxx, sum(t * t) AS st2, count(*) AS n FROM un GROUP BY ip),
 ss AS (SELECT ip, sum(e * e) AS ss FROM (SELECT un.ip, id - ((off + t * slope) - 65536.0 * floor((off + t * slope) / 65536.0)) AS e FROM un JOIN fit0 USING (ip)) GROUP BY ip),
 fit AS (SELECT ip, off AS "offset", slope, sqrt(ss / (n - 2) * st2 / (n * sxx)) AS offset_err, sqrt(ss / (n - 2) / sxx) AS slope_err, n FROM fit0 JOIN ss USING (ip) WHERE n > 2),
 okf AS (SELECT fit.*, coalesce(n_rising > 0 AND longest <= 65536 / guess_slope AND slope_err / slope <= 0.2 AND offset_err / "offset" <= 0.2, false) AS ok FROM fit JOIN rate USING (ip)),
 fx AS (SELECT *, (CAST(trunc("offset") AS BIGINT) % 65536 + 65536) % 65536 AS oi FROM fit)"""


def _r(df, *cols, d=3):
    for c in cols:
        df = df.withColumn(c, F.round(c, d))
    return df


@query("unwrapped", _U + " SELECT ip, t, id, CAST(ts AS BIGINT) AS ts FROM un")
def _(spark, sf):
    return V.unwrapped(T.ipid_samples(spark, sf)).select("ip", "t", "id", "ts")


@query("ipid_rate", _U + " SELECT ip, n, n_rising, round(guess_slope, 4) AS guess_slope, round(longest, 4) AS longest, round(65536 / guess_slope, 3) AS wrap_time, coalesce(n_rising > 0 AND longest <= 65536 / guess_slope, false) AS usable FROM rate")
def _(spark, sf):
    return _r(_r(V.ipid_rate(V.unwrapped(T.ipid_samples(spark, sf))), "guess_slope", "longest", d=4), "wrap_time")


@query("ipid_line_fit", _U + ' SELECT ip, round("offset", 2) AS "offset", round(slope, 5) AS slope, round(offset_err, 2) AS offset_err, round(slope_err, 5) AS slope_err, n, ok FROM okf')
def _(spark, sf):
    return _r(_r(V.ipid_line_fit(T.ipid_samples(spark, sf)), "offset", "offset_err", d=2), "slope", "slope_err", d=5)


@query("slope_distribution", _U + " SELECT ip, round(slope, 5) AS slope, round(slope_err, 5) AS slope_err, n, round(1.96 * slope_err / sqrt(n), 5) AS ci95 FROM fit")
def _(spark, sf):
    return _r(V.slope_distribution(V.ipid_line_fit(T.ipid_samples(spark, sf))), "slope", "slope_err", "ci95", d=5)


@query("fit_residuals", _U + """ SELECT ip, round(slope, 5) AS slope, round(avg(e * e) / 1000, 1) AS mse FROM (SELECT ipid.ip, slope, id - ((off + t * slope) - 65536.0 * floor((off + t * slope) / 65536.0)) AS e FROM ipid JOIN fit0 USING (ip) WHERE n > 2) GROUP BY 1, slope""")
def _(spark, sf):
    s = T.ipid_samples(spark, sf)
    d = V.fit_residuals(s, V.ipid_line_fit(s))
    return d.select("ip", F.round("slope", 5).alias("slope"), F.round(F.col("mse") / 1000, 1).alias("mse"))


@query("velocity_candidates", _U + """, k AS (SELECT * FROM fx WHERE abs(slope_err) <= 0.1 * abs(slope)) SELECT a.ip AS ip1, b.ip AS ip2, round(sqrt(pow(a.slope - b.slope, 2) + pow(a.oi - b.oi, 2)), 3) AS err FROM k a JOIN k b ON a.ip < b.ip
  AND abs(a.slope - b.slope) < 0.05 * greatest(abs(a.slope), abs(b.slope)) AND abs(a.oi - b.oi) < 100""")
def _(spark, sf):
    return _r(V.velocity_candidates(V.ipid_line_fit(T.ipid_samples(spark, sf))), "err")


def _pairs(spark, sf):
    """Each address with the next one."""
    ip = T.ipid_samples(spark, sf).select(F.col("ip").alias("ip1")).distinct()
    return ip.select("ip1", (F.col("ip1") + 1).alias("ip2")).join(ip.select(F.col("ip1").alias("ip2")), "ip2", "left_semi")


_P = _U + ", pr AS (SELECT DISTINCT a.ip AS ip1, a.ip + 1 AS ip2 FROM (SELECT DISTINCT ip FROM ipid) a WHERE a.ip + 1 IN (SELECT ip FROM ipid))"


@query("pair_velocity", _P + " SELECT ip1, ip2, round(abs(a.slope - b.slope), 4) AS d_slope, abs(a.oi - b.oi) AS d_offset FROM pr JOIN fx a ON a.ip = ip1 JOIN fx b ON b.ip = ip2")
def _(spark, sf):
    return _r(V.pair_velocity(_pairs(spark, sf), V.ipid_line_fit(T.ipid_samples(spark, sf))), "d_slope", d=4)


def _vd(v, extra=""):
    """Distance of pairs in SQL: every sample against the other series' neighbours."""
    return _P + f""", x AS (SELECT ip1, ip2, 1 AS me, t, id, ip2 AS o FROM pr JOIN un ON un.ip = ip1 UNION ALL SELECT ip1, ip2, 2, t, id, ip1 FROM pr JOIN un ON un.ip = ip2),
  y AS (SELECT x.*, b.t AS bt, b.{v} AS bv, b.id AS bid FROM x ASOF LEFT JOIN un b ON b.ip = x.o AND b.t <= x.t),
  z AS (SELECT y.*, a.t AS at_, a.{v} AS av FROM y ASOF LEFT JOIN un a ON a.ip = y.o AND a.t >= y.t),
  e AS (SELECT z.ip1, z.ip2, CASE WHEN bt = z.t THEN abs(z.id - bid) / 2.0 WHEN bt IS NULL OR at_ IS NULL THEN NULL
     ELSE abs(((av - bv) * ((z.t - bt) / (at_ - bt)) + bv) - 65536.0 * floor(((av - bv) * ((z.t - bt) / (at_ - bt)) + bv) / 65536.0) - z.id) END AS mid,
     bt IS NULL AS bf, at_ IS NULL AS af, abs((f.slope * z.t + f."offset") - 65536.0 * floor((f.slope * z.t + f."offset") / 65536.0) - z.id) AS ln FROM z JOIN fit f ON f.ip = z.o),
  r AS (SELECT ip1, ip2, avg(d) AS d, count(*) AS n FROM (SELECT ip1, ip2, {"mid" if v == "id" else "CASE WHEN bf THEN least(ln, 65536 - ln) WHEN af THEN ln ELSE mid END"} AS d FROM e) WHERE d IS NOT NULL GROUP BY 1, 2){extra}"""


@query("velocity_distance", _vd("ts") + " SELECT ip1, ip2, round(d, 2) AS d, n FROM r")
def _(spark, sf):
    s = T.ipid_samples(spark, sf)
    pts = V.unwrapped(s)
    return _r(V.velocity_distance(_pairs(spark, sf), pts, V.ipid_line_fit(s, pts)), "d", d=2)


@query("velocity_distance_overlap", _vd("id") + " SELECT ip1, ip2, round(d, 2) AS d, n FROM r")
def _(spark, sf):
    s = T.ipid_samples(spark, sf)
    pts = V.unwrapped(s)
    return _r(V.velocity_distance_overlap(_pairs(spark, sf), pts, V.ipid_line_fit(s, pts)), "d", d=2)


_STEADY = "(100 + CAST(floor(2000 + (epoch_us(ts) - 1704067200000000) / 1e6 * (0.01 + 0.01 * ((user_id % 9) // 2))) AS BIGINT)) % 65536 AS id"


@query("resolve_velocity_aliases", (_vd("ts") + " SELECT ip1, ip2, round(d, 1) AS d, r.n, CASE WHEN d < 100 THEN 'ALIAS!' ELSE 'NOT_ALIAS.' END AS verdict FROM r JOIN okf a ON a.ip = ip1 AND a.ok JOIN okf b ON b.ip = ip2 AND b.ok").replace("(event_id * 40) % 65536 AS id", _STEADY))
def _(spark, sf):
    k = F.col("ip") - T.ROUTER_BASE
    steady = F.floor(2000 + F.col("t") * (0.01 + 0.01 * F.floor(k % 9 / 2)))
    s = T.ipid_samples(spark, sf).withColumn("id", F.pmod(100 + steady, F.lit(65536))).withColumn("kind", F.lit("Tcp"))
    return _r(V.resolve_velocity_aliases(_pairs(spark, sf), s), "d", d=1)


_T = "WITH " + SQL["ttl"] + """, lv AS (SELECT vantage, ip, arg_max(CASE WHEN udp > 0 AND udpr = '-' THEN udp WHEN icmp > 0 AND icmpr = '-' THEN icmp WHEN tcp > 0 AND tcpr = '-' THEN tcp ELSE -1 END, (ts, trace, part)) AS d0 FROM ttld
   WHERE (udp >= 0 AND udpr = '-') OR (tcp >= 0 AND tcpr = '-') OR (icmp >= 0 AND icmpr = '-') GROUP BY 1, 2),
 co AS (SELECT vantage, ip, CASE WHEN d1 > 64 THEN d1 - 64 ELSE d1 END AS d FROM (SELECT *, CASE WHEN d0 > 192 THEN d0 - 192 ELSE d0 END AS d1 FROM lv)),
 ds AS (SELECT a.ip AS ip1, b.ip AS ip2, avg(abs(a.d - b.d)) AS d, count(*) AS n FROM co a JOIN co b ON a.vantage = b.vantage AND a.ip < b.ip GROUP BY 1, 2)"""


def _coords(spark, sf):
    return D.latest_valid_ttl(T.ttl_distance(spark, sf), ("ts", "trace", "part"))


@query("latest_valid_ttl", _T + " SELECT * FROM co")
def _(spark, sf):
    return _coords(spark, sf)


_LI = ", li AS (SELECT DISTINCT least(l_suppkey, l_suppkey + 1 + l_partkey % 3) + 167772160 AS ip1, l_suppkey + 1 + l_partkey % 3 + 167772160 AS ip2 FROM lineitem)"


@query("ip_distance", _T + _LI + " SELECT li.ip1, li.ip2, coalesce(d, -1) AS d, coalesce(n, 0) AS n FROM li LEFT JOIN ds ON li.ip1 = ds.ip1 AND li.ip2 = ds.ip2")
def _(spark, sf):
    return D.ip_distance(T.graph_links(spark, sf), _coords(spark, sf))


@query("link_ip_distance", _T + _LI + " SELECT li.ip1, li.ip2, d, n FROM li JOIN ds ON li.ip1 = ds.ip1 AND li.ip2 = ds.ip2 WHERE n >= 10")
def _(spark, sf):
    return D.link_ip_distance(T.graph_links(spark, sf), _coords(spark, sf), 10)


@query("pairs_within_distance", _T + " SELECT * FROM ds WHERE d <= 14")
def _(spark, sf):
    return D.pairs_within_distance(_coords(spark, sf), 14)


_DRAW = "CAST('0x' || substr(sha256(CAST(id AS VARCHAR) || ':0:{}'), 1, 15) AS BIGINT) % n"
_RANDOM = f""", rk AS (SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ip FROM co)),
 dr AS (SELECT id, n, {_DRAW.format(1)} AS i1, {_DRAW.format(2)} AS i2 FROM range(200) t(id), (SELECT max(n) AS n FROM rk)),
 pr AS (SELECT DISTINCT a.ip AS ip1, b.ip AS ip2 FROM dr JOIN rk a ON a.r = i1 JOIN rk b ON b.r = CASE WHEN i1 = i2 THEN (i2 + 1) % dr.n ELSE i2 END)
 SELECT threshold, pr.ip1, pr.ip2, coalesce(d, -1) AS d, coalesce(ds.n, 0) AS n FROM pr LEFT JOIN ds ON ds.ip1 = least(pr.ip1, pr.ip2) AND ds.ip2 = greatest(pr.ip1, pr.ip2),
 range(0, 6) x(threshold) WHERE coalesce(ds.n, 0) >= threshold"""


@query("random_pair_distance", _T + _RANDOM)
def _(spark, sf):
    return D.random_pair_distance(_coords(spark, sf), 200, 5)
