"""Registered queries: round trips and hop delays."""

from pyspark.sql import functions as F

from ..operators import delay as D
from . import tables as T
from .registry import query
from .tables import SQL

# fold of the integer estimator as a recursion over sample numbers; start rule in {first}
_E = "WITH RECURSIVE " + SQL["rtt"] + """, q AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY ts, seq) AS i FROM rtts {w}),
 f AS (SELECT conn, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS m FROM (SELECT DISTINCT conn FROM q) UNION ALL
   SELECT q.conn, q.i, CASE WHEN {first} AND f.s = 0 THEN q.rtt ELSE f.s + ((q.rtt - f.s) >> 3) END, f.m + ((abs(q.rtt - f.s) - f.m) >> 2) FROM f JOIN q ON q.conn = f.conn AND q.i = f.i + 1),
 l AS (SELECT conn, arg_max(s, i) AS srtt, arg_max(m, i) AS mdev, max(i) AS n FROM f GROUP BY conn)"""
_ORD = ["ts", "seq"]


@query("rtt_ewma", _E.format(w="", first="false") + " SELECT * FROM l")
def _(spark, sf):
    return D.rtt_ewma(T.rtt_samples(spark, sf), _ORD)


@query("rtt_ewma_first", _E.format(w="", first="true") + " SELECT * FROM l")
def _(spark, sf):
    return D.rtt_ewma(T.rtt_samples(spark, sf), _ORD, "first")


@query("congestion_delay", _E.format(w="", first="true") + """ SELECT f.conn, q.seq, q.rtt, f.s AS srtt, min(q.rtt) OVER w AS base, f.s - min(q.rtt) OVER w AS congestion
  FROM f JOIN q ON f.conn = q.conn AND f.i = q.i WINDOW w AS (PARTITION BY f.conn ORDER BY f.i)""")
def _(spark, sf):
    return D.congestion_delay(T.rtt_samples(spark, sf), _ORD).drop("ts")


@query("rtt_summary", _E.format(w="WHERE event_type <> 'error'", first="false") + """, s AS (SELECT conn, count(*) AS sent, count(*) FILTER (event_type <> 'error') AS received, 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS loss_pct,
  min(rtt) FILTER (event_type <> 'error') AS min_rtt, coalesce(avg(rtt) FILTER (event_type <> 'error'), -1) AS avg_rtt, max(rtt) FILTER (event_type <> 'error') AS max_rtt FROM rtts GROUP BY conn)
  SELECT s.*, srtt, mdev FROM s LEFT JOIN l USING (conn)""")
def _(spark, sf):
    p = T.rtt_samples(spark, sf).withColumn("rtt", F.when(F.col("event_type") != "error", F.col("rtt")))
    return D.rtt_summary(p, _ORD)


_S = "WITH " + SQL["stamps"] + """, dl AS (SELECT conn, probe, s, CAST(i - 1 AS INTEGER) AS hop, v - coalesce(lag(v) OVER (PARTITION BY probe ORDER BY i), sms) AS delay FROM stamp UNION ALL SELECT conn, probe, s, CAST(n AS INTEGER), rms - v FROM stamp WHERE i = n)"""


@query("hop_stamps", _S + " SELECT conn, probe, CAST(i AS INTEGER) AS hop, v AS stamp FROM stamp")
def _(spark, sf):
    return D.hop_stamps(T.stamps(spark, sf))


@query("hop_stamps_address", _S + ", z AS (SELECT conn, probe, CAST((i + 1) // 2 AS INTEGER) AS hop, max(v) FILTER (i % 2 = 1) AS ip, max(v) FILTER (i % 2 = 0) AS stamp FROM stamp GROUP BY 1, 2, 3) SELECT * FROM z WHERE stamp IS NOT NULL")
def _(spark, sf):
    return D.hop_stamps(T.stamps(spark, sf), True)


@query("hop_delay", _S + " SELECT conn, probe, hop, delay FROM dl")
def _(spark, sf):
    return D.hop_delay(T.stamps(spark, sf)).drop("t")


@query("hop_queueing", _S + """ SELECT conn, hop, probe, delay, delay - least_ AS queueing FROM (SELECT *, min(delay) OVER (PARTITION BY conn, hop ORDER BY s, probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_ FROM dl) WHERE least_ IS NOT NULL""")
def _(spark, sf):
    return D.hop_queueing(T.stamps(spark, sf))


@query("clock_precision", _S + """ SELECT conn, hop, min(st) AS precision FROM (SELECT conn, CAST(i AS INTEGER) AS hop, v - lag(v) OVER (PARTITION BY conn, i ORDER BY s, probe) AS st FROM stamp) WHERE st > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return D.clock_precision(T.stamps(spark, sf))
