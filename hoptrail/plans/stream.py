"""Registered queries: live operators. Streams read a table's files to the end; twins state the same rows in batch."""

from pyspark.sql import functions as F

from ..operators import delay as D
from ..sources.text import read_trace_log
from ..streaming import live as V
from . import sources as Q
from . import tables as T
from .delay import _E
from .registry import query
from .sinks import scratch
from .tables import SQL

L = F.lit


def _stream(spark, sf, name):
    d = spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/{name}*.parquet")
    for f in d.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            d = d.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return d


def _in_batches(spark, sf, name, batches=4, files=4):
    """A table's rows as a stream of several micro-batches in the order of event time, one quantile of ``ts`` each, and a last
    one that moves the watermark beyond all of them: a row of user -1 a month later."""
    d = T.table(spark, sf, name)
    cuts = d.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [k / batches for k in range(1, batches)], 0.01)
    path = f"{scratch(spark)}/{name}"
    part = sum((F.when(F.unix_micros("ts") > c, 1).otherwise(0) for c in cuts), L(0))
    for k in range(batches):
        d.where(part == k).repartition(files).write.mode("append").parquet(path)
    end = {"ts": F.max("ts") + F.expr("INTERVAL 30 DAYS"), "event_type": L("end")}
    d.agg(*[end.get(f.name, L(0 if f.name == "value" else -1)).cast(f.dataType).alias(f.name) for f in d.schema]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(spark, stream, mode="append"):
    base = scratch(spark)
    return V.run_to_table(stream, f"{base}/data", f"{base}/state", mode)


@query("stream_trace_log", Q._LOG)
def _(spark, sf):
    lns = Q.trace_lines(_stream(spark, sf, "lineitem"))
    return _run(spark, Q._flat(read_trace_log(lns)))


@query("stream_rtt_ewma", _E.format(w="", first="false") + " SELECT * FROM l")
def _(spark, sf):
    e = _in_batches(spark, sf, "events").select(F.col("user_id").alias("conn"), "ts", F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("bigint").alias("rtt"))
    out = _run(spark, V.stream_rtt_ewma(e)).where("conn >= 0")
    return out.groupBy("conn").agg(F.max_by("srtt", "n").alias("srtt"), F.max_by("mdev", "n").alias("mdev"), F.max("n").alias("n"))


@query("stream_hop_queueing", "WITH " + SQL["stamps"] + """, dl AS (SELECT conn, probe, s, CAST(i - 1 AS INTEGER) AS hop, v - coalesce(lag(v) OVER (PARTITION BY probe ORDER BY i), sms) AS delay FROM stamp UNION ALL SELECT conn, probe, s, CAST(n AS INTEGER), rms - v FROM stamp WHERE i = n)
  SELECT conn, hop, probe, delay, delay - least_ AS queueing FROM (SELECT *, min(delay) OVER (PARTITION BY conn, hop ORDER BY s, probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_ FROM dl) WHERE least_ IS NOT NULL""")
def _(spark, sf):
    stamps = T.stamps_of(_in_batches(spark, sf, "events"))
    return _run(spark, V.stream_hop_queueing(V.stream_hop_delays(stamps))).where("conn >= 0")


def _echo(e):
    """Events as time stamps sent and echoed: the echo of a value comes on the next events of the same user."""
    base = e.select(F.col("user_id").alias("conn"), F.col("event_id").alias("value"), "ts", "event_type")
    sent = base.where("event_type <> 'error'")
    lag = F.when(F.col("value") % 5 == 0, F.expr("INTERVAL 5 hours")).otherwise(F.expr("INTERVAL 30 seconds"))
    echo = base.where("value % 7 <> 3").withColumn("ts", F.col("ts") + lag)
    return sent.select("conn", "value", "ts"), echo.select("conn", "value", "ts")


_ECHO = """WITH s AS (SELECT user_id AS conn, event_id AS value, ts AS sent_ts FROM events WHERE event_type <> 'error'), e AS (SELECT user_id AS conn, event_id AS value, ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 30 SECOND END AS ts FROM events WHERE event_id % 7 <> 3),
 j AS (SELECT conn, value, sent_ts, ts, max(value) OVER (PARTITION BY conn ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e JOIN s USING (conn, value) WHERE ts >= sent_ts)
 SELECT conn, value, epoch_us(ts) - epoch_us(sent_ts) AS rtt FROM j WHERE newest IS NULL OR value > newest"""


@query("match_echo", _ECHO)
def _(spark, sf):
    return V.match_echo(*_echo(T.table(spark, sf, "events"))).select("conn", "value", "rtt")


@query("stream_match_echo", _ECHO)
def _(spark, sf):
    s, e = _echo(_in_batches(spark, sf, "events"))
    return _run(spark, V.stream_match_echo(s, e, 6 * 3_600_000_000, "6 hours")).where("conn >= 0")


_LIMIT = 60_000_000


def _answers(e):
    """Probes and responses: some late, some doubled, some without a probe, some never answered."""
    k = F.col("event_id")
    base = e.select(F.col("user_id").alias("conn"), k.alias("probe"), "ts", "event_id")
    probes = base.where(k % 6 != 5).select("conn", "probe", "ts")
    wait = F.when(k % 4 == 0, F.expr("INTERVAL 2 minutes")).otherwise(F.expr("INTERVAL 1 second"))
    one = base.where(k % 9 != 1).select("conn", "probe", (k * 2).alias("resp_id"), (F.col("ts") + wait).alias("ts"))
    two = base.where(k % 10 == 2).select("conn", "probe", (k * 2 + 1).alias("resp_id"), (F.col("ts") + F.expr("INTERVAL 3 minutes")).alias("ts"))
    return probes, one.unionByName(two)


_ANS = """WITH p AS (SELECT user_id AS conn, event_id AS probe, ts AS sent_ts FROM events WHERE event_id % 6 <> 5), r AS (SELECT user_id AS conn, event_id AS probe, event_id * 2 AS resp_id, ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 2 MINUTE ELSE INTERVAL 1 SECOND END AS ts FROM events WHERE event_id % 9 <> 1
   UNION ALL SELECT user_id, event_id, event_id * 2 + 1, ts + INTERVAL 3 MINUTE FROM events WHERE event_id % 10 = 2),
 x AS (SELECT r.*, sent_ts, row_number() OVER (PARTITION BY conn, probe ORDER BY ts, resp_id) AS i FROM r LEFT JOIN p USING (conn, probe)),
 c AS (SELECT conn, probe, resp_id, CASE WHEN sent_ts IS NULL THEN 'UNSENT' WHEN i > 1 THEN 'DUPLICATE' WHEN epoch_us(ts) - epoch_us(sent_ts) > 60000000 THEN 'OLD' ELSE 'RECV' END AS status FROM x),
 t AS (SELECT p.conn, p.probe FROM p LEFT JOIN (SELECT conn, probe, min(ts) AS f FROM r GROUP BY 1, 2) USING (conn, probe) WHERE f IS NULL OR epoch_us(f) - epoch_us(sent_ts) > 60000000)"""


@query("classify_responses", _ANS + " SELECT * FROM c")
def _(spark, sf):
    return V.classify_responses(*_answers(T.table(spark, sf, "events")), _LIMIT).drop("ts")


@query("probe_timeouts", _ANS + " SELECT t.conn, t.probe, epoch_us(sent_ts) + 60000000 AS due FROM t JOIN p USING (conn, probe)")
def _(spark, sf):
    return V.probe_timeouts(*_answers(T.table(spark, sf, "events")), _LIMIT).withColumn("due", F.unix_micros("due"))


@query("stream_classify_responses", _ANS + " SELECT * FROM c UNION ALL SELECT conn, probe, NULL, 'TIMEOUT' FROM t")
def _(spark, sf):
    p, r = _answers(_in_batches(spark, sf, "events"))
    ev = p.select("conn", "probe", L("probe").alias("kind"), L(None).cast("bigint").alias("id"), "ts").unionByName(r.select("conn", "probe", L("response").alias("kind"), F.col("resp_id").alias("id"), "ts"))
    return _run(spark, V.stream_classify_responses(ev, _LIMIT, "5 minutes")).where("conn >= 0")


@query("idle_sessions", """WITH g AS (SELECT user_id AS conn, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  h AS (SELECT *, sum(b) OVER (PARTITION BY conn ORDER BY ts) AS s FROM g) SELECT conn, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS "end", count(*) AS n FROM h GROUP BY conn, s""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("conn"), "ts")
    return V.idle_sessions(e, 7_200_000_000).withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("stream_idle_sessions", """WITH g AS (SELECT user_id AS conn, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  h AS (SELECT *, sum(b) OVER (PARTITION BY conn ORDER BY ts) AS s FROM g), z AS (SELECT conn, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS e, count(*) AS n FROM h GROUP BY conn, s)
  SELECT conn, epoch_us(a) AS start, epoch_us(e) AS "end", n FROM z WHERE epoch_ms(e) <= (SELECT epoch_ms(max(ts) - INTERVAL 1 MINUTE) FROM events)""")
def _(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("user_id").alias("conn"), "ts")
    return _run(spark, V.stream_idle_sessions(e, "2 hours")).withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


_PEER = "(SELECT max(ts) FROM events)"


@query("peer_registry", f"""SELECT user_id AS ip, arg_max(event_id % 65536, (ts, event_id % 65536)) AS port, epoch_us(max(ts)) AS last_seen FROM events GROUP BY user_id HAVING max(ts) > {_PEER} - INTERVAL 60 MINUTE""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    seen = e.select(F.col("user_id").alias("ip"), (F.col("event_id") % 65536).alias("port"), "ts")
    return V.peer_registry(seen, e.agg(F.max("ts")).scalar()).withColumn("last_seen", F.unix_micros("last_seen"))


_STAYS = """WITH g AS (SELECT user_id AS ip, event_id % 65536 AS port, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id % 65536)),
  h AS (SELECT *, sum(b) OVER (PARTITION BY ip ORDER BY ts, port) AS s FROM g), x AS (SELECT ip, arg_max(port, (ts, port)) AS port, epoch_us(max(ts)) AS last_seen FROM h GROUP BY ip, s)"""


def _seen(e):
    return e.select(F.col("user_id").alias("ip"), (F.col("event_id") % 65536).alias("port"), "ts")


@query("peer_stays", _STAYS + " SELECT * FROM x")
def _(spark, sf):
    return V.peer_stays(_seen(T.table(spark, sf, "events")), 3_600_000_000).withColumn("last_seen", F.unix_micros("last_seen"))


@query("stream_peer_registry", _STAYS + """ SELECT ip, port, last_seen, false AS alive FROM x
  UNION ALL SELECT user_id, arg_max(event_id % 65536, (ts, event_id % 65536)), epoch_us(max(ts)), true FROM events GROUP BY user_id""")
def _(spark, sf):
    events = _in_batches(spark, sf, "events")
    gone = _run(spark, V.stream_peer_expiry(_seen(events))).withColumn("last_seen", F.unix_micros("last_seen"))
    out = _run(spark, V.stream_peer_registry(_seen(events))).where("alive")
    out = out.groupBy("ip").agg(F.max_by("port", "last_seen").alias("port"), F.max("last_seen").alias("last_seen"))
    return gone.withColumn("alive", L(False)).unionByName(out.withColumn("alive", L(True))).where("ip >= 0")
