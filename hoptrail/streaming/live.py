"""Live state over streams: matching, classification, smoothing, sessions, registries.

Each operator with order-dependent state has a batch twin that gives the same rows over a finished table. Matching runs
in stream-stream joins on event time; what depends on the order of rows waits until the watermark has passed it, so the
order of files does not matter. All state leaves with event time. Rows behind the watermark are dropped by Spark: the
watermark has to cover the disorder of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import series as S
from ..operators.delay import hop_delay, smooth
from ..sources.text import read_trace_log


def stream_trace_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Newly written log files as (file, pos, value)."""
    d = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("pos"), "value")


def stream_trace_log(spark: SparkSession, path: str, dataset: str = "") -> DataFrame:
    return read_trace_log(stream_trace_lines(spark, path), dataset)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet, and gives the result back as a table."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out)
    else:
        def store(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n:010d}")
        q = stream.writeStream.foreachBatch(store)
    q = q.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.parquet(f"{out}/*")


# -- order of event time ---------------------------------------------------------------------------------------------

Fold = Callable[[list[int] | None, np.ndarray, np.ndarray], tuple[list[int], dict[str, list]]]
SHARDS = 1024   # keys share a state row: the handling of a state row costs milliseconds, the fold of a key microseconds


def in_event_order(rows: DataFrame, keys: dict[str, str], out: dict[str, str], fold: Fold, watermark: str | None,
                   idle_ms: int) -> DataFrame:
    """Folds the rows of each key in the order of (ts, tie): `rows(*keys, ts, tie bigint, amount bigint)`, integer keys.

    Rows wait in state until the watermark has passed them, so they may arrive in any order within it. ``fold`` takes the
    carried numbers (null at first, equally many for all keys), the ties and amounts of the rows that are due, and gives
    the numbers to carry on and the columns ``out``. A key without a row for ``idle_ms`` of event time leaves the state and
    starts anew after that. Without ``watermark`` the one that ``ts`` has holds. Keys are hashed to ``SHARDS`` state rows,
    each with the rows that wait and one line (null bits, keys, last, carried numbers) per key.
    """
    names = ["_null", *keys]
    w = len(names)

    def step(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, lines, waiting = state.get if state.exists else (0, b"", b"")
        known = {tuple(x[:w]): x[w:] for x in np.frombuffer(lines, np.int64).reshape(n, -1).tolist()} if n else {}
        parts = [np.frombuffer(waiting, np.int64).reshape(-1, w + 3)]
        if not state.hasTimedOut:
            parts += [np.column_stack([pdf[c].to_numpy(np.int64) for c in (*names, "at", "tie", "amount")]) for pdf in chunks]
        d = np.concatenate(parts)
        now = state.getCurrentWatermarkMs()
        is_due = d[:, w] < now * 1000
        later, d = d[~is_due], d[is_due]
        d = d[np.lexsort((d[:, w + 1], d[:, w], *d[:, :w].T))]
        starts = np.flatnonzero(np.r_[True, (d[1:, :w] != d[:-1, :w]).any(axis=1)]) if len(d) else []
        folded, times, columns = [], [], {c: [] for c in out}
        for a, b in zip(starts, [*starts[1:], len(d)]):
            key = tuple(d[a, :w].tolist())
            last, *carry = known.get(key, (None,))
            at, tie, amount = d[a:b, w:].T
            # an idle gap among the rows that are due starts the key anew
            gaps = np.flatnonzero(np.diff(at, prepend=at[0] if last is None else last * 1000) > idle_ms * 1000).tolist()
            for lo, hi in zip([0, *gaps], [*gaps, b - a]):
                if hi > lo:
                    carry, new = fold(None if last is None or lo in gaps else carry, tie[lo:hi], amount[lo:hi])
                    last = int(at[hi - 1]) // 1000
                    folded.append(key)
                    times.append(len(next(iter(new.values()))))
                    for c in out:
                        columns[c] += new[c]
            known[key] = [last, *carry]
        still = set(map(tuple, later[:, :w].tolist()))
        known = {k: x for k, x in known.items() if now <= x[0] + idle_ms or k in still}
        if known or len(later):
            lines = np.array([[*k, *x] for k, x in known.items()], np.int64).tobytes()
            state.update((len(known), lines, later.tobytes()))
            wake = [x[0] + idle_ms for k, x in known.items() if k not in still] + [int(t) // 1000 for t in later[:, w].min(keepdims=True, initial=2**62)]
            state.setTimeoutTimestamp(max(min(wake), now) + 1)
        elif state.exists:
            state.remove()
        if sum(times):
            of = np.repeat(np.array(folded, np.int64), times, axis=0)
            key_columns = {k: pd.arrays.IntegerArray(of[:, i + 1].copy(), (of[:, 0] >> i & 1).astype(bool)) for i, k in enumerate(keys)}
            yield pd.DataFrame({**key_columns, **columns})

    ddl = ", ".join(f"{k} {t}" for k, t in {**keys, **out}.items())
    nulls = sum((F.col(k).isNull().cast("bigint") * (1 << i) for i, k in enumerate(keys)), F.lit(0).cast("bigint"))
    given = (rows.withWatermark("ts", watermark) if watermark else rows).select(
        F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).alias("_shard"), nulls.alias("_null"), *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in keys],
        "ts", F.unix_micros("ts").alias("at"), "tie", "amount")
    return given.groupBy("_shard").applyInPandasWithState(
        step, ddl, "n bigint, lines binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


# -- smoothing -------------------------------------------------------------------------------------------------------

DAY_MS = 86_400_000


def stream_rtt_ewma(samples: DataFrame, start: str = "zero", watermark: str = "1 minute", idle_ms: int = 365 * DAY_MS) -> DataFrame:
    """`samples(conn bigint, ts, seq bigint, rtt bigint)` -> the estimate of a connection and its number of samples, whenever
    the watermark has passed samples of it."""
    def fold(carry, tie, amount):
        rtt, mdev, n = carry or (0, 0, 0)
        for x in amount.tolist():
            rtt, mdev = smooth(rtt, mdev, x, start)
        n += len(amount)
        return [rtt, mdev, n], {"srtt": [rtt], "mdev": [mdev], "n": [n]}

    rows = samples.select("conn", "ts", F.col("seq").alias("tie"), F.col("rtt").alias("amount"))
    return in_event_order(rows, {"conn": "bigint"}, {"srtt": "bigint", "mdev": "bigint", "n": "bigint"}, fold, watermark, idle_ms)


def stream_hop_queueing(delays: DataFrame, watermark: str = "1 minute", idle_ms: int = 365 * DAY_MS) -> DataFrame:
    """`delays(conn bigint, probe, t, hop, delay)` -> delay minus the hop's smallest delay before it."""
    def fold(carry, tie, amount):
        least = np.minimum.accumulate(amount)
        if carry:
            least = np.minimum(least, carry[0])
            before, at = np.r_[carry[0], least[:-1]], 0
        else:
            before, at = np.r_[0, least[:-1]], 1
        return [int(least[-1])], {"probe": tie[at:].tolist(), "delay": amount[at:].tolist(), "queueing": (amount - before)[at:].tolist()}

    rows = delays.select("conn", "hop", F.col("t").alias("ts"), F.col("probe").alias("tie"), F.col("delay").alias("amount"))
    return in_event_order(rows, {"conn": "bigint", "hop": "int"}, {"probe": "bigint", "delay": "bigint", "queueing": "bigint"}, fold,
                          watermark, idle_ms)


def stream_hop_delays(stamps: DataFrame) -> DataFrame:
    return hop_delay(stamps)


# -- echoes ----------------------------------------------------------------------------------------------------------

def match_echo(sent: DataFrame, echoes: DataFrame) -> DataFrame:
    """Each echoed value with its send time, once: an echo not above the newest matched before it is ignored.

    `sent(conn, value, ts)`, `echoes(conn, value, ts)`. Values grow as they are sent, so matched values only grow and
    the running maximum of earlier candidates decides.
    """
    s = sent.groupBy("conn", "value").agg(F.min("ts").alias("sent_ts"))
    e = echoes.groupBy("conn", "value").agg(F.min("ts").alias("ts"))
    j = e.join(s, ["conn", "value"]).where("ts >= sent_ts").withColumn("neg", -F.col("value"))
    runs = S.in_runs(j, ["conn"], ["ts", "value"])
    d = S.running_min(runs, ["conn"], ["ts", "value"], "neg", "newest", inclusive=False)
    d = d.where("newest IS NULL OR value > -newest")
    return d.select("conn", "value", "sent_ts", "ts", (F.unix_micros("ts") - F.unix_micros("sent_ts")).alias("rtt"))


def _seconds(micros: int):
    return F.expr(f"INTERVAL '{micros // 1_000_000}.{micros % 1_000_000:06d}' SECOND")


def stream_match_echo(sent: DataFrame, echoes: DataFrame, within_us: int, watermark: str = "1 minute", idle_ms: int = 365 * DAY_MS) -> DataFrame:
    """`sent(conn bigint, value bigint, ts)`, `echoes(conn bigint, value bigint, ts)` -> (conn, value, rtt) as ``match_echo``.

    An echo meets its send in an interval join: sends wait ``within_us`` of event time for their echo. Of repeated sends
    or echoes of a value the first that arrives counts, for as long as the watermark reaches back. Matched values then
    pass the connection's newest one in the order of their echoes.
    """
    k = ["conn", "value"]
    s = sent.select(F.col("conn").alias("_conn"), F.col("value").alias("_value"), F.col("ts").alias("sent_ts")).withWatermark(
        "sent_ts", watermark).dropDuplicatesWithinWatermark(["_conn", "_value"])
    e = echoes.select(*k, "ts").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(k)
    met = e.join(s, (F.col("conn") == F.col("_conn")) & (F.col("value") == F.col("_value")) & (F.col("ts") >= F.col("sent_ts"))
                 & (F.col("ts") <= F.col("sent_ts") + _seconds(within_us)))

    def fold(carry, tie, amount):
        newest = np.maximum.accumulate(np.r_[carry or [np.iinfo(np.int64).min], tie])
        new = tie > newest[:-1]
        return [int(newest[-1])], {"value": tie[new].tolist(), "rtt": amount[new].tolist()}

    rtt = F.unix_micros("ts") - F.unix_micros("sent_ts")
    rows = met.select("conn", "ts", F.col("value").alias("tie"), rtt.alias("amount"))
    return in_event_order(rows, {"conn": "bigint"}, {"value": "bigint", "rtt": "bigint"}, fold, None, idle_ms)


# -- probes and responses --------------------------------------------------------------------------------------------

def classify_responses(probes: DataFrame, responses: DataFrame, timeout_us: int) -> DataFrame:
    """Status of each response: RECV for the first in time, OLD for a first one after the timeout, DUPLICATE for
    later ones, UNSENT without a probe. `probes(conn, probe, ts)`, `responses(conn, probe, resp_id, ts)`."""
    k = ["conn", "probe"]
    p = probes.groupBy(*k).agg(F.min("ts").alias("sent_ts"))
    first = responses.groupBy(*k).agg(F.min(F.struct("ts", "resp_id")).alias("f"))
    j = responses.join(p, k, "left").join(first, k)
    late = F.unix_micros("ts") - F.unix_micros("sent_ts") > timeout_us
    status = (
        F.when(F.col("sent_ts").isNull(), "UNSENT").when(F.struct("ts", "resp_id") != F.col("f"), "DUPLICATE")
        .when(late, "OLD").otherwise("RECV"))
    return j.select(*k, "resp_id", "ts", status.alias("status"))


def probe_timeouts(probes: DataFrame, responses: DataFrame, timeout_us: int) -> DataFrame:
    """Probes without a response before their timeout, with the time it ran out."""
    k = ["conn", "probe"]
    first = responses.groupBy(*k).agg(F.min("ts").alias("first_ts"))
    j = probes.join(first, k, "left")
    due = F.unix_micros("ts") + timeout_us
    return j.where(F.col("first_ts").isNull() | (F.unix_micros("first_ts") > due)).select(*k, F.timestamp_micros(due).alias("due"))


def stream_classify_responses(events: DataFrame, timeout_us: int, watermark: str = "1 minute", keep_us: int = 600_000_000) -> DataFrame:
    """`events(conn bigint, probe bigint, kind probe|response, id bigint, ts timestamp)` -> a status per response (conn, probe,
    resp_id, status) as ``classify_responses``, and a TIMEOUT row for a probe whose time ran out.

    Probes and responses meet in outer interval joins: a probe waits for ``timeout_us`` and ``keep_us`` after it, so that late
    answers are OLD; an answer without a probe in that time before it is UNSENT. The answers to one probe are gathered in a
    second state and leave it, in their order of time, when no further one can come: at the end of the probe's wait. Of
    repeated probes the first that arrives counts, for as long as the watermark reaches back. Nothing here runs in Python.
    """
    p = events.where("kind = 'probe'").select(
        F.col("conn").alias("_conn"), F.col("probe").alias("_probe"), F.col("ts").alias("sent_ts")).withWatermark("sent_ts", watermark)
    r = events.where("kind = 'response'").select("conn", "probe", F.col("id").alias("resp_id"), "ts").withWatermark("ts", watermark)
    meets = ((F.col("conn") == F.col("_conn")) & (F.col("probe") == F.col("_probe")) & (F.col("ts") >= F.col("sent_ts"))
             & (F.col("ts") <= F.col("sent_ts") + _seconds(timeout_us + keep_us)))
    unsent = r.join(p, meets, "leftOuter").where("sent_ts IS NULL").select("conn", "probe", "resp_id", F.lit("UNSENT").alias("status"))
    answer = F.when(F.col("ts").isNotNull(), F.struct("ts", "resp_id"))
    known = p.dropDuplicatesWithinWatermark(["_conn", "_probe"]).join(r, meets, "leftOuter").groupBy(F.col("_conn").alias("conn"), F.col("_probe").alias("probe"), "sent_ts").agg(
        F.array_sort(F.collect_list(answer)).alias("answers"))
    late = lambda a: F.unix_micros(a["ts"]) - F.unix_micros("sent_ts") > timeout_us
    status = lambda a, i: F.struct(a["resp_id"].alias("resp_id"), F.when(i > 0, "DUPLICATE").when(late(a), "OLD").otherwise("RECV").alias("status"))
    expired = (F.size("answers") == 0) | late(F.get("answers", F.lit(0)))
    none = F.array().cast("array<struct<resp_id:bigint,status:string>>")
    rows = F.concat(F.transform("answers", status), F.when(expired, F.array(F.struct(
        F.lit(None).cast("bigint").alias("resp_id"), F.lit("TIMEOUT").alias("status")))).otherwise(none))
    return known.select("conn", "probe", F.inline(rows)).unionByName(unsent)


# -- sessions and peers ----------------------------------------------------------------------------------------------

def idle_sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """(conn, start, end, n): activity of a connection between idle gaps, over a finished table.

    Gaps are found along sorted runs, so a connection with very many events is not sessionized by one task.
    """
    runs = S.in_runs(events.select("conn", "ts"), ["conn"], ["ts"])
    d = S.lag_over(runs, ["conn"], ["ts"], {"ts": "before"})
    opens = F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") >= gap_us)
    d = S.running_sum(d.withColumn("opens", opens.cast("bigint")), ["conn"], ["ts"], "opens", "session")
    g = d.groupBy("conn", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("conn", "start", F.timestamp_micros(F.unix_micros("last") + gap_us).alias("end"), "n")


def stream_idle_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 minute") -> DataFrame:
    """The same over a stream: a session comes out once the watermark has passed its end."""
    return events.withWatermark("ts", watermark).groupBy("conn", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "conn", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def peer_registry(seen: DataFrame, now, stale: str = "60 minutes") -> DataFrame:
    """Latest port and time per peer seen within ``stale`` before ``now``. `seen(ip, port, ts)`."""
    g = seen.groupBy("ip").agg(F.max(F.struct("ts", "port")).alias("m"))
    return g.select("ip", F.col("m.port").alias("port"), F.col("m.ts").alias("last_seen")).where(
        F.col("last_seen") > now - F.expr(f"INTERVAL {stale}"))


def peer_stays(seen: DataFrame, stale_us: int) -> DataFrame:
    """Stays of peers over a finished table: ip, port and last_seen of the last sight before each gap of ``stale_us``."""
    runs = S.in_runs(seen.select("ip", "port", "ts"), ["ip"], ["ts", "port"])
    d = S.lag_over(runs, ["ip"], ["ts", "port"], {"ts": "before"})
    opens = F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") >= stale_us)
    d = S.running_sum(d.withColumn("opens", opens.cast("bigint")), ["ip"], ["ts", "port"], "opens", "stay")
    g = d.groupBy("ip", "stay").agg(F.max(F.struct("ts", "port")).alias("m"))
    return g.select("ip", F.col("m.port").alias("port"), F.col("m.ts").alias("last_seen"))


def stream_peer_expiry(seen: DataFrame, stale: str = "60 minutes", watermark: str = "1 minute") -> DataFrame:
    """The same over a stream: a peer's row (ip, port, last_seen) comes out when the watermark passes ``stale`` after its last
    sight, and its state leaves with it."""
    g = seen.withWatermark("ts", watermark).groupBy("ip", F.session_window("ts", stale).alias("w"))
    return g.agg(F.max(F.struct("ts", "port")).alias("m")).select("ip", F.col("m.port").alias("port"), F.col("m.ts").alias("last_seen"))


def stream_peer_registry(seen: DataFrame, stale_ms: int = 3_600_000, watermark: str = "1 minute") -> DataFrame:
    """Upserts (ip, port, last_seen, alive) of peers a micro-batch touched; a peer not seen for ``stale_ms`` of event
    time gets a row with alive false and leaves the state."""
    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            port, last = state.get
            state.remove()
            alive = False
        else:
            port, last = state.get if state.exists else (None, -1)
            for pdf in chunks:
                r = pdf.sort_values(["ts", "port"]).iloc[-1]
                t = int(r["ts"].value // 1000)
                if t >= last:
                    port, last = int(r["port"]), t
            state.update((port, last))
            state.setTimeoutTimestamp(max(last // 1000 + stale_ms, state.getCurrentWatermarkMs() + 1))
            alive = True
        yield pd.DataFrame({"ip": [key[0]], "port": [port], "last_seen": [last], "alive": [alive]})

    return seen.withWatermark("ts", watermark).groupBy("ip").applyInPandasWithState(
        step, "ip bigint, port bigint, last_seen bigint, alive boolean", "port bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
