"""Column functions over probes, counters, clocks and link types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import _c

# Link type codes, a smaller code is better evidence.
LINK_TYPES = {"RR": 1, "STR": 2, "TR": 3, "UNKNOWN": 4, "HIDDEN": 5}
RR, STR, TR, UNKNOWN, HIDDEN = 1, 2, 3, 4, 5

# Filter words of a blacklist and their bits.
FILTER_BITS = {"ip": 7, "tcp": 1, "udp": 2, "icmp": 4}

# Reply codes for a distance probe without a usable answer.
TIMED_OUT, FILTERED, NOT_SENT = -1, -2, -3

RR_SLOTS = 9          # a record-route option holds at most nine addresses
COUNTER_MOD = 65536   # 16-bit identification counter


def link_type_code(name) -> Column:
    name = F.upper(_c(name))
    out = F.when(name.rlike(r"^\d+$"), name.cast("int"))
    for k, v in LINK_TYPES.items():
        out = out.when(name == k, v)
    return out.cast("int")


def link_type_name(code) -> Column:
    code, out = _c(code), None
    for k, v in LINK_TYPES.items():
        out = F.when(code == v, k) if out is None else out.when(code == v, k)
    return out


def better_link(a, b) -> Column:
    return _c(a) < _c(b)


def responder_class(resp, dst, time_exceeded, direct_reply) -> Column:
    return (
        F.when(_c(direct_reply), "ENDHOST")
        .when((_c(resp) == _c(dst)) & _c(time_exceeded), "NAT")
        .when(_c(resp) == _c(dst), "FIREWALL?")
        .otherwise("ROUTER")
    )


def probe_status(state) -> Column:
    s = _c(state)
    return (
        F.when(s == "SENT", "RECV").when(s == "UNSENT", "UNSENT").when(s == "TIMEDOUT", "OLD")
        .when(s == "RECEIVED", "DUPLICATE")
    )


def parse_mpls(line):
    """First label-stack entry on a response line as a struct; null if the line has none."""
    line = _c(line)
    pick = lambda k: F.regexp_extract(line, rf"MPLS[^ ]*?,{k}=(\d+)", 1).cast("int")
    return F.when(
        line.contains("MPLS"),
        F.struct(pick("l").alias("label"), pick("CoS").alias("cos"), pick("ttl").alias("ttl"), pick("S").alias("s")),
    )


def parse_probe_type(line) -> Column:
    """Probe type: last token, else a named type followed by a comma among the earlier tokens, else null."""
    line = F.rtrim(_c(line))
    last = F.regexp_extract(line, r"(Macro|Pollo|Payload|TraceRoute)\??$", 1)
    inner = F.regexp_extract(line, r"\s(Macro|Pollo|Payload|TraceRoute)\??,?(?:\s|$)", 1)
    return F.when(last != "", last).when(inner != "", inner)


def guess_hops(rttl) -> Column:
    t = _c(rttl)
    return F.when(t <= 64, 64 - t).when(t <= 128, 128 - t).otherwise(255 - t)


def normalize_ttl(ttl) -> Column:
    t = _c(ttl)
    down = F.when(t > 192, t - 192).otherwise(t)
    return F.when(down > 64, down - 64).otherwise(down)


def reply_kind(probe, answer, icmp_type=None, icmp_code=None, rst=None) -> Column:
    """Suffix for an answer that is not the one its probe asks for; empty string for the expected one."""
    p, a = _c(probe), _c(answer)
    it = _c(icmp_type) if icmp_type is not None else F.lit(None).cast("int")
    ic = _c(icmp_code) if icmp_code is not None else F.lit(None).cast("int")
    reset = F.coalesce(_c(rst) if rst is not None else F.lit(False), F.lit(False))
    expected = (
        ((p == "tcp") & (a == "tcp") & reset)
        | ((p == "udp") & (a == "icmp") & (it == 3) & (ic == 3))
        | ((p == "icmp") & (a == "icmp") & (it == 0) & (ic == 0))
    )
    name = (
        F.when((a == "tcp") & reset, ":TCP_RST").when(a == "tcp", ":TCP").when(a == "udp", ":UDP")
        .when((a == "icmp") & (it == 0), ":ICMP_ECHOREPLY")
        .when((a == "icmp") & (it == 3), F.concat(F.lit(":ICMP_U_"), ic.cast("string")))
        .when(a == "icmp", F.concat(F.lit(":ICMP_UNK_"), it.cast("string")))
        .otherwise("Unknown!")
    )
    return F.when(F.coalesce(expected, F.lit(False)), "").otherwise(name)


def split_reply(token):
    """`ttl[:KIND]` -> struct(ttl, kind); kind is `-` when the expected answer came, ttl null for a bare `-`."""
    token = _c(token)
    kind = F.split_part(token, F.lit(":"), F.lit(2))
    return F.struct(
        F.split_part(token, F.lit(":"), F.lit(1)).try_cast("int").alias("ttl"), F.when(kind != "", kind).otherwise("-").alias("kind")
    )


def rr_self_loop(rr) -> Column:
    rr = _c(rr)
    return F.size(F.array_distinct(rr)) < F.size(rr)


def swap_id_bytes(n) -> Column:
    n = _c(n)
    return F.shiftleft(n.bitwiseAND(F.lit(255)), 8) + F.shiftright(n, 8).bitwiseAND(F.lit(255))


def router_clock_ms(ts) -> Column:
    """Timestamp to milliseconds since UTC midnight; a fraction above half a millisecond rounds up."""
    micros = F.unix_micros(_c(ts))
    day = F.pmod(micros, F.lit(86_400_000_000))
    ms = F.floor(day / 1000)
    return (ms + F.when(F.pmod(day, F.lit(1000)) > 500, 1).otherwise(0)).cast("bigint")


def retransmit_timeout(rtt, mdev, n, variant: str = "double") -> Column:
    """Timeout from smoothed values; without samples 2*rtt, or rtt+2*mdev for the other variant."""
    first = 2 * _c(rtt) if variant == "double" else _c(rtt) + 2 * _c(mdev)
    return F.when(_c(n) < 1, first).otherwise(_c(rtt) + 4 * _c(mdev))


def same_path(rr_a, rr_b) -> Column:
    """The two record lists agree on their common length."""
    a, b = _c(rr_a), _c(rr_b)
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n) == F.slice(b, 1, n)


def first_disagreement(rr_a, rr_b) -> Column:
    """First entry of ``rr_a`` that differs from ``rr_b`` on the common length; null if they agree."""
    a, b = _c(rr_a), _c(rr_b)
    n = F.least(F.size(a), F.size(b))
    pairs = F.filter(
        F.arrays_zip(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y")), lambda p: p["x"] != p["y"]
    )
    return F.try_element_at(pairs, F.lit(1))["x"]
