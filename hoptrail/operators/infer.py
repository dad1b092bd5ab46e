"""Record-route behaviour of routers and the links it implies.

A router records its outgoing address after (A) or before (B) deciding to bounce a probe, or never (N). What is known
about a responder in a trace is a bit set of possible behaviours; every rule gives a constraint (an AND mask), so
rules commute and the loop ends. A set that becomes empty is a contradiction and rejects the trace. ``hidden`` marks
an A responder behind a router that did not answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..functions import probe as pf
from ..session import cut_lineage, dealt
from . import series as S
from .hops import TRACE, moved, placed

A, B, N = 1, 2, 4
ANY, A_OR_N, B_OR_N = 7, 5, 6
CONSTRAINT = [*TRACE, "resp", "mask", "hidden"]

# Type precedence and opposites; X => Y reads "X wins over Y" / "X contradicts Y".
TYPE_PRECEDENCE = {
    "HA": ["A", "B"], "A": ["DropsRR", "A-OR-N"], "B": ["DropsRR", "B-OR-N"], "N": ["A-OR-N", "B-OR-N"],
}
OPPOSITE_TYPES = {
    "HA": ["N"], "A": ["B", "B-OR-N", "N"], "B": ["A", "A-OR-N", "N"], "A-OR-N": ["B"], "B-OR-N": ["A"],
    "N": ["A", "B"],
}


def _entry(rr, i):
    return F.try_element_at(F.col(rr), F.lit(i))


def path_pairs(rr: DataFrame) -> DataFrame:
    """Record-route probes one TTL apart in a trace, with the length difference of their lists and whether the lists
    agree (`same`). `off` tells that the later responder is next to its last recorded address and not to the one
    before; `plus_b` that a +1 step makes it B rather than A behind a hidden router."""
    one, two = _neighbours(rr)
    return _described(one.join(two, [*TRACE, "ttl"]))


def _neighbours(rr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct probes twice: as the earlier of a pair, and as the later one under the earlier TTL."""
    d = placed(rr).select(*TRACE, "ttl", "resp", "rr").distinct()
    one = d.select(*TRACE, "ttl", F.col("resp").alias("resp1"), F.col("rr").alias("rr1"))
    return one, d.select(*TRACE, moved("ttl", -1), F.col("resp").alias("resp2"), F.col("rr").alias("rr2"))


def _described(pairs: DataFrame) -> DataFrame:
    near = F.coalesce(ipf.off_by_one_loose("resp2", _entry("rr2", -1)), F.lit(False))
    near2 = F.coalesce(ipf.off_by_one_loose("resp2", _entry("rr2", -2)), F.lit(False))
    return pairs.select(
        *TRACE, "ttl", "resp1", "resp2", "rr1", "rr2",
        (F.size("rr2") - F.size("rr1")).alias("delta"), pf.same_path("rr2", "rr1").alias("same"),
        (near & ~near2).alias("off"), (~near | near2).alias("plus_b"),
    )


CROWD = 64   # probes of a trace at one TTL: beyond it they meet by prefix


def settled_pairs(rr: DataFrame) -> DataFrame:
    """Those of ``path_pairs`` whose lists agree or whose responder is the same, without pairing all probes of a crowded TTL.

    Where neither TTL has more than ``CROWD`` probes they simply meet. Elsewhere: lists agree when the shorter is a prefix
    of the longer, so the shorter meets the prefixes of the longer (ten at most) by equality; probes of one responder meet
    by responder.
    """
    one, two = _neighbours(rr)
    place = [*TRACE, "ttl"]
    crowd = one.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(*place)
    crowd = cut_lineage(crowd.unionByName(crowd.select(*TRACE, moved("ttl", -1))).distinct())
    settled = pf.same_path("rr2", "rr1") | (F.col("resp1") == F.col("resp2"))
    if crowd.isEmpty():
        return _described(one.join(two, place).where(settled))
    few = one.join(crowd, place, "left_anti").join(two, place).where(settled)
    one, two = one.join(crowd, place, "left_semi"), two.join(crowd, place, "left_semi")
    prefixes = lambda d, c, less: d.withColumn("key", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(c) - less), lambda k: F.slice(c, F.lit(1), k))))
    key = [*TRACE, "ttl", "key"]
    later = one.withColumn("key", F.col("rr1")).join(prefixes(two, "rr2", 0), key)
    shorter = two.withColumn("key", F.col("rr2")).join(prefixes(one.where(F.size("rr1") > 0), "rr1", 1), key)
    pair = [*TRACE, "ttl", "resp1", "rr1", "resp2", "rr2"]
    unmoved = one.join(two, [*TRACE, "ttl"]).where("resp1 = resp2").where(~pf.same_path("rr2", "rr1"))
    parts = [d.select(*pair) for d in (few, later, shorter, unmoved)]
    return _described(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def same_path(rr: DataFrame) -> DataFrame:
    """First address that differs between the lists of neighbouring probes, per trace: it gets the tag Flapping."""
    p = path_pairs(rr).withColumn("ip", pf.first_disagreement("rr2", "rr1")).where("ip IS NOT NULL")
    return p.select(*TRACE, "ttl", "ip").distinct().withColumn("tag", F.lit("Flapping"))


def rr_delta(pairs: DataFrame) -> DataFrame:
    """Length differences of same-path pairs; anything but -1, 0, 1, 2, or an unmoved responder, rejects the trace."""
    bad = ~F.col("delta").isin(-1, 0, 1, 2) | (F.col("resp1") == F.col("resp2"))
    return pairs.where("same OR resp1 = resp2").select(*TRACE, "ttl", "resp1", "resp2", "delta", bad.alias("reject"))


def _constrain(df: DataFrame, *specs) -> DataFrame:
    """Constraints of several rules from one pass: each spec is (condition, column of the responder, mask, hidden)."""
    rows = [
        F.when(cond, F.struct(F.col(who).alias("resp"), F.lit(mask).alias("mask"), F.lit(hidden).alias("hidden")))
        for cond, who, mask, hidden in specs
    ]
    kept = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return df.select(*TRACE, F.explode(kept).alias("c")).select(*TRACE, "c.*")


def _plus_two_specs():
    hit = F.col("same") & ((F.col("delta") == 2) | ((F.col("ttl") == 0) & (F.col("delta") == 1)))
    return [(hit, "resp2", B, False), (hit, "resp1", A, False)]


def _zero_specs():
    hit = F.col("same") & (F.col("delta") == 0) & (F.size("rr2") < pf.RR_SLOTS)
    return [(hit, "resp2", A_OR_N, False), (hit, "resp1", B_OR_N, False)]


def _off_by_one_spec():
    near = F.coalesce(ipf.off_by_one_loose("resp", _entry("rr", -1)), F.lit(False))
    near2 = F.coalesce(ipf.off_by_one_loose("resp", _entry("rr", -2)), F.lit(False))
    return near & ~near2, "resp", A_OR_N, False


def rule_plus_two(pairs: DataFrame) -> DataFrame:
    """+2 (or +1 from the source): the later is B, the earlier A."""
    return _constrain(pairs, *_plus_two_specs()).distinct()


def rule_zero(pairs: DataFrame) -> DataFrame:
    """0 with room in the list: the later is A or N, the earlier B or N."""
    return _constrain(pairs, *_zero_specs()).distinct()


def rule_intersection(constraints: DataFrame) -> DataFrame:
    """All constraints on a responder of a trace hold together; an empty set is a contradiction."""
    return constraints.groupBy(*TRACE, "resp").agg(
        F.bit_and("mask").cast("int").alias("mask"), F.bool_or("hidden").alias("hidden"))


def rule_off_by_one(rr: DataFrame) -> DataFrame:
    """A responder next to its last recorded address (and not to the one before) is not B."""
    return _constrain(rr, _off_by_one_spec()).distinct()


def rule_double_zero(pairs: DataFrame) -> DataFrame:
    """Two 0 steps in a row: the middle is N, the last A or N."""
    z = pairs.where("same AND delta = 0")
    first = z.select(*TRACE, (F.col("ttl") + 1).alias("ttl"), F.col("resp2").alias("resp1"), F.col("rr2").alias("rr1")).distinct()
    hit = z.join(first, [*TRACE, "ttl", "resp1", "rr1"], "left_semi")
    return _constrain(hit, (F.lit(True), "resp1", N, False), (F.lit(True), "resp2", A_OR_N, False)).distinct()


def _with_state(pairs: DataFrame, state: DataFrame) -> DataFrame:
    s1 = state.select(*TRACE, F.col("resp").alias("resp1"), F.col("mask").alias("m1"), F.col("hidden").alias("h1"))
    s2 = state.select(*TRACE, F.col("resp").alias("resp2"), F.col("mask").alias("m2"), F.col("hidden").alias("h2"))
    return pairs.join(s1, [*TRACE, "resp1"]).join(s2, [*TRACE, "resp2"])


def _known(m):
    return F.col(m).isin(A, B, N)


def _plus_one_specs():
    hit = (F.col("delta") == 1) & F.col("same") & _known("m1") & ~_known("m2")
    after_a, rest = hit & (F.col("m1") == A), hit & (F.col("m1") != A)
    return [
        (after_a & ~F.col("h1"), "resp2", A_OR_N, False), (after_a & F.col("h1"), "resp2", A, False),
        (rest & F.col("plus_b"), "resp2", B, False), (rest & F.col("plus_b"), "resp1", B_OR_N, False),
        (rest & ~F.col("plus_b"), "resp2", A, True),
    ]


def _forward_spec():
    hit = (F.col("delta") == 1) & F.col("same") & ~_known("m1") & (F.col("m2").bitwiseAND(F.lit(B)) == 0)
    return hit, "resp1", A, False


def rule_plus_one(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """+1 after a settled responder: after A it is A or N, after a hidden A it is A; after N or B it is B, or an A
    behind a hidden router when its address is next to its last recorded one."""
    return _constrain(_with_state(pairs, state), *_plus_one_specs()).distinct()


def rule_forward(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """The next responder cannot be B and is +1: this one is A."""
    return _constrain(_with_state(pairs, state), _forward_spec()).distinct()


def start_state(rr: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the rules without memory say; responders without a constraint may be anything."""
    alone = _constrain(rr, (F.lit(True), "resp", ANY, False), _off_by_one_spec())
    return rule_intersection(alone.unionByName(_constrain(pairs, *_plus_two_specs(), *_zero_specs())))


def rejected_traces(rr: DataFrame, tr: DataFrame, pairs: DataFrame, flaps: DataFrame | None = None) -> DataFrame:
    """Traces the inference gives up on before it starts: odd steps, layer-2 flaps, wrongly shifted answers."""
    from .repair import stupid_routers

    out = rr_delta(pairs).where("reject").select(*TRACE).unionByName(stupid_routers(rr, tr).select(*TRACE))
    if flaps is not None:
        out = out.unionByName(flaps.select(*TRACE))
    return out.distinct()


def classify_routers(rr: DataFrame, tr: DataFrame, flaps: DataFrame | None = None):
    """(src, dst, resp, mask, hidden) of accepted traces, by repeating the rules until nothing changes.

    Every rule looks at one trace at a time, so the probes are dealt out by trace once and all that follows stays so. A round
    handles only traces the round before changed. Masks only lose bits and ``hidden`` only turns true, so the rounds end by
    themselves.
    """
    keep, rr, tr = dealt(TRACE, rr.select(*TRACE, "ttl", "resp", "rr"), tr.select(*TRACE, "ttl", "resp"))
    return keep.result(_classified(rr, tr, flaps, keep))


def _classified(rr: DataFrame, tr: DataFrame, flaps: DataFrame | None, keep) -> DataFrame:
    pairs = keep(settled_pairs(rr))
    bad = keep.deal(rejected_traces(rr, tr, pairs, flaps))
    rr = rr.join(bad, TRACE, "left_anti")
    pairs = pairs.where("same").join(bad, TRACE, "left_anti")
    state = start_state(rr, pairs).select(*CONSTRAINT).unionByName(rule_double_zero(pairs))
    state = keep(rule_intersection(state))
    # the rules of the rounds are on +1 steps and read no lists
    pairs = keep(pairs.where("delta = 1").select(*TRACE, "resp1", "resp2", "delta", "same", "plus_b").distinct())
    settled = []
    while True:
        cons = _constrain(_with_state(pairs, state), *_plus_one_specs(), _forward_spec())
        new = rule_intersection(state.select(*CONSTRAINT).unionByName(cons))
        old = state.select(*TRACE, "resp", F.col("mask").alias("om"), F.col("hidden").alias("oh"))
        moved = F.max(F.expr("mask <> om OR hidden <> oh")).over(W.partitionBy(*TRACE))
        both = keep(new.join(old, [*TRACE, "resp"]).select(*CONSTRAINT, moved.alias("moved")))
        settled.append(both.where("NOT moved").select(*CONSTRAINT))
        state = both.where("moved").select(*CONSTRAINT)
        if state.isEmpty():
            break
    for s in settled:
        state = state.unionByName(s)
    broken = state.where("mask = 0").select(*TRACE).distinct()
    return state.join(broken, TRACE, "left_anti")


def type_name(mask="mask", hidden="hidden"):
    """HA, A, B, N or U (not settled)."""
    m = F.col(mask)
    return F.when((m == A) & F.col(hidden), "HA").when(m == A, "A").when(m == B, "B").when(m == N, "N").otherwise("U")


def rr_links(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Links and interfaces by the behaviour of both ends of a same-path pair.

    `kind` is `link` (a -> b with a type) or `alias` (address b belongs to the router that answers as a).
    """
    t = _with_state(pairs.where("same"), state).withColumn("t1", type_name("m1", "h1")).withColumn(
        "t2", type_name("m2", "h2"))
    t = t.withColumn("t1", F.when(F.col("t1") == "HA", "A").otherwise(F.col("t1")))
    last, before, prev_last = _entry("rr2", -1), _entry("rr2", -2), _entry("rr1", -1)
    r1, r2 = F.col("resp1"), F.col("resp2")
    link = lambda a, b, ty: F.struct(F.lit("link").alias("kind"), a.alias("a"), b.alias("b"), F.lit(ty).alias("link_type"))
    alias = lambda a, b: F.struct(F.lit("alias").alias("kind"), a.alias("a"), b.alias("b"), F.lit(0).alias("link_type"))
    ab, c = F.col("t1"), F.col("t2")
    plain = F.array(link(r1, r2, pf.STR))
    out = (
        F.when((ab == "A") & (c == "B"), F.array(alias(r1, before), alias(r2, last), link(before, r2, pf.RR)))
        .when((ab == "A") & (c == "A"), F.array(alias(r1, last), link(last, r2, pf.RR)))
        .when((ab == "A") & c.isin("N", "U"), plain)
        .when(ab.isin("N", "U") & (c == "B"), F.array(alias(r2, last), link(r1, r2, pf.STR)))
        .when(ab.isin("N", "U") & c.isin("A", "N", "U"), plain)
        .when((ab == "B") & (c == "B"), F.array(alias(r2, last), link(prev_last, r2, pf.RR)))
        .when((ab == "B") & c.isin("A", "N", "U"), F.array(link(prev_last, r2, pf.RR)))
        .when((ab == "B") & (c == "HA"), F.array(link(prev_last, last, pf.RR), link(last, r2, pf.RR)))
    )
    e = t.select(F.explode(out).alias("e")).select("e.*").where("a IS NOT NULL AND b IS NOT NULL AND (kind = 'link' OR a <> b)")
    return e.distinct()


def hidden_chain(rr: DataFrame, pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Probes without an earlier match: their recorded addresses chained from the source as hidden routers.

    For A-like (or open) responders the whole list is chained and a RR link leads to the responder; for B the last
    entry is the responder's own interface. HIDDEN links are given only to addresses that never answer themselves.
    """
    matched = pairs.where("same").select(*TRACE, (F.col("ttl") + 1).alias("ttl"), F.col("resp2").alias("resp"), F.col("rr2").alias("rr")).distinct()
    d = rr.select(*TRACE, "ttl", "resp", "rr").distinct().where("ttl > 1").join(
        matched, [*TRACE, "ttl", "resp", "rr"], "left_anti").join(state, [*TRACE, "resp"])
    is_b, a_like = F.col("mask") == B, F.col("mask").bitwiseAND(F.lit(A)) != 0
    d = d.where(is_b | a_like).withColumn("body", F.when(is_b, F.slice("rr", 1, F.greatest(F.size("rr") - 1, F.lit(0)))).otherwise(F.col("rr")))
    steps = F.concat(F.array("src"), F.col("body"))
    chain = d.select(F.explode(F.arrays_zip(F.slice(steps, 1, F.size("body")).alias("a"), F.col("body").alias("b"))).alias("e")).select("e.*")
    answers = rr.select(F.col("resp").alias("b")).distinct()
    hid = chain.distinct().join(answers, "b", "left_anti").select("a", "b", F.lit(pf.HIDDEN).alias("link_type"))
    tail = d.select(
        F.element_at(steps, -1).alias("a"), F.when(is_b, F.coalesce(_entry("rr", -1), F.col("resp"))).otherwise(F.col("resp")).alias("b"),
        F.lit(pf.RR).alias("link_type"))
    return hid.unionByName(tail).distinct()


def tr_fallback_links(probes: DataFrame) -> DataFrame:
    """A plain probe links to the probes one TTL earlier whose iteration has the same parity."""
    d = probes.select(*TRACE, "ttl", "resp", F.pmod("it", F.lit(2)).alias("par"), F.isnull("rr").alias("plain")).distinct()
    two = d.where("plain").select(*TRACE, (F.col("ttl") - 1).alias("ttl"), "par", F.col("resp").alias("ip2"))
    one = d.select(*TRACE, "ttl", "par", F.col("resp").alias("ip1")).distinct()
    return one.join(two, [*TRACE, "ttl", "par"]).where("ip1 <> ip2").select("ip1", "ip2").distinct().withColumn("link_type", F.lit(pf.TR))


def ensure_reachability(hops: DataFrame, links: DataFrame) -> DataFrame:
    """UNKNOWN links for responders no link leads to, from the last reachable hop before them (else the source).

    `hops(src, dst, ttl, it, resp)`. A responder counts as reachable from its second appearance in a trace on. The
    look-back runs over sorted runs, so one very long trace does not meet in one task.
    """
    first = hops.groupBy(*TRACE, "resp").agg(F.min(F.struct("ttl", "it")).alias("f"))
    d = hops.select(*TRACE, "ttl", "it", "resp").distinct().join(first, [*TRACE, "resp"])
    into = links.select(F.col("ip2").alias("resp")).distinct().withColumn("linked", F.lit(True))
    d = d.join(into, "resp", "left").withColumn(
        "ok", F.coalesce("linked", F.lit(False)) | (F.struct("ttl", "it") > F.col("f")) | (F.col("resp") == F.col("src"))
    ).withColumn("known", F.when(F.col("ok"), F.col("resp"))).select(*TRACE, "ttl", "it", "resp", "ok", "known")
    runs = S.last_known(S.in_runs(d, TRACE, ["ttl", "it", "resp"]), TRACE, ["ttl", "it", "resp"], "known", "last")
    return runs.where("NOT ok").select(F.coalesce("last", "src").alias("ip1"), F.col("resp").alias("ip2")).distinct().withColumn(
        "link_type", F.lit(pf.UNKNOWN))


def nat_split(probes: DataFrame) -> DataFrame:
    """Router identity of each responder: its address, or one of its own per (trace, ttl, it) behind a NAT hop."""
    nat = probes.where("class = 'NAT'").select(*TRACE, (F.col("ttl") + 1).alias("ttl")).distinct().withColumn("nat", F.lit(True))
    d = probes.select(*TRACE, "ttl", "it", "resp").distinct().join(nat, [*TRACE, "ttl"], "left")
    own = F.concat_ws(":", *[F.col(c).cast("string") for c in ["resp", *TRACE, "ttl", "it"]])
    return d.select(*TRACE, "ttl", "it", "resp",
                    F.when(F.col("nat") & (F.col("ttl") > 1), own).otherwise(F.col("resp").cast("string")).alias("router"))


def merge_router_types(marks: DataFrame) -> DataFrame:
    """Type marks of one router combined: a mark that another one wins over goes; opposite marks left over are a
    violation, which an MPLS mark excuses. `marks(router, type)` -> (router, types, violation)."""
    g = marks.groupBy("router").agg(F.array_sort(F.collect_set("type")).alias("all"))

    def beaten(t):
        cond = F.lit(False)
        for winner, losers in TYPE_PRECEDENCE.items():
            cond = cond | (F.array_contains("all", winner) & t.isin(losers))
        return cond

    kept = F.filter("all", lambda t: ~beaten(t))
    g = g.withColumn("types", kept)
    clash = F.lit(False)
    for x, ys in OPPOSITE_TYPES.items():
        for y in ys:
            clash = clash | (F.array_contains("types", x) & F.array_contains("types", y))
    return g.select("router", "types", (clash & ~F.array_contains("all", "MPLS")).alias("violation"))
