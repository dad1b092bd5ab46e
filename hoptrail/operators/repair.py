"""Probe pairs, gaps, and repairs of misleading answers.

`rr(src, dst, ttl, resp, rr)` are record-route probes, `tr(src, dst, ttl, resp)` plain ones. Repairs run in the order
spoof, flaky, lazy; each returns the repaired probes and the tags it found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe as pf
from ..session import Keep, cut_lineage, keep_table
from .hops import TRACE, hop_set, moved, placed

RR_COLS = [*TRACE, "ttl", "resp", "rr"]


def rr_set(rr: DataFrame) -> DataFrame:
    return rr.select(*RR_COLS).distinct()


def _last(rr):
    return F.try_element_at(F.col(rr), F.lit(-1))


def known_probes(rr: DataFrame, tr: DataFrame, keep=None) -> DataFrame:
    """Distinct record-route probes; ``in_tr`` tells that their responder answers plain probes of the source at that TTL.

    With the ``keep`` of tables `dealt` by trace, the plain probes of the own trace are asked where they lie, and only responders
    not among them meet those of the source's other traces, without their lists. Probes without a place are not marked.
    """
    if keep is not None:
        d, h, place = rr_set(rr), hop_set(tr), [*TRACE, "ttl", "resp"]
        others = keep.deal(d.select(*place).distinct().join(h, place, "left_anti").join(
            h.select("src", "ttl", "resp").distinct(), ["src", "ttl", "resp"], "left_semi"))
        mark = lambda hops, name: hops.select(*place, F.lit(True).alias(name))
        return d.join(mark(h, "_own"), place, "left").join(mark(others, "_other"), place, "left").select(
            *RR_COLS, F.coalesce("_own", "_other", F.lit(False)).alias("in_tr"))
    known = tr.select("src", "ttl", "resp").distinct().withColumn("in_tr", F.lit(True))
    return rr_set(rr).join(known, ["src", "ttl", "resp"], "left").withColumn("in_tr", F.coalesce("in_tr", F.lit(False)))


def consecutive_probes(rr: DataFrame, tr: DataFrame, keep=None) -> DataFrame:
    """Pairs of record-route probes one TTL apart that took the same path, both without a self loop.

    The lists must fit (the later is not shorter, the responders differ) and one of three tests must hold: the earlier
    probe recorded nothing or recorded its own address last; the entries at the earlier list's end agree and both
    probes also occur among the plain ones; or the earlier list is a prefix of the later. ``keep`` is that of `dealt` by trace.
    """
    known = known_probes(placed(rr, *TRACE, "ttl", "resp"), tr, keep)
    return pairs_of_known(known if keep is None else keep(known))


def pairs_of_known(known: DataFrame) -> DataFrame:
    """`consecutive_probes` of probes that are distinct and marked already."""
    d = placed(known, *TRACE, "ttl", "resp").where(~pf.rr_self_loop("rr"))
    one = d.select(*TRACE, "ttl", F.col("resp").alias("resp1"), F.col("rr").alias("rr1"), F.col("in_tr").alias("in1"))
    two = d.select(*TRACE, moved("ttl", -1), F.col("resp").alias("resp2"), F.col("rr").alias("rr2"),
                   F.col("in_tr").alias("in2"))
    n1 = F.size("rr1")
    silent = (n1 == 0) | (_last("rr1") == F.col("resp1"))
    ends = F.col("in1") & F.col("in2") & (_last("rr1") == F.try_element_at("rr2", F.greatest(n1, F.lit(1))))
    prefix = F.slice("rr2", 1, n1) == F.col("rr1")
    j = one.join(two, [*TRACE, "ttl"]).where(
        (F.size("rr2") >= n1) & (F.col("resp1") != F.col("resp2")) & (F.coalesce(silent, F.lit(False))
                                                                      | F.coalesce(ends, F.lit(False)) | prefix)
    )
    return j.select(
        *TRACE, "ttl", "resp1", "resp2", "rr1", "rr2",
        (F.size("rr2") - n1).alias("delta"), F.size("rr2").alias("n"), (n1 >= pf.RR_SLOTS).alias("full"),
    )


def rr_probe_pairs(rr: DataFrame, tr: DataFrame, keep=None) -> DataFrame:
    return not_full(consecutive_probes(rr, tr, keep))


def not_full(pairs: DataFrame) -> DataFrame:
    return pairs.where("NOT full").drop("full")


def rr_full_pairs(rr: DataFrame, tr: DataFrame) -> DataFrame:
    """Pairs whose earlier list is full: they carry no more than a plain pair does."""
    return full_of(consecutive_probes(rr, tr))


def full_of(pairs: DataFrame) -> DataFrame:
    return pairs.where("full").select(*TRACE, "ttl", "resp1", "resp2").distinct()


def dedup_probe_pairs(pairs: DataFrame) -> DataFrame:
    """One pair per (responders, last delta+1 entries of the later list): the lowest by trace and TTL."""
    k = F.least(F.col("delta") + 1, F.size("rr2"))
    suffix = F.slice("rr2", F.greatest(F.size("rr2") - k + 1, F.lit(1)), k)
    cols = [*TRACE, "ttl", "rr1", "rr2", "n"]
    g = pairs.groupBy("resp1", "resp2", "delta", suffix.alias("suffix")).agg(
        F.min(F.struct(*TRACE, "ttl", "rr1", "rr2", "n")).alias("p"))
    return g.select("resp1", "resp2", "delta", *[F.col(f"p.{c}") for c in cols])


def paranoid_pairs(pairs: DataFrame, tr: DataFrame, level: int, layer2: DataFrame | None = None) -> DataFrame:
    """Level 0 keeps all; 2 keeps pairs whose probes also occur among the trace's plain ones; 1 asks that only of
    traces behind a layer-2 switch (``layer2``: src, dst)."""
    if level == 0:
        return pairs
    h = hop_set(tr)
    first = h.withColumnRenamed("resp", "resp1")
    second = h.select(*TRACE, (F.col("ttl") - 1).alias("ttl"), F.col("resp").alias("resp2"))
    both = lambda p: p.join(first, [*TRACE, "ttl", "resp1"], "left_semi").join(
        second, [*TRACE, "ttl", "resp2"], "left_semi")
    if level == 2:
        return both(pairs)
    l2 = layer2.select(*TRACE).distinct()
    return pairs.join(l2, TRACE, "left_anti").unionByName(both(pairs.join(l2, TRACE, "left_semi")))


def gap_links(rr: DataFrame, tr: DataFrame, lazy_fixed: DataFrame | None = None, max_ttl: int | None = None) -> DataFrame:
    """For a probe without a pair: the nearest later TTL with a probe whose list agrees on the common entries.

    Where a probe recorded its own address last, its last common entry may differ. ``max_ttl`` limits the later TTL where
    given.
    """
    known = keep_table(known_probes(rr, tr))
    return gaps_of_known(known, pairs_of_known(known), lazy_fixed, max_ttl)


def gaps_of_known(known: DataFrame, pairs: DataFrame, lazy_fixed: DataFrame | None = None, max_ttl: int | None = None,
                  keep=Keep()) -> DataFrame:
    """`gap_links` of distinct probes and their `consecutive_probes`.

    Lists agree by prefix, so later probes are keyed by each of their prefixes (ten at most) and only the lowest probe
    per (prefix, TTL) is kept; a probe then meets at most a few candidates, however many probes its trace has. Either list
    travels as its prefix and what follows. Probes with nothing two TTLs later in their trace, and later probes before any
    that looks for them, leave before their lists are cut.
    """
    d = known.select(*RR_COLS)
    paired = not_full(pairs).select(*TRACE, "ttl", F.col("resp1").alias("resp"), F.col("rr1").alias("rr")).distinct()
    last = d.groupBy(*TRACE).agg(F.max("ttl").alias("_last"))
    one = d.where(~pf.rr_self_loop("rr") & (F.size("rr") < pf.RR_SLOTS)).join(last, TRACE).where(
        F.col("ttl") + 2 <= F.col("_last")).drop("_last").join(paired, RR_COLS, "left_anti")
    one = keep(one)
    first = one.groupBy(*TRACE).agg(F.min("ttl").alias("_first"))
    two = d
    if lazy_fixed is not None:   # the lists stay with their trace, only responders are sent
        fixed = lazy_fixed.select(F.col("ip").alias("resp")).distinct()
        two = d.join(keep.deal(d.select(*TRACE, "resp").distinct().join(fixed, "resp", "left_semi")), [*TRACE, "resp"], "left_anti")
    if max_ttl is not None:
        two = two.where(F.col("ttl") <= max_ttl)
    two = two.join(first, TRACE).where(F.col("ttl") >= F.col("_first") + 2)
    cut = lambda: [F.slice("rr", 1, F.col("k")).alias("prefix"), F.expr("slice(rr, k + 1, greatest(size(rr) - k, 0))").alias("more")]
    cuts = F.explode(F.sequence(F.lit(0), F.size("rr"))).alias("k")
    cand = (
        two.select(*TRACE, F.col("ttl").alias("ttl2"), "resp", "rr", cuts).select(*TRACE, "ttl2", "resp", *cut())
        .groupBy(*TRACE, "prefix", F.least(F.size("more"), F.lit(2)).cast("byte").alias("rest"), "ttl2")
        .agg(F.min(F.struct("resp", "more")).alias("b"))
    )
    own = F.coalesce((F.size("rr") > 0) & (_last("rr") == F.col("resp")), F.lit(False))
    # entries a later list may have after the prefix: any after the whole list; else none, or where the own address may
    # differ any after all but that, and one after less
    left = F.size("more")
    most = F.when((left == 0) | (F.col("own") & (left == 1)), 2).when(F.col("own"), 1).otherwise(0).cast("byte")
    want = one.select("*", own.alias("own"), cuts).select(*TRACE, "ttl", "resp", "own", *cut()).select(
        *TRACE, "ttl", "resp", "prefix", "more", most.alias("most"))
    hit = want.join(cand, [*TRACE, "prefix"]).where((F.col("ttl2") >= F.col("ttl") + 2) & (F.col("rest") <= F.col("most")))
    whole = lambda more: F.concat("prefix", more)
    best = hit.select(*TRACE, "ttl", "resp", whole(F.col("more")).alias("rr"), F.struct(
        "ttl2", F.col("b.resp").alias("resp"), whole(F.col("b.more")).alias("rr")).alias("f")).groupBy(*RR_COLS).agg(F.min("f").alias("f"))
    n1 = F.size("rr")
    length = F.least(F.col("f.ttl2") - F.col("ttl"), F.lit(pf.RR_SLOTS) - n1)
    return best.select(
        *TRACE, "ttl", F.col("resp").alias("resp1"), "rr", F.col("f.ttl2").alias("ttl2"), F.col("f.resp").alias("resp2"),
        length.alias("length"), (F.size("f.rr") - n1).alias("delta"), F.size("f.rr").alias("n"),
    )


def layer2_switch(rr: DataFrame) -> DataFrame:
    """`(src, dst, ttl, edge, ip)`: one last recorded address led to several responders at one TTL."""
    e = rr.where(F.size("rr") > 0).select(*TRACE, "ttl", _last("rr").alias("edge"), F.col("resp").alias("ip")).distinct()
    many = e.groupBy(*TRACE, "ttl", "edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return e.join(many, [*TRACE, "ttl", "edge"], "left_semi")


def layer2_flap(probes: DataFrame, iterations: int) -> DataFrame:
    """Probes (with ``it``) of one TTL, two iterations apart, with equal lists but different responders."""
    nxt = probes.select(*TRACE, "ttl", F.pmod(F.col("it") - 2, F.lit(iterations)).alias("it"), "rr",
                        F.col("resp").alias("resp2")).distinct()
    one = probes.select(*TRACE, "ttl", "it", "rr", F.col("resp").alias("resp1")).distinct()
    return one.join(nxt, [*TRACE, "ttl", "it", "rr"]).where("resp1 <> resp2").select(*TRACE, "ttl", "resp1", "resp2").distinct()


def fix_dst_spoof(rr: DataFrame, tr: DataFrame):
    """Record-route answers that carry the destination's address although the trace goes on.

    If plain probes of the TTL were answered by others, the lowest of these is the true responder and all are tagged;
    else, if a record-route probe one TTL later was answered by another host, the lowest first entry of such lists is.
    """
    d = rr_set(rr)
    others = hop_set(tr).where("resp <> dst")
    by_tr = others.groupBy(*TRACE, "ttl").agg(F.min("resp").alias("by_tr"))
    nxt = d.where((F.col("resp") != F.col("dst")) & (F.size("rr") > 0)).groupBy(
        *TRACE, (F.col("ttl") - 1).alias("ttl")).agg(F.min(F.col("rr")[0]).alias("by_rr"))
    spoofed = d.where("resp = dst").join(by_tr, [*TRACE, "ttl"], "left").join(nxt, [*TRACE, "ttl"], "left")
    fixed = spoofed.withColumn("resp", F.coalesce("by_tr", "by_rr", "resp")).select(*RR_COLS)
    where_spoofed = spoofed.select(*TRACE, "ttl").distinct()
    tags = others.join(where_spoofed, [*TRACE, "ttl"], "left_semi").select(F.col("resp").alias("ip")).unionByName(
        spoofed.where("by_tr IS NULL AND by_rr IS NOT NULL").select(F.col("by_rr").alias("ip"))
    ).distinct().withColumn("tag", F.lit("china"))
    return d.where("resp <> dst").unionByName(fixed).distinct(), tags


def skip_walk(long_rr, short_rr):
    """Walks the shorter list against the longer one; collects the entries met right after a skipped one."""
    step = lambda acc, k: F.when(
        F.try_element_at(long_rr, k + acc["o"]) == F.try_element_at(short_rr, k), acc
    ).when(
        F.try_element_at(long_rr, k + acc["o"] + 1) == F.try_element_at(short_rr, k),
        F.struct((acc["o"] + 1).alias("o"),
                 F.concat(acc["t"], F.array(F.try_element_at(long_rr, k + acc["o"] + 1))).alias("t")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).alias("o"), F.array().cast("array<bigint>").alias("t"))
    steps = F.when(F.size(short_rr) > 0, F.sequence(F.lit(1), F.size(short_rr))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def flaky_pairs(rr: DataFrame) -> DataFrame:
    """Two lists of one responder and TTL of which the shorter misses entries of the longer; ``tagged`` follow a gap."""
    d = rr_set(rr)
    long_ = d.withColumnRenamed("rr", "rr1")
    short = d.withColumnRenamed("rr", "rr2")
    j = long_.join(short, [*TRACE, "ttl", "resp"]).where(F.size("rr1") > F.size("rr2"))
    w = skip_walk(F.col("rr1"), F.col("rr2"))
    return j.select(*TRACE, "ttl", "resp", "rr1", "rr2", w["t"].alias("tagged")).where(F.size("tagged") > 0)


def flaky_routers(rr: DataFrame):
    """Drops the shorter list of every flaky pair; tags the addresses recorded right after a skipped entry."""
    p = flaky_pairs(rr)
    drop = p.select(*TRACE, "ttl", "resp", F.col("rr2").alias("rr")).distinct()
    tags = p.select(F.explode("tagged").alias("ip")).distinct().withColumn("tag", F.lit("flaky"))
    return rr_set(rr).join(drop, RR_COLS, "left_anti"), tags


def find_lazy(rr: DataFrame, h: DataFrame) -> DataFrame:
    """Per trace the first lazy probe: its responder answers plain probes one TTL later, not at its own TTL, and does
    not come up again in the record-route probes one TTL later. Its last recorded address is the demark.
    ``h`` has the distinct plain hops."""
    later_tr = h.select(*TRACE, (F.col("ttl") - 1).alias("ttl"), "resp")
    later_rr = rr.select(*TRACE, (F.col("ttl") - 1).alias("ttl"), "resp").distinct()
    key = [*TRACE, "ttl", "resp"]
    lazy = rr.where(F.size("rr") > 0).join(later_tr, key, "left_semi").join(h, key, "left_anti").join(
        later_rr, key, "left_anti")
    return lazy.groupBy(*TRACE).agg(F.min(F.struct("ttl", "resp", "rr")).alias("f")).select(
        *TRACE, F.col("f.ttl").alias("lazy_ttl"), F.element_at("f.rr", -1).alias("demark"))


def lazy_routers(rr: DataFrame, tr: DataFrame, keep=cut_lineage):
    """Moves record-route probes that went through a lazy demark to the next TTL, until no trace has a lazy probe.

    Returns (probes, tags, lazy-fixed responders, traces to be checked at paranoid level 2). Only traces in which a
    round found something enter the next round. A round moves probes up to a TTL at which plain probes answer, so the
    rounds end by themselves. ``keep`` may be that of `dealt` by trace.
    """
    done, tags, fixed, traces = [], [], [], []
    hops = keep(hop_set(tr))
    active = keep(rr_set(rr))
    while True:
        found = keep(find_lazy(active, hops))
        if found.isEmpty():
            break
        done.append(active.join(found.select(*TRACE), TRACE, "left_anti"))
        j = active.join(found, TRACE)
        through = F.array_contains("rr", F.col("demark"))
        fixed.append(j.where(through).select(F.col("resp").alias("ip")))
        tags.append(found.select(F.col("demark").alias("ip"), F.lit("lazydemark").alias("tag")))
        tags.append(hops.join(found.select(*TRACE, F.col("lazy_ttl").alias("ttl")), [*TRACE, "ttl"], "left_semi")
                    .select(F.col("resp").alias("ip"), F.lit("lazy").alias("tag")))
        traces.append(found.select(*TRACE))
        active = keep(
            j.withColumn("ttl", F.when(through, F.col("ttl") + 1).otherwise(F.col("ttl"))).select(*RR_COLS).distinct()
        )
    spark = rr.sparkSession

    def all_of(parts, schema):
        out = spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {c}" for c, kind in map(str.split, schema.split(", "))])
        for p in parts:
            out = out.unionByName(p)
        return out.distinct()

    probes = active
    for d in done:
        probes = probes.unionByName(d)
    return (probes, all_of(tags, "ip bigint, tag string"), all_of(fixed, "ip bigint"),
            all_of(traces, "src bigint, dst bigint"))


def stupid_routers(rr: DataFrame, tr: DataFrame) -> DataFrame:
    """TTLs where no record-route responder answers plain probes, but plain probes one TTL later are answered by it.

    Points count probe pairs; 3 to 8 junk the trace (`drop`), 9 or more also mark its routers (`mark`).
    """
    key = [*TRACE, "ttl", "resp"]
    r = rr.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rr"))
    t = tr.groupBy(*key).agg(F.count(F.lit(1)).alias("n_tr"))
    t_next = t.withColumn("ttl", F.col("ttl") - 1).withColumnRenamed("n_tr", "n_next")
    j = r.join(t, key, "left").join(t_next, key, "left")
    s = j.groupBy(*TRACE, "ttl").agg(
        F.max(F.col("n_tr").isNotNull()).alias("seen"),
        F.sum(F.col("n_rr") * F.coalesce("n_next", F.lit(0))).alias("points"))
    return s.where("NOT seen AND points >= 3").select(
        *TRACE, "ttl", "points", F.when(F.col("points") >= 9, "mark").otherwise("drop").alias("verdict"))


def attach_alias_evidence(verdicts: DataFrame, ips: DataFrame) -> DataFrame:
    """Evidence rows whose two addresses both occur in the data, as potentialAlias / potentialNotAlias."""
    i = ips.select("ip").distinct()
    v = verdicts.join(i.withColumnRenamed("ip", "ip1"), "ip1", "left_semi").join(
        i.withColumnRenamed("ip", "ip2"), "ip2", "left_semi")
    return v.select(F.when(F.col("verdict") == "ALIAS", "potentialAlias").otherwise("potentialNotAlias").alias("pred"),
                    "ip1", "ip2", "source")


def attach_hints(ips: DataFrame, hints: DataFrame) -> DataFrame:
    return hints.join(ips.select("ip").distinct(), "ip", "left_semi")


def ip_tags(*passes: DataFrame) -> DataFrame:
    """Tags of one address from every pass, sorted."""
    out = passes[0].select("ip", "tag")
    for p in passes[1:]:
        out = out.unionByName(p.select("ip", "tag"))
    return out.groupBy("ip").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def end_tags(probes: DataFrame) -> DataFrame:
    s = probes.select(F.col("src").alias("ip")).distinct().withColumn("tag", F.lit("source"))
    return s.unionByName(probes.select(F.col("dst").alias("ip")).distinct().withColumn("tag", F.lit("endhost")))
