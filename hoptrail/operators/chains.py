"""Whole runs over the single operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe as pf
from ..session import cut_lineage, dealt
from . import graph as G
from . import hops as H
from . import repair as R
from . import union as U


def _without(pairs: DataFrame, votes: DataFrame, side: str) -> DataFrame:
    """Pairs (a1, a2) that did not lose a vote; a tie settles nothing, so neither side stays."""
    lost = votes.where(F.col("winner") != side).select(F.col("ip1").alias("_lo"), F.col("ip2").alias("_hi"))
    d = pairs.withColumn("_lo", F.least("a1", "a2")).withColumn("_hi", F.greatest("a1", "a2"))
    return d.join(lost, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def merge_and_settle(facts: DataFrame, min_quality: int = pf.STR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solved models -> one graph: (votes, routers, links).

    `facts(model, pred, a1, a2, a3)`. Aliases of addresses their model tags `rrend` go first. Pairs that some models
    call a link of good quality and others an alias are put to the vote of their believers; the losing side's facts
    go. Components of the alias pairs that stay are the routers, and every address of a fact that stays has one.

    ``votes`` is that of `resolve_by_vote`; ``routers`` is (router, ip, label) with the lowest address as router and a
    label from the tags and types all models give its addresses; ``links`` is (r1, r2, link_type, n_links, n_models):
    one row per two routers with the best type, the number of address pairs and of models behind it. Links inside a
    router are left out.
    """
    facts = cut_lineage(U.exclude_rrend(facts))
    believers = U.conflict_believers(facts, U.alias_link_conflicts(facts, min_quality))
    votes = cut_lineage(U.resolve_by_vote(believers))
    links = _without(facts.where("pred = 'link'"), votes, "link")
    aliases = _without(facts.where("pred = 'alias'").select("a1", "a2").distinct(), votes, "alias")
    marks = facts.where("pred IN ('other', 'type')")
    nodes = links.select(F.explode(F.array("a1", "a2")).alias("ip")).unionByName(marks.select(F.col("a1").alias("ip"))).distinct()
    comp = cut_lineage(G.connected_components(aliases, nodes, "a1", "a2"))

    of = lambda kind: F.when(F.col("pred") == kind, F.col("a3"))
    tags = marks.select(F.col("a1").alias("ip"), of("type").alias("type"), of("other").alias("tag")).distinct()
    members = comp.withColumnRenamed("root", "router").join(tags, "ip", "left")
    routers = comp.withColumnRenamed("root", "router").join(G.router_label(members), "router")

    ends = links
    for k in ("1", "2"):
        ends = ends.join(comp.select(F.col("ip").alias(f"a{k}"), F.col("root").alias(f"_r{k}")), f"a{k}")
    merged = ends.where("_r1 <> _r2").groupBy(F.least("_r1", "_r2").alias("r1"), F.greatest("_r1", "_r2").alias("r2")).agg(
        F.min(F.col("a3").cast("int")).alias("link_type"),
        F.count_distinct(F.least("a1", "a2"), F.greatest("a1", "a2")).alias("n_links"), F.count_distinct("model").alias("n_models"))
    return votes, routers, merged


class Repaired(NamedTuple):
    probes: DataFrame
    tags: DataFrame
    pairs: DataFrame
    full: DataFrame
    gaps: DataFrame


def repair_chain(rr: DataFrame, tr: DataFrame) -> Repaired:
    """Record-route and plain probes of traces -> what a solver is told about them.

    Every step looks at one trace at a time, so both kinds are dealt out by trace once and stay so.

    Repairs run in the order spoof, flaky, lazy, each on what the one before left. Pairs of consecutive probes, pairs
    with full lists and gaps come from the repaired probes; in traces behind a layer-2 switch or with a lazy router a
    pair has to occur among the plain probes too. ``tags`` is (ip, tags) of all passes.
    """
    keep, rr, tr = dealt(H.TRACE, rr.select(*R.RR_COLS), tr.select(*H.TRACE, "ttl", "resp"), distinct=True)
    probes, china = R.fix_dst_spoof(rr, tr)
    probes, flaky = R.flaky_routers(keep(probes))
    probes, lazy, fixed, moved = R.lazy_routers(probes, tr, keep)
    known = keep(R.known_probes(probes, tr, keep))
    probes = known.drop("in_tr")
    switch = keep(R.layer2_switch(probes))
    consecutive = keep(R.pairs_of_known(known))
    checked = keep.deal(switch.select("src", "dst").unionByName(moved).distinct())
    pairs = keep.result(R.paranoid_pairs(R.not_full(consecutive), tr, 1, checked))
    full = keep.result(R.full_of(consecutive))
    gaps = keep.result(R.gaps_of_known(known, consecutive, fixed, keep=keep))
    layer2 = switch.select(F.explode(F.array("edge", "ip")).alias("ip")).withColumn("tag", F.lit("layer2"))
    tags = R.ip_tags(R.end_tags(tr), china, flaky, lazy, layer2, H.tr_self_links(tr))
    return Repaired(probes, tags, pairs, full, gaps)


def trace_facts(chain: Repaired) -> DataFrame:
    """(pred, src, dst, ttl, resp1, resp2, length, delta, n): the pairs and gaps of a chain as one table of facts."""
    key, none = ["src", "dst", "ttl", "resp1", "resp2"], F.lit(None).cast("int")
    row = lambda d, pred, length, delta, n: d.select(
        F.lit(pred).alias("pred"), *key, length.cast("int").alias("length"), delta.cast("int").alias("delta"), n.cast("int").alias("n"))
    c = F.col
    return row(chain.pairs, "probePair", none, c("delta"), c("n")).unionByName(
        row(chain.full, "trPair", none, none, none)).unionByName(row(chain.gaps, "gap", c("length"), c("delta"), c("n")))
