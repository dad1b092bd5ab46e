"""Merging many solved models: support, contradictions, votes, and what is left when contradictions are taken out.

`facts(model, pred, a1, a2, a3)`: pairs in a1, a2 and a link type, evidence source, tag or type letter in a3.
Believers of a side are rows, never an array per conflict, so a fact backed by very many models stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probe as pf

ALIAS_LIKE = ["alias", "-alias", "badAlias", "badNotAlias"]


def _canon(facts: DataFrame) -> DataFrame:
    """Alias-like facts are symmetric: smaller address first."""
    sym = F.col("pred").isin(ALIAS_LIKE)
    return facts.withColumn("_a", F.when(sym, F.least("a1", "a2")).otherwise(F.col("a1"))).withColumn(
        "a2", F.when(sym, F.greatest("a1", "a2")).otherwise(F.col("a2"))).withColumn("a1", F.col("_a")).drop("_a")


def exclude_rrend(facts: DataFrame) -> DataFrame:
    """Leaves out alias facts with an address the same model tags `rrend`."""
    tagged = facts.where("pred = 'other' AND a3 = 'rrend'").select("model", F.col("a1").alias("ip")).distinct()
    al = facts.where("pred = 'alias'")
    for c in ("a1", "a2"):
        al = al.join(tagged.withColumnRenamed("ip", c), ["model", c], "left_anti")
    return facts.where("pred <> 'alias'").unionByName(al.select(facts.columns))


def fact_support(facts: DataFrame) -> DataFrame:
    """Per fact the number of models that believe it. A link is one fact with its best type; ``n_types`` counts the
    types seen for it. Every evidence source of an alias pair is a row with the support of the pair."""
    c = _canon(facts)
    links = c.where("pred = 'link'").groupBy("a1", "a2").agg(
        F.min(F.col("a3").cast("int")).cast("string").alias("a3"), F.count_distinct("a3").alias("n_types"),
        F.count_distinct("model").alias("n_models"))
    al = c.where(F.col("pred").isin(ALIAS_LIKE))
    pair = al.groupBy("pred", "a1", "a2").agg(F.count_distinct("model").alias("n_models"))
    kinds = al.select("pred", "a1", "a2", "a3").distinct()
    per_kind = kinds.join(pair, ["pred", "a1", "a2"])
    tags = c.where("pred IN ('other', 'type')").groupBy("pred", "a1", "a3").agg(F.count_distinct("model").alias("n_models"))
    cols = ["pred", "a1", "a2", "a3", "n_types", "n_models"]
    no_types, no_a2 = F.lit(None).cast("bigint").alias("n_types"), F.lit(None).cast("bigint").alias("a2")
    return (
        links.withColumn("pred", F.lit("link")).select(cols)
        .unionByName(per_kind.withColumn("n_types", no_types).select(cols))
        .unionByName(tags.withColumn("n_types", no_types).withColumn("a2", no_a2).select(cols))
    )


def alias_types(facts: DataFrame) -> DataFrame:
    """Distinct evidence sources per unordered alias pair."""
    c = _canon(facts.where("pred = 'alias'"))
    return c.groupBy(F.col("a1").alias("ip1"), F.col("a2").alias("ip2")).agg(F.array_sort(F.collect_set("a3")).alias("sources"))


def _pairs(facts: DataFrame, pred: str) -> DataFrame:
    return facts.where(F.col("pred") == pred).select(F.least("a1", "a2").alias("ip1"), F.greatest("a1", "a2").alias("ip2"), "model", "a3")


def alias_link_conflicts(facts: DataFrame, min_quality: int = pf.STR) -> DataFrame:
    """Unordered pairs that are aliases and also joined by a link of good quality, with the support of both sides."""
    l = _pairs(facts, "link").groupBy("ip1", "ip2").agg(
        F.min(F.col("a3").cast("int")).alias("link_type"), F.count_distinct("model").alias("n_link"))
    a = _pairs(facts, "alias").groupBy("ip1", "ip2").agg(F.count_distinct("model").alias("n_alias"))
    return l.where(F.col("link_type") <= min_quality).join(a, ["ip1", "ip2"])


def conflict_believers(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """`(ip1, ip2, side, model)`: the models on each side of each conflict."""
    k = conflicts.select("ip1", "ip2")
    side = lambda p: _pairs(facts, p).join(k, ["ip1", "ip2"], "left_semi").select("ip1", "ip2", F.lit(p).alias("side"), "model").distinct()
    return side("link").unionByName(side("alias"))


def conflicted_ips(conflicts: DataFrame) -> DataFrame:
    return conflicts.select(F.explode(F.array("ip1", "ip2")).alias("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


def bad_traces(believers: DataFrame) -> DataFrame:
    return believers.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def models_to_fix(believers: DataFrame) -> DataFrame:
    return believers.select("model").distinct()


def bad_traces_by_source(bad: DataFrame, source=None) -> DataFrame:
    """Sum per source and its percent of all; the source is the second part of the model's name unless given."""
    s = F.split_part("model", F.lit("-"), F.lit(2)) if source is None else source
    g = bad.groupBy(s.alias("source")).agg(F.sum("n").alias("n"))
    total = bad.agg(F.sum("n")).scalar()
    return g.select("source", "n", (100.0 * F.col("n") / total).alias("pct"))


def good_facts(facts: DataFrame, min_quality: int = pf.STR) -> DataFrame:
    """Supported facts without a conflicted address."""
    bad = conflicted_ips(alias_link_conflicts(facts, min_quality)).select("ip")
    d = fact_support(facts).where("pred <> 'badLink'")
    for c in ("a1", "a2"):
        d = d.join(bad.withColumnRenamed("ip", c), c, "left_anti")
    return d


def fact_provenance(facts: DataFrame, n: int = 6) -> DataFrame:
    """Up to ``n`` example models per fact, the first by name; only these are ever brought together."""
    c = _canon(facts).select("pred", "a1", "a2", "a3", "model").distinct()
    w = W.partitionBy("pred", "a1", "a2", "a3").orderBy("model")
    top = c.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)
    return top.groupBy("pred", "a1", "a2", "a3").agg(F.array_sort(F.collect_list("model")).alias("models"))


def conflicted_facts(facts: DataFrame, bad_ips: DataFrame) -> DataFrame:
    """Facts that touch a conflicted address, and facts of probes that do.

    `facts(model, pred, ip1, ip2, id1, id2)`: addresses a fact names and probe ids it carries. Address facts are kept
    for a conflicted address; probe facts for a probe id whose tr or rr fact names one in the same model.
    """
    bad = bad_ips.select(F.col("ip")).distinct()
    probe_fact = F.col("pred").isin("rr", "tr", "tr_only")
    pair_fact = F.col("pred").isin("gap", "potentialProbePair", "probePair", "trPair")
    ids = facts.where(probe_fact).select("model", F.col("id1").alias("id"), F.col("ip1").alias("ip")).join(bad, "ip", "left_semi").select("model", "id").distinct()
    by_ip = facts.where(~probe_fact & ~pair_fact)
    b1 = bad.select(F.col("ip").alias("ip1"), F.lit(True).alias("b1"))
    b2 = bad.select(F.col("ip").alias("ip2"), F.lit(True).alias("b2"))
    touched = by_ip.join(b1, "ip1", "left").join(b2, "ip2", "left").where("b1 OR (pred = 'link' AND b2)")
    i1 = ids.select("model", F.col("id").alias("id1"), F.lit(True).alias("b1"))
    i2 = ids.select("model", F.col("id").alias("id2"), F.lit(True).alias("b2"))
    probes = facts.where(probe_fact | pair_fact).join(i1, ["model", "id1"], "left").join(i2, ["model", "id2"], "left").where("b1 OR b2")
    cols = ["model", "pred", "ip1", "ip2", "id1", "id2"]
    return touched.select(cols).unionByName(probes.select(cols))


def resolve_by_vote(believers: DataFrame, src=None, dst=None) -> DataFrame:
    """A side's vote is the smaller of its numbers of distinct sources and destinations; the larger vote wins."""
    s = F.split_part("model", F.lit("-"), F.lit(2)) if src is None else src
    d = F.split_part("model", F.lit("-"), F.lit(3)) if dst is None else dst
    v = believers.withColumn("s", s).withColumn("d", d).groupBy("ip1", "ip2", "side").agg(
        F.least(F.count_distinct("s"), F.count_distinct("d")).alias("vote"))
    g = v.groupBy("ip1", "ip2").agg(
        F.coalesce(F.max(F.when(F.col("side") == "link", F.col("vote"))), F.lit(0)).alias("link_votes"),
        F.coalesce(F.max(F.when(F.col("side") == "alias", F.col("vote"))), F.lit(0)).alias("alias_votes"))
    win = F.when(F.col("alias_votes") > F.col("link_votes"), "alias").when(F.col("link_votes") > F.col("alias_votes"), "link").otherwise("TIE")
    return g.select("ip1", "ip2", "link_votes", "alias_votes", win.alias("winner"),
                    F.try_divide(F.greatest("link_votes", "alias_votes"), F.col("link_votes") + F.col("alias_votes")).alias("share"))


def characterize_conflicts(believers: DataFrame, facts: DataFrame) -> DataFrame:
    """Percent of each side's believers that tag either address `rrend`, and how far the sides are apart."""
    tag = facts.where("pred = 'other' AND a3 = 'rrend'").select("model", F.col("a1").alias("ip")).distinct()
    hit = believers
    for c in ("ip1", "ip2"):
        hit = hit.join(tag.select("model", F.col("ip").alias(c), F.lit(True).alias(f"t_{c}")), ["model", c], "left")
    on = F.coalesce("t_ip1", "t_ip2", F.lit(False))
    pct = lambda s: F.coalesce(100.0 * F.avg(F.when(F.col("side") == s, on.cast("int"))), F.lit(0.0))
    g = hit.groupBy("ip1", "ip2").agg(
        pct("link").alias("link_pct"), pct("alias").alias("alias_pct"),
        F.count_if(F.col("side") == "link").alias("n_link"), F.count_if(F.col("side") == "alias").alias("n_alias"))
    low, high = F.least("link_pct", "alias_pct"), F.greatest("link_pct", "alias_pct")
    return g.withColumn("certainty", high / F.when(low == 0, 0.001).otherwise(low))


def resolve_from_models(conflicts: DataFrame, solved: DataFrame) -> DataFrame:
    """What re-solved models say of each conflict: only the alias, only the link (then with type 0), or neither.

    `solved(ip1, ip2, pred, a1, a2)`: facts of the model solved for conflict (ip1, ip2).
    """
    own = F.least("a1", "a2") == F.col("ip1")
    hit = solved.where(own & (F.greatest("a1", "a2") == F.col("ip2")) & F.col("pred").isin("link", "alias"))
    f = hit.groupBy("ip1", "ip2").agg(F.bool_or(F.col("pred") == "link").alias("l"), F.bool_or(F.col("pred") == "alias").alias("a"))
    j = conflicts.select("ip1", "ip2").join(f, ["ip1", "ip2"], "left")
    l, a = F.coalesce("l", F.lit(False)), F.coalesce("a", F.lit(False))
    return j.select("ip1", "ip2", F.when(l & a, "multiple").when(a, "alias").when(l, "link").otherwise("none").alias("outcome"),
                    F.when(l & ~a, F.lit(0)).alias("link_type"))


def outcome_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def faction_representatives(believers: DataFrame, n: int) -> DataFrame:
    """First ``n`` models by name on each side of each conflict."""
    w = W.partitionBy("ip1", "ip2", "side").orderBy("model")
    return believers.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).drop("i")


def representative_facts(reps: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct facts of the representatives, per conflict."""
    return reps.select("ip1", "ip2", "model").distinct().join(facts, "model").select("ip1", "ip2", "pred", "a1", "a2", "a3").distinct()


def facts_to_potentials(facts: DataFrame) -> DataFrame:
    """Solved facts as input of another solve: link, alias and -alias become potential ones, address facts pass."""
    p = F.col("pred")
    pred = (
        F.when(p == "link", "potentialLink").when(p == "alias", "potentialAlias").when(p == "-alias", "potentialNotAlias")
        .when(p.startswith("offbyone") | p.startswith("samePrefix") | p.startswith("other"), p))
    return facts.withColumn("pred", pred).where("pred IS NOT NULL")


def prefer_fixed_model(pairs: DataFrame, fixed: DataFrame, clique: DataFrame, min_size: int = 42) -> DataFrame:
    """Per source pair the fixed model if larger than ``min_size`` bytes, else the clique model, else none."""
    k = ["src", "dst"]
    f = fixed.where(F.col("size") > min_size).select(*k, F.col("path").alias("fixed"))
    c = clique.select(*k, F.col("path").alias("clique"))
    return pairs.join(f, k, "left").join(c, k, "left").select(*k, F.coalesce("fixed", "clique").alias("path"))
