"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
GROUPS = 4096        # shards of a source stand in at most so many groups
SOURCE_BLOCKS = 256   # blocks of the smallest source at least, while blocks have words to give


def shares(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Targets of sources (one row each: source, size): adds place, weight and target.

    Sources stand by code point, null last, and weigh ``weights`` in turn. The total of all sizes is shared by weight; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    With sources in the order of cap per weight, the level is the first at which the next source stays below its cap.
    """
    everything = W.orderBy("source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "size", rank.cast("long").alias("place"), turn.cast("double").alias("weight"))
    s = s.withColumn("_cap", most * F.col("size")).withColumn("_total", F.sum("size").over(everything).cast("double"))
    s = s.withColumn("_weights", F.sum("weight").over(everything))
    by_cap = W.orderBy(F.col("_cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_nth", F.row_number().over(by_cap)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.col("_level") * F.col("weight") <= F.col("_cap")
    s = s.withColumn("_at", F.min_by("_level", F.when(fits, F.col("_nth"))).over(everything))
    return s.select("source", "size", "place", "weight", F.least(F.col("_cap"), F.col("_at") * F.col("weight")).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], entity: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Seats by highest quotients votes / (2 n + 1); ``seats`` holds the group's number in each of its rows.

    Rounding each quota gives the allocation of a house whose size misses the asked one by some d; a house of d more
    (fewer) seats differs from it by at most d per entity, so only the quotients around the quota are ranked. Ties go
    to the entity that comes first.
    """
    w = W.partitionBy(*group)
    total = F.sum(votes).over(w)
    q = F.when(total > 0, F.floor(F.col(votes) / total * F.col(seats) + 0.5)).otherwise(0).cast("long")
    d = df.withColumn("_q", q).withColumn("_d", F.abs(F.col(seats) - F.sum("_q").over(w)))
    d = d.withColumn("_d", F.when(F.sum(votes).over(w) > 0, F.col("_d")).otherwise(0))
    d = d.withColumn("_base", F.greatest(F.col("_q") - F.col("_d"), F.lit(0)))
    d = d.withColumn("_win", F.when(F.col("_d") > 0, F.col(seats) - F.sum("_base").over(w)).otherwise(0))
    asks = F.when(F.col("_d") > 0, F.sequence(F.col("_base"), F.col("_q") + F.col("_d") - 1)).otherwise(F.array().cast("array<bigint>"))
    c = d.select(*group, *entity, votes, "_win", F.explode(asks).alias("_n"))
    best = W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_n") + 1)).desc(), *entity, "_n")
    won = c.withColumn("_r", F.row_number().over(best)).where("_r <= _win").groupBy(*group, *entity).agg(
        F.count(F.lit(1)).alias("_won"))
    base = F.when(F.col("_d") > 0, F.col("_base")).otherwise(F.col("_q"))
    return d.join(won, [*group, *entity], "left").withColumn(out, base + F.coalesce("_won", F.lit(0))).drop(
        "_q", "_d", "_base", "_win", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 32,
        shard_words: int = 1 << 16, seed: int = 20, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source, source_size, target, taken, and how often the
    document counts as a whole (copies): by its middle word where a shard's run is less than half of it, else rounded.

    Sizes count words; a null or empty text has none. A source's documents are dealt to shards of about ``shard_words``
    words by seeded hashes and stand in a seeded order there; shards stand in groups, at most ``GROUPS`` a source. A shard is
    cut into equal blocks of about ``block_words`` words, fewer if the smallest source has less than ``SOURCE_BLOCKS`` such
    blocks, down to one word: so a small source comes within a word of its target. All blocks the mix takes go to sources,
    each source's to its groups, and each group's to its shards, by highest quotients; a shard with quota q and n blocks takes all blocks q div n times
    and q mod n neighbouring blocks, from a seeded one on and around the end, once more. No block is taken more than
    ``most`` times. Equal inputs give equal results, however they are partitioned; rows that repeat a document stand side
    by side. A null source is a source of its own, and last. An empty table, or one without words, takes nothing.
    ``key`` names the document: a seeded hash of its id and text.
    """
    key = _key(seed, doc_id, text)
    sized = written(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), key.alias("_h"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    sources = shares(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    every = W.partitionBy(F.lit(0))
    total, smallest = F.sum("size").over(every), F.min(F.when(F.col("size") > 0, F.col("size"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(smallest, F.lit(0)) / SOURCE_BLOCKS))).cast("long")
    sources = sources.withColumn("_block", block).withColumn("_house", F.round(total / F.col("_block")).cast("long")).withColumn("_one", F.lit(0))
    shards = F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words))
    sources = sainte_lague(sources, ["_one"], ["place"], "target", "_house", "_blocks").select(
        F.col("source").alias("_source"), "place", F.col("size").alias("source_size"), "target", "_blocks", "_block",
        F.least(F.lit(GROUPS), shards).alias("_groups"), F.ceil(shards / F.least(F.lit(GROUPS), shards)).alias("_each"))
    sources = written(sources, "mix-sources")
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["_source"])).withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), "_groups")).withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit(seed + 4), "_h"), "_each") * F.col("_groups") + F.col("_group"))
    shards = written(placed.groupBy("place", "_group", "_shard", "_blocks", "_block").agg(F.sum("size").alias("_words")), "mix-shard-sizes")
    groups = shards.groupBy("place", "_group", "_blocks").agg(F.sum("_words").alias("_group_words"))
    groups = sainte_lague(groups, ["place"], ["_group"], "_group_words", "_blocks", "_share").select("place", "_group", "_share")
    shards = sainte_lague(shards.join(groups, ["place", "_group"]), ["place", "_group"], ["_shard"], "_words", "_share", "_quota")
    n = F.greatest(F.lit(1), F.round(F.col("_words") / F.col("_block")).cast("long"))
    shards = shards.withColumn("_n", n).withColumn("_quota", F.least("_quota", most * F.col("_n")))
    shards = shards.withColumn("_all", F.floor(F.col("_quota") / F.col("_n"))).withColumn("_more", F.col("_quota") % F.col("_n"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "place", "_shard"), F.col("_n"))
    edge = lambda j: F.expr(f"({j}) * _words div _n")
    shards = shards.withColumn("_first", first).select(
        "place", "_shard", "_all", (2 * F.col("_more") < F.col("_n")).alias("_short"), edge("_first").alias("_lo1"), edge("least(_first + _more, _n)").alias("_hi1"),
        edge("greatest(_first + _more - _n, 0)").alias("_hi2"))
    order = W.partitionBy("place", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = placed.withColumn("_to", F.sum("size").over(order)).withColumn("_from", F.col("_to") - F.col("size"))
    d = d.join(written(shards, "mix-shards"), ["place", "_shard"])
    once = F.greatest(F.lit(0), F.least("_to", "_hi1") - F.greatest("_from", "_lo1"))
    around = F.greatest(F.lit(0), F.least("_to", "_hi2") - F.col("_from"))
    taken = (F.col("_all") * F.col("size") + once + around).cast("long")
    twice = F.col("_from") + F.col("_to")
    inside = lambda lo, hi: ((twice >= 2 * F.col(lo)) & (twice < 2 * F.col(hi))).cast("long")
    middle = F.col("_all") + inside("_lo1", "_hi1") + (twice < 2 * F.col("_hi2")).cast("long")
    copies = F.when(F.col("_short"), middle).otherwise(F.round(taken / F.greatest(F.col("size"), F.lit(1)))).cast("long")
    return d.select("doc_id", F.col("_h").alias("key"), "size", "source", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 20, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as ``mix`` counts it as a whole; all columns stay.

    Documents stay whole. A run starts at each block of its shard equally likely. Where it is less than half of the shard, a
    document is taken with its middle word, so over the seeds one of any length gets quota / blocks copies on average; for
    documents of up to two runs this is the same as rounding. Longer runs round: there a document of more than twice the
    words that the run leaves out is always taken. Rows that repeat a document share its copies evenly, by a seeded order
    where these do not divide. A document that is not taken is left out.
    """
    m = mix(docs, seed=seed, doc_id=doc_id, text=text, **options).where("size > 0")
    copies = m.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_n"), F.count(F.lit(1)).alias("_rows")).where("_n > 0")
    copies = written(copies.select("_key", F.expr("_n div _rows").alias("_each"), (F.col("_n") % F.col("_rows")).alias("_over")), "mix-copies")
    given, place = numbered(docs)  # given columns may have any names
    keyed = given.withColumn("_key", _key(seed, place[doc_id], place[text])).join(broadcast_if(copies, 32 * copies.count()), "_key")
    if not copies.where("_over > 0").isEmpty():  # at most the documents at the ends of runs
        row = F.xxhash64(F.lit(seed + 3), *given.columns)
        nth = F.row_number().over(W.partitionBy("_key").orderBy(row))
        odd = keyed.where("_over > 0").withColumn("_each", F.col("_each") + (nth <= F.col("_over")).cast("long"))
        keyed = keyed.where("_over = 0").unionByName(odd)
    return keyed.where("_each > 0").select(
        *given.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_each")).alias("_nth")).drop("_nth").toDF(*docs.columns)


def _key(seed: int, doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
