"""Token counts: an exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, texts_of, written
from .tokens import encoder

BUCKET = 64


def length_histogram(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length, written. A null or empty text has length 0.

    Each task counts its own lengths, so a length that many documents share is one row per slice before the shuffle.
    """
    def count(batches):
        enc = encoder(tokenizer_path)
        for b in slices(batches):
            n = Counter(len(x) // 4 for x in enc.encode(texts_of(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())],
                                             names=["n_tokens", "n_docs"])

    lengths = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return written(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every length in use as a context limit: documents and tokens within it, beyond it, and after truncation.

    Columns: n_tokens (the limit), n_docs (of exactly this length), docs_within, tokens_within, docs_beyond,
    tokens_beyond, truncated_tokens (each document cut to the limit), quantile (share of documents within the limit).
    An empty histogram gives no rows. Sums run inside buckets of ``BUCKET`` lengths and over one row per bucket.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"),
                         F.floor(F.col("n_tokens") / BUCKET).alias("_b"))
    after = W.orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    whole = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    buckets = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s")).select(
        "_b", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d_after"),
        F.coalesce(F.sum("_s").over(after), F.lit(0)).alias("_s_after"),
        F.sum("_d").over(whole).alias("_d_all"), F.sum("_s").over(whole).alias("_s_all"))
    inside = W.partitionBy("_b").orderBy("n_tokens").rowsBetween(1, W.unboundedFollowing)
    j = h.withColumn("_di", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn(
        "_si", F.coalesce(F.sum("_t").over(inside), F.lit(0))).join(buckets, "_b")
    beyond, tokens = F.col("_di") + F.col("_d_after"), F.col("_si") + F.col("_s_after")
    return j.select(
        "n_tokens", "n_docs", (F.col("_d_all") - beyond).alias("docs_within"), (F.col("_s_all") - tokens).alias("tokens_within"),
        beyond.alias("docs_beyond"), tokens.alias("tokens_beyond"),
        (F.col("_s_all") - tokens + F.col("n_tokens") * beyond).alias("truncated_tokens"),
        ((F.col("_d_all") - beyond) / F.col("_d_all")).alias("quantile"))


def at_limit(totals: DataFrame, limit: Column | int) -> DataFrame:
    """One row of totals for any context limit, in use as a length or not: from the longest length within it."""
    limit = F.lit(limit)
    within = F.col("n_tokens") <= limit
    return totals.agg(
        F.coalesce(F.max(F.when(within, F.col("docs_within"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.max(F.when(within, F.col("tokens_within"))), F.lit(0)).alias("tokens_within"),
        F.coalesce(F.max(F.col("docs_within")), F.lit(0)).alias("docs")).withColumn(
        "truncated_tokens", F.col("tokens_within") + limit * (F.col("docs") - F.col("docs_within")))


def length_at(totals: DataFrame, quantile: float) -> DataFrame:
    """One row (n_tokens): the smallest length that at least the share ``quantile`` of documents stays within."""
    return totals.where(F.col("quantile") >= quantile).agg(F.min("n_tokens").alias("n_tokens"))
