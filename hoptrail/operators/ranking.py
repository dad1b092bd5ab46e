"""Ranks, running totals and distribution curves over whole tables, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_prefix_sum(df: DataFrame, order: list[str], amount: str, out: str = "cum", total: str = "total") -> DataFrame:
    """Inclusive running sum of ``amount`` in the order of ``order`` over the whole table.

    A range-partitioned sort is written to a checkpoint, so its partitions are fixed; sums inside partitions are then
    shifted by the totals of the partitions before them. Only one row per partition meets in one task.
    """
    runs = cut_lineage(df.sort(*order)).withColumn("_run", F.spark_partition_id())
    inside = W.partitionBy("_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per_run = runs.groupBy("_run").agg(F.sum(amount).alias("_s"))
    before = W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    shift = per_run.select(
        F.col("_run"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"),
        F.sum("_s").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(total),
    )
    return (
        runs.withColumn("_in", F.sum(amount).over(inside)).join(shift, "_run")
        .withColumn(out, F.col("_in") + F.col("_before")).drop("_run", "_in", "_before")
    )


def global_rank(df: DataFrame, order: list, out: str = "rank", total: str = "total") -> DataFrame:
    """0-based rank of every row in the order of ``order``; the columns should make the order unique."""
    runs = (
        cut_lineage(df.sort(*order)).withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_run", F.shiftright("_id", 33)).withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    per_run = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_s"))
    before = W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    shift = per_run.select(
        F.col("_run"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"),
        F.sum("_s").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(total),
    )
    return runs.join(shift, "_run").withColumn(out, F.col("_pos") + F.col("_before")).drop(
        "_id", "_run", "_pos", "_before"
    )


def cdf(df: DataFrame, value: str, complementary: bool = False, min_delta: float = 1e-4) -> DataFrame:
    """(value, p) of the empirical distribution; a point is kept when p moved by more than ``min_delta``.

    Equal values are counted first, so the sort handles distinct values only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    c = global_prefix_sum(counted, ["value"], "n")
    step = (F.floor(F.lit(min_delta) * F.col("total")) + 1).cast("bigint")
    low = (F.floor((F.col("cum") - F.col("n")) / step) + 1).cast("bigint") * step
    points = c.withColumn("_step", step).withColumn("_low", low).where("_low <= cum").select(
        F.col("value").cast("double"), "total", F.explode(F.sequence("_low", "cum", "_step")).alias("i")
    )
    frac = F.col("i") / F.col("total")
    body = points.select("value", (1 - frac if complementary else frac).alias("p"))
    first = df.sparkSession.range(1).select(
        F.lit(0.0).alias("value"), F.lit(1.0 if complementary else 0.0).alias("p")
    )
    return first.unionByName(body)


def ccdf(df: DataFrame, value: str, min_delta: float = 1e-4) -> DataFrame:
    return cdf(df, value, True, min_delta)


def rank_curve(df: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Sorted values against rank fraction, one row per input row."""
    r = global_rank(df.select(value, *tie), [value, *tie])
    return r.select(*tie, F.col(value).alias("value"), ((F.col("rank") + 1) / F.col("total")).alias("fraction"))


def batch_rows(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """Packs rows, in key order, into numbered batches of ``size``."""
    return global_rank(df, key).withColumn("batch", F.floor(F.col("rank") / size).cast("bigint")).drop("rank", "total")


def random_shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sample_n(df: DataFrame, n: int, key: Column | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows at random. With a ``key`` the choice depends on the row only, so reruns agree."""
    order = F.rand(seed) if key is None else F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)
    return df.withColumn("_o", order).orderBy("_o").limit(n).drop("_o")


def one_per_prefix(df: DataFrame, ip: str, bits: int = 24) -> DataFrame:
    """One host (the lowest address) per prefix of the given length."""
    net = F.shiftleft(F.shiftright(F.col(ip), 32 - bits), 32 - bits)
    return df.groupBy(net.alias("net")).agg(F.min(ip).alias(ip))


def n_combinations(items: DataFrame, col: str, n: int, by: list[str] | None = None) -> DataFrame:
    """All n-element combinations of the listed items (of each group ``by``), each in ascending order.

    Items are ranked; a combination is a rising sequence of ranks, so each further element is generated from the rank
    before it and then looked up by rank.
    """
    by = by or []
    d = items.select(*by, col).distinct()
    if by:
        w = W.partitionBy(*by).orderBy(col)
        last = W.partitionBy(*by)
        ranked = d.withColumn("rank", F.row_number().over(w) - 1).withColumn("total", F.count(F.lit(1)).over(last))
    else:
        ranked = global_rank(d, [col])
    out = ranked.select(*by, F.col(col).alias("i1"), F.col("rank").alias("r"), "total")
    for k in range(2, n + 1):
        nxt = ranked.select(*by, F.col(col).alias(f"i{k}"), F.col("rank").alias("r"))
        out = out.where("r + 1 < total").withColumn("r", F.explode(F.sequence(F.col("r") + 1, F.col("total") - 1))).join(nxt, [*by, "r"])
    return out.drop("r", "total")
