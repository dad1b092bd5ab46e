"""Ordered work along series (per address, connection, hop) that stays bounded when one series holds most rows.

Rows are sorted by (keys, order) with a range-partitioned sort, which splits a long series over many partitions
("runs"). Windows then work inside (series, run), and what crosses a run border is carried by one summary row per
(series, run).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def in_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return cut_lineage(df.sort(*keys, *order)).withColumn("_run", F.spark_partition_id())


def _carried(runs: DataFrame, keys: list[str], summary, carry) -> DataFrame:
    """One row per (series, run) that has earlier runs: the carry over the summaries before it."""
    w = W.partitionBy(*keys).orderBy("_run")
    s = runs.groupBy(*keys, "_run").agg(summary.alias("_s"))
    return s.select(*keys, "_run", carry(F.col("_s"), w).alias("_carry")).where("_carry IS NOT NULL")


def numbered(runs: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds a row's place along its series, from 0; only rows straight from `in_runs` have their places."""
    d = runs.withColumn("_i", F.monotonically_increasing_id())
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    s = d.groupBy(*keys, "_run").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    s = s.select(*keys, "_run", (F.col("_first") - F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_zero"))
    return d.join(s, [*keys, "_run"]).withColumn(out, F.col("_i") - F.col("_zero")).drop("_i", "_zero")


def lag_over(runs: DataFrame, keys: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """Adds the previous row's values: ``cols`` maps column -> new name."""
    w = W.partitionBy(*keys, "_run").orderBy(*order)
    pack = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    carried = _carried(runs, keys, F.max_by(pack, F.struct(*order)), lambda s, wk: F.lag(s).over(wk))
    d = runs.withColumn("_p", F.lag(pack).over(w)).withColumn("_n", F.row_number().over(w))
    d = d.join(carried, [*keys, "_run"], "left")
    prev = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_p"))
    d = d.withColumn("_prev", prev)
    for n in cols.values():
        d = d.withColumn(n, F.col("_prev")[n])
    return d.drop("_p", "_n", "_carry", "_prev")


def running_sum(runs: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Inclusive running sum along each series."""
    w = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = _carried(
        runs, keys, F.sum(col), lambda s, wk: F.sum(s).over(wk.rowsBetween(W.unboundedPreceding, -1))
    )
    d = runs.withColumn("_in", F.sum(col).over(w)).join(carried, [*keys, "_run"], "left")
    return d.withColumn(out, F.col("_in") + F.coalesce("_carry", F.lit(0))).drop("_in", "_carry")


def running_min(runs: DataFrame, keys: list[str], order: list[str], col: str, out: str, inclusive: bool = True) -> DataFrame:
    """Minimum of the rows so far; without ``inclusive`` the current row is left out (null on a first row)."""
    w = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    carried = _carried(
        runs, keys, F.min(col), lambda s, wk: F.min(s).over(wk.rowsBetween(W.unboundedPreceding, -1))
    )
    d = runs.withColumn("_in", F.min(col).over(w)).join(carried, [*keys, "_run"], "left")
    return d.withColumn(out, F.least("_in", "_carry")).drop("_in", "_carry")


def last_known(runs: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Latest non-null value up to and including the current row."""
    w = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    newest = F.max_by(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"))),
                      F.when(F.col(col).isNotNull(), F.struct(*order)))
    carried = _carried(
        runs, keys, newest, lambda s, wk: F.last(s, ignorenulls=True).over(wk.rowsBetween(W.unboundedPreceding, -1))
    )
    d = runs.withColumn("_in", F.last(col, ignorenulls=True).over(w)).join(carried, [*keys, "_run"], "left")
    return d.withColumn(out, F.coalesce("_in", F.col("_carry")["v"])).drop("_in", "_carry")


def next_known(runs: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Earliest non-null value from the current row on."""
    w = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    oldest = F.min_by(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"))),
                      F.when(F.col(col).isNotNull(), F.struct(*order)))
    carried = _carried(
        runs, keys, oldest, lambda s, wk: F.first(s, ignorenulls=True).over(wk.rowsBetween(1, W.unboundedFollowing))
    )
    d = runs.withColumn("_in", F.first(col, ignorenulls=True).over(w)).join(carried, [*keys, "_run"], "left")
    return d.withColumn(out, F.coalesce("_in", F.col("_carry")["v"])).drop("_in", "_carry")


def nearest_known(runs: DataFrame, keys: list[str], order: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """As-of merge: adds for each column its latest value up to a row and its earliest from there on, all in one pass.

    ``cols`` maps column -> (name of the latest, name of the earliest). Both windows share one sort, and what crosses
    the borders of runs is one row per (series, run) for all columns together.
    """
    inside = W.partitionBy(*keys, "_run").orderBy(*order)
    back, ahead = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(0, W.unboundedFollowing)
    across = W.partitionBy(*keys).orderBy("_run")
    ends, carried, d = [], [], runs
    for k, (c, (before, after)) in enumerate(cols.items()):
        known, at = F.col(c).isNotNull(), F.struct(*order)
        ends += [F.max_by(F.when(known, F.col(c)), F.when(known, at)).alias(f"_l{k}"),
                 F.min_by(F.when(known, F.col(c)), F.when(known, at)).alias(f"_f{k}")]
        carried += [F.last(f"_l{k}", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias(f"_b{k}"),
                    F.first(f"_f{k}", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)).alias(f"_a{k}")]
    for c, (before, after) in cols.items():
        d = d.withColumn(before, F.last(c, ignorenulls=True).over(back)).withColumn(after, F.first(c, ignorenulls=True).over(ahead))
    borders = runs.groupBy(*keys, "_run").agg(*ends).select(*keys, "_run", *carried)
    d = d.join(borders, [*keys, "_run"])
    for k, (before, after) in enumerate(cols.values()):
        d = d.withColumn(before, F.coalesce(before, f"_b{k}")).withColumn(after, F.coalesce(after, f"_a{k}"))
    return d.drop(*[f"_{x}{k}" for k in range(len(cols)) for x in "ba"])


def _fill(batches, col: str, out: str):
    """Fills `col` forward along rows of one (file, split) as they come from the scan; null before its first value."""
    held, before, last = None, (None, None), -1
    for b in batches:
        if not b.num_rows:
            continue
        file, split, row, value = (b.column(c) for c in ("file", "_split", "_row", col))
        same = np.r_[(file[0].as_py(), split[0].as_py()) == before,
                     pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(split[1:], split[:-1])).to_numpy(zero_copy_only=False)].astype(bool)
        place = row.to_numpy()
        if (np.diff(place, prepend=last) < 0)[same].any():
            raise ValueError("lines have to come straight from the scan, in their order")
        at = np.arange(len(place))
        newest = np.maximum.accumulate(np.where(value.is_valid().to_numpy(zero_copy_only=False), at, -1))
        began = np.maximum.accumulate(np.where(same, -1, at))      # -1: the row still belongs to the batch before
        take = np.where(newest >= np.maximum(began, 0), newest, np.where(began < 0, len(at), -1))
        pool = pa.concat_arrays([value, pa.array([held], value.type)])
        filled = pool.take(pa.array(take, mask=take < 0))
        held, before, last = filled[-1].as_py(), (file[-1].as_py(), split[-1].as_py()), int(place[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, filled], names=[*b.schema.names, out])


def last_known_of_lines(df: DataFrame, col: str, out: str, split, row) -> DataFrame:
    """`last_known` along `file` for lines straight from a file scan: no sort, no checkpoint.

    ``split`` is the offset of a line's split in its file and ``row`` grows along the split, in the order in which the
    rows come. Each split is filled as it streams by; only lines before the first value of their split take it from the
    splits before, of which one row each is kept. The scan is read again for these lines and for that summary.
    """
    d = df.withColumn("_split", split.cast("bigint")).withColumn("_row", row.cast("bigint"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    filled = d.mapInArrow(lambda batches: _fill(batches, col, out), f"{ddl}, `{out}` {d.schema[col].dataType.simpleString()}")
    known = F.col(col).isNotNull()
    tails = d.groupBy("file", "_split").agg(F.max_by(F.when(known, F.col(col)), F.when(known, F.col("_row"))).alias("_tail"))
    before = W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select("file", "_split", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    late = filled.where(F.col(out).isNull()).join(carry, ["file", "_split"]).withColumn(out, F.col("_carry"))
    cols = [*df.columns, out]
    return filled.where(F.col(out).isNotNull()).select(cols).unionByName(late.select(cols))
