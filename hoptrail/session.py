"""Session helpers: local session for tests, reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Runtime settings the operators count on. A join whose result is grouped by its own keys would keep a hot key in one
# task unless skew handling may add a shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A number of shuffle partitions that does not grow with the input lets the memory of a task grow with it. Shuffles start
# with many small partitions, which adaptive execution joins up to the size below. Batches for Python are cut by bytes:
# 10000 whole texts are some 40 MB, which each task would hold several times outside the heap and in its worker.
UNLESS_SET = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings on a session the caller made; sizes and first partition numbers the caller set stay."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    for k, v in UNLESS_SET.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hoptrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HOPTRAIL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only where none is named (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hoptrail-ckpt-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plans growing in loops."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """As ``cut_lineage``, for tables of which later steps read some rows and columns each: Parquet beside the checkpoints. It is
    read in the session of ``df`` or another."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def keep_parts(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """As ``keep_table``, in so many files by the hash of the keys, which Spark knows: groups and joins by them need no shuffle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"parts_{uuid.uuid4().hex}"
    # only a table can have files by keys; its entry goes at once, the files stay beside the checkpoints. Columns get new names
    # and their own back: those read from a table carry its name, by which a union takes its sides' parts for different ones
    df.toDF(*[f"_{c}" for c in df.columns]).write.bucketBy(parts, *[f"_{k}" for k in keys]).option(
        "path", f"{spark.sparkContext.getCheckpointDir()}/{name}").option("compression", "zstd").saveAsTable(name, format="parquet")
    kept = spark.table(name).toDF(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return kept


# Where tables are ``dealt``: joins may use parts by some of their keys, and no filter of nulls is inferred, behind which a union would
# not see that its sides have the same parts.
DEALT_CONF = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.constraintPropagation.enabled": "false"}
# Rows of one key that a single task may get.
MOST = 1_000_000


def parts_for(rows: int) -> int:
    """Parts of 400 000 rows: sorts and maps take a page of memory each, however few rows a part has. Small tables get a few parts."""
    return 1 + max(min(rows // 50_000, 12), rows // 400_000)


class Keep(NamedTuple):
    """Keeps tables in parts by some keys, or as they are."""
    keys: list[str] = []
    parts: int = 0
    caller: SparkSession | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        """For rows that come from kept tables and lie in their parts already."""
        return keep_parts(df, self.keys, self.parts) if self.parts else keep_table(df)

    def deal(self, df: DataFrame) -> DataFrame:
        """For rows that lie anyhow: as in a join, where a small side would else decide how the large one is dealt out."""
        return self(df.repartition(self.parts, *self.keys) if self.parts else df)

    def result(self, df: DataFrame) -> DataFrame:
        """For what is handed out: a table of the caller's session."""
        return keep_table(df, self.caller)


def dealing_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of ``spark`` and DEALT_CONF: other threads may plan in the caller's."""
    other = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if other.conf.isModifiable(k):
            other.conf.set(k, v)
    for k, v in DEALT_CONF.items():
        other.conf.set(k, v)
    return other


def dealt(keys: list[str], *tables: DataFrame, distinct: bool = False) -> tuple:
    """Deals tables out by keys once: (``keep``, the tables). Groups and joins by these keys and others read the tables, and what
    ``keep`` makes of them, without a shuffle. They belong to a session of their own, so what is handed out is a ``keep.result``.

    Where a key has more than ``MOST`` rows, tables are kept as they are and each join deals out by all its keys.
    """
    spark = tables[0].sparkSession
    ensure_checkpoint_dir(spark)
    other = dealing_session(spark)
    whole = [keep_table(d, other) for d in tables]
    keep = Keep(keys, parts_for(sum(d.count() for d in whole)), spark)
    once = lambda d: d.distinct() if distinct else d
    ours = [keep(once(d.repartition(keep.parts, *keys))) for d in whole]
    most = max(d.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0 for d in ours)
    if most > MOST:
        for k in DEALT_CONF:
            other.conf.set(k, spark.conf.get(k))
        return Keep(caller=spark), *map(once, whole)
    return keep, *ours
