"""A training corpus from documents: filter, drop copies and near copies, mix sources, pack sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrail.llm import exact, jaccard, mixing, packing, quality
from hoptrail.llm.common import written
from hoptrail.llm.queries import tokenizer_path
from hoptrail.session import configure


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, configure(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    configure(spark)
    return exact.without_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    configure(spark)
    return jaccard.without_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    configure(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    configure(spark)
    pieces = packing.cut_documents(docs, tokenizer_path(), capacity=2048, separator_id=0)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", unlike),
          ("mixing sources", mixed), ("best-fit packing", packed)]

# Trees, hashes of signatures and tokenizers have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
