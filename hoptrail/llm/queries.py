"""Registered queries over the driver's tables, with the SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import align, counts, exact, jaccard, licenses, mixing, neighbours, packing, quality, records, spelling, substrings, warc
from .common import written

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, separator_id=0)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=2048)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeated(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda s, x: s + x)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), similarity=0.8)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.context_totals(counts.length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    digests = records.read_records(index).select(
        "part", "seq", "record", "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return records.with_starts(written(digests, "record-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_archives(warc.plan_records(_table(spark, sf_dir, "pages")))
    read = warc.read_archives(warc.locate_records(packages))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts_ = spelling.word_counts(_table(spark, sf_dir, "documents"), shortest=5, least=3, drop_one_in=97)
    return spelling.variants(counts_, factor=2)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.aligned_with_strength(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])
        WHEN len(w) >= 1 THEN [w] ELSE [] END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, k, p.n AS na, q.n AS nb FROM i JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b
      WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d),
t AS (SELECT d, min(m) AS class_id FROM r GROUP BY d),
k AS (SELECT a, count(*) AS n_links, count(*) FILTER (WHERE k = na AND k = nb) AS same FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(same, 0) + 1 AS n_copies
FROM documents JOIN t ON d = doc_id LEFT JOIN k ON k.a = doc_id"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, min(page_id) AS f FROM p WHERE strlen(t) >= 100 GROUP BY t HAVING count(*) > 1)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p LEFT JOIN g USING (t)"""

_ALL = [op1_source_mix, op2_quality, op3_best_fit_packing, op4_exact_dedup, op5_repeated_substrings, op6_ngram_jaccard,
        op7_token_counts, op8_token_records, op9_nn_descent, op10_warc,
        op11_spelling_variants, op12_token_alignment, op13_license_scan]


def _configured(fn):
    return lambda spark, sf_dir: fn(configure(spark), sf_dir)


QUERIES = {fn.__name__: _configured(fn) for fn in _ALL}
ORACLE = {"op4_exact_dedup": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op10_warc": OP10_SQL,
          "op13_license_scan": licenses.scan_sql()}
