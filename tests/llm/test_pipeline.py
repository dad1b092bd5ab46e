"""The corpus pipeline, stage by stage, against plain Python on each stage's own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from hoptrail.llm import mixing, quality
from hoptrail.llm.common import written
from test_dedup import ASCII, classes_of, similar_by_brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, hard_rows, tmp_path_factory):
    """The driver's small documents with hard rows among them."""
    path = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(1000 + r[0] if r[0] is not None else None, *r[1:5]) for r in hard_rows if r[0] is not None]
    docs = given.unionByName(spark.createDataFrame(rows, given.schema))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "step")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    assert all(columns == COLUMNS for columns, _ in steps[:-1])


def test_filter(spark, folder, steps):
    scores = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = Counter(r.doc_id for r in scores.collect() if r.score >= 0.3)
    assert Counter(r.doc_id for r in steps[1][1]) == good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1][1]}
    assert all(i in kept for i, q in labels.items() if q == 1)


def test_copies(steps):
    keep = defaultdict(list)
    for r in steps[1][1]:
        keep[(r.text or "").translate(ASCII)].append(r.doc_id)
    assert Counter(r.doc_id for r in steps[2][1]) == Counter(max(ids) for ids in keep.values())


def test_similar(steps):
    rows = [(r.doc_id, r.text) for r in steps[2][1]]
    least = {}
    for (i, _), c in zip(rows, classes_of(similar_by_brute_force(rows)[1])):
        least[c] = min(i, least.get(c, i))
    assert Counter(r.doc_id for r in steps[3][1]) == Counter(least.values())
    assert len(steps[3][1]) < len(rows)


def test_mixing(spark, steps):
    docs = spark.createDataFrame(steps[3][1], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({r.doc_id: int(np.floor(r.taken / r.size + 0.5)) for r in mixing.mix(docs).collect() if r.size})
    assert Counter(r.doc_id for r in steps[4][1]) == +want
    assert {tuple(r) for r in steps[4][1]} <= {tuple(r) for r in steps[3][1]}


def test_packing(steps, ids_of):
    want = Counter()
    for r in steps[4][1]:
        ids = ids_of(r.text) + [0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in steps[5][1]) == want
    places = defaultdict(list)
    for r in steps[5][1]:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.r_[0, np.cumsum([n for _, n in sorted(p)])[:-1]].tolist()
        assert sum(n for _, n in p) <= 2048


def test_run(spark, folder, steps):
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(steps[5][1])


def test_run_on_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
