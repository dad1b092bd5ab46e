"""Nearest neighbours against brute force; WARC packages against their own rules and zipfile."""

import hashlib
import io
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hoptrail.llm import neighbours, warc
from hoptrail.llm.common import file_system, written


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    usual = Counter(len(v) for _, v in ok).most_common(1)[0][0]
    ok = [(i, v) for i, v in ok if len(v) == usual]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        if q in ids:
            s = x @ x[list(ids).index(q)]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def results(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, 2500)]
    rows = [(i, [float(f) for f in np.float32(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got, want = results(neighbours.nearest(df, F.col("id") % 50 == 0)), brute(rows, range(0, 2500, 50))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    exact = {q: dict(v) for q, v in want.items()}
    for q, found in got.items():
        assert found == sorted(found, key=lambda e: (-e[1], e[0]))
        assert all(s == pytest.approx(exact[q][i], abs=1e-12) for i, s in found if i in exact[q])


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 400)]
    rows += [(i, [float(f) for f in np.float32(rng.normal(size=4))]) for i in range(400, 460)]
    rows += [(500, None), (550, []), (600, [0.0] * 4), (650, [1.0, None, 0.0, 0.0]), (700, [float("nan"), 1.0, 1.0, 1.0]),
             (750, [float("inf"), 1.0, 1.0, 1.0]), (800, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (450, rows[450][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = results(neighbours.nearest(df, F.col("id") % 50 == 0)), brute([*dict(rows).items()], range(0, 801, 50))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def nodes_of(spark, x):
    rows = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(np.float32(x))], "vec_id long, embedding array<float>")
    return written(neighbours.distinct_vectors(neighbours.usable(rows.repartition(4)), 6, False), "nodes")


def test_rounds_go_on_until_lists_settle(spark, monkeypatch):
    """A start of few pairs (small blocks, two trees), so that the rounds must find the neighbours."""
    monkeypatch.setattr(neighbours, "BLOCK", 24)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 12))
    graph = neighbours.build(nodes_of(spark, x), k=20, trees=2)[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1)[:, :20]
    got = {r.node: set(r.others) for r in graph.collect()}
    share = sum(len(got[i] & set(want[i].tolist())) for i in range(len(x))) / want.size
    print("recall of the graph", share)
    assert share >= 0.97


def test_hub_is_dealt_to_groups(spark, monkeypatch):
    """A centre with thousands of noisy variants, all of them nearer to it than to each other."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=24)
    x = np.r_[[centre], centre + 0.3 * rng.normal(size=(3000, 24))]
    nodes = nodes_of(spark, x)
    graph = spark.createDataFrame([(i, [0], [0.9]) for i in range(1, len(x))], neighbours.GRAPH_DDL)
    whole = neighbours.whole_groups

    def bounded(batches):
        for t in whole(batches):
            assert np.unique(t.column(0).to_numpy(), return_counts=True)[1].max() <= 512, "a whole hub in one group"
            yield t

    monkeypatch.setattr(neighbours, "whole_groups", bounded)
    told = defaultdict(set)
    for r in neighbours._local_joins(graph, nodes, 20, 10).collect():
        told[r.node] |= {*r.others} - {0}
    assert all(len(told[i]) >= 9 for i in range(1, len(x)))  # all meet others at the hub, none is left out


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    got = results(neighbours.nearest(df, F.lit(True)))
    assert {q: len(v) for q, v in got.items()} == ({q: n - 1 for q in range(n)} if n > 1 else {})


PAGES = "page_id long, url string, html string, digest string, payload int, _first int"


@pytest.fixture(scope="module")
def pages():
    same, long = "s" * 150, "é<html>\r\n\r\n" * 30000
    rows = [(5, "http://a/", same), (3, "http://b/", same), (9, None, same), (3, "http://b/", same), (1, "u", "x" * 99), (2, "u", "x" * 99),
            (10, "u", None), (11, "line\r\nbreak", ""), (12, "http://é", long), (13, "v", long), (None, "n", same), (None, "n", "z" * 200),
            (None, "n", "z" * 200)] + [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 40)) for k in range(20, 120)]
    return [(*r, "d", 0, 1) for r in rows]


def test_packages(spark, pages):
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    listed = warc.write_archives(warc.plan_records(df))
    rows = warc.read_archives(warc.locate_records(listed)).collect()
    ids = defaultdict(list)
    for r in pages:
        ids[(r[2] or "").encode()].append(r[0])
    want = Counter()
    for r in pages:
        t = (r[2] or "").encode()
        first = min((i for i in ids[t] if i is not None), default=None) if len(t) >= 100 else None
        again = first is not None and r[0] != first
        want[(r[0], len(t), hashlib.sha256(t).hexdigest(), "revisit" if again else "response", first if again else None,
              None if again else t)] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in rows)
    assert got == want
    assert sum(r.n_records for r in listed.collect()) == len(pages)


def test_packages_open_with_zipfile(spark, pages):
    listed = warc.write_archives(warc.plan_records(spark.createDataFrame(pages, PAGES).coalesce(1)))
    fs, path = file_system(listed.first().file)
    with fs.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert set(z.namelist()) == {warc.ARCHIVE, warc.INDEX, warc.PACKAGE}


def test_small_packages_and_single_records(spark, pages, monkeypatch):
    df = spark.createDataFrame(pages, PAGES)
    spots = warc.locate_records(warc.write_archives(warc.plan_records(df))).orderBy(F.rand(3))
    assert warc.read_archives(spots.where("offset % 2 = 0")).count() == spots.where("offset % 2 = 0").count()


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    listed = warc.write_archives(warc.plan_records(none))
    assert listed.count() == 0 and warc.read_archives(warc.locate_records(listed)).count() == 0


def source(data):
    return pa.PythonFile(io.BytesIO(data), mode="r")


def test_zip64_directory(monkeypatch):
    """With zipfile's limits lowered every size, offset and count goes to the 64-bit fields."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("première", b"0123456789" * 3)
        z.writestr("second", b"abcdefgh")
        z.comment = b"a note"
    s = pa.BufferReader(out.getvalue())
    found = warc.directory(s)
    assert list(found) == ["première", "second"]
    for name, data in (("première", b"0123456789" * 3), ("second", b"abcdefgh")):
        at, n = warc.member_range(s, found, name)
        assert s.read_at(n, at) == data


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        warc.directory(pa.BufferReader(b"no archive here"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 1000)
    s = pa.BufferReader(out.getvalue())
    with pytest.raises(ValueError):
        warc.member_range(s, warc.directory(s), "x")
