"""Source mixing and the quality classifier."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hoptrail.llm import mixing, quality

N_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds a cap is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


@pytest.fixture(scope="module")
def many_sources(spark):
    rng = random.Random(1)
    rows = []
    for k in range(900):
        s = rng.choice(["big"] * 6 + ["a", "B", "é", None, "tiny"])
        n = rng.randint(0, 5) if s == "tiny" else rng.randint(0, 400)
        rows.append((k, " ".join(["w"] * n), s))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_mix(many_sources):
    rows, df = many_sources
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_hand(sizes)
    got = mixing.mix(df, shard_words=4000).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 16 + 0.005 * t + 2 * 32, (s, taken[s], t)


@pytest.mark.parametrize("sizes", [(40_000, 14, 5), (1, 2, 3, 100), (50, 60_000, 7, 1, 30_000)])
def test_small_sources_meet_their_targets(spark, sizes):
    rows = []
    for s, total in enumerate(sizes):
        while total:
            n = min(total, 1 + (17 * len(rows)) % 90)
            rows.append((len(rows), "w " * n, f"s{s}"))
            total -= n
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = mixing.mix(df, shard_words=2000).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(taken) == len(sizes) and all(abs(r.t - r.target) <= 3 for r in taken), taken


def test_many_shards_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 3)
    rows = [(k, "w " * (k % 50), "ab"[k % 5 == 0]) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, shard_words=500).collect()
    assert len(got) == 800 and all(0 <= r.taken <= 3 * r.size for r in got)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target


def test_clashing_columns_of_the_mix(many_sources):
    _, df = many_sources
    clash = df.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(["_key", "_each", "_over", "_nth", "_n", "size"])])
    count = lambda d: sorted((r.doc_id, r["count"]) for r in d.groupBy("doc_id").count().collect())
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and count(out) == count(mixing.mixed_documents(df))
    assert out.where("_key != 0 OR _each != 1 OR _over != 2 OR _nth != 3 OR _n != 4 OR size != 5").isEmpty()


def test_mix_reruns_agree(many_sources):
    _, df = many_sources
    rows = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "target", "taken").collect()))
    assert rows(df) == rows(df.repartition(3, "text")) == rows(df.orderBy(F.rand(4)))


def test_long_documents_are_mixed_as_often_as_short_ones(spark):
    """A tenth of a source is wanted; half of its words stand in documents longer than a run of blocks."""
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * (3000 if k < 60 else 30)), "b") for k in range(60 + 6000)]
    rows += [(10_000 + k, " ".join(["v"] * rng.randint(1, 300)), "a") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    options = {"weights": (19, 1), "shard_words": 4000}
    target = mixing.mix(df, **options).where("source = 'b'").first().target
    assert 0.05 < target / 360_000 < 0.2
    long = words = 0
    for seed in range(20, 24):
        got = mixing.mixed_documents(df.select("doc_id", "text", "source"), seed=seed, **options).where("source = 'b'").collect()
        words += sum(len(r.text) // 2 + 1 for r in got)
        long += sum(r.doc_id < 60 for r in got)
    share = target / 360_000
    assert abs(long - 240 * share) <= 4 * (240 * share) ** 0.5
    assert 0.5 < words / (4 * target) < 1.5


def test_repeated_rows_share_copies_evenly(spark):
    """Rows of one document fill most of a source of which a tenth is wanted."""
    rows = [(7, " ".join(["w"] * 20), "b")] * 400 + [(k, " ".join(["v"] * 100), "a") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    options = {"weights": (19, 1), "shard_words": 4000}
    target = mixing.mix(df, **options).where("source = 'b'").first().target
    got = mixing.mixed_documents(df, **options).where("source = 'b'").count()
    assert 0 < target < 8000 * 0.4 and abs(got * 20 - target) <= 64


def test_mix_of_hard_rows(hard, hard_rows):
    got = mixing.mix(hard).collect()
    assert len(got) == len(hard_rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    sizes = defaultdict(int)
    for r in hard_rows:
        sizes[r[3]] += len(N_WORDS.findall(r[1] or ""))
    assert {r.source: r.source_size for r in got} == dict(sizes)
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes.values()), rel=0.02)


def test_mix_without_words(spark, none):
    assert mixing.mix(none).count() == 0
    d = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(d).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(d).count() == 0


def seats_by_quotients(votes, seats):
    have = dict.fromkeys(votes, 0)
    for _ in range(seats):
        have[max(sorted(votes), key=lambda e: votes[e] / (2 * have[e] + 1))] += 1
    return have


def test_sainte_lague(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        votes = {e: rng.choice([0.0, 1.0, rng.random() * 9, 100 * rng.random()]) for e in range(rng.randint(1, 9))}
        seats = rng.randint(0, 60) if sum(votes.values()) else 0
        rows += [(g, e, v, seats) for e, v in votes.items()]
        want |= {(g, e): n for e, n in seats_by_quotients(votes, seats).items()}
    df = spark.createDataFrame(rows, "g int, e int, votes double, seats long")
    got = {(r.g, r.e): r.n for r in mixing.sainte_lague(df, ["g"], ["e"], "votes", "seats", "n").collect()}
    assert got == want


def test_mixed_documents(many_sources):
    rows, df = many_sources
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(df).where("size > 0").collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(got.get(k, 0) - v) <= 0.5 for k, v in taken.items())


def test_mix_runs_no_python(many_sources):
    plan = mixing.mix(many_sources[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", None, "Plain words, and more of them.\nSecond line!", "x " * 500, "é" * 90, "|||", "\n\n", "A", "same line\nsame line\nother"]
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    together = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(together).all() and np.allclose(alone, together)
    named = dict(zip(quality.FEATURES, together[8]))
    assert named["distinct_lines"] == pytest.approx(2 / 3) and named["bytes"] == pytest.approx(np.log1p(25))
    named = dict(zip(quality.FEATURES, together[3]))
    assert named["repeats_previous"] == pytest.approx(499 / 500) and named["top_word"] == 1 and named["distinct_words"] == pytest.approx(1 / 500)


def tree_by_hand(model, row):
    total = model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    s = model.score(x[2000:])
    assert ((s > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(s[:50], [tree_by_hand(model, r) for r in x[2000:2050]])
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x[:5]), 0.5)
    assert (quality.fit(x[:50], np.ones(50)).score(x[:5]) > 0.9).all()


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', int(id % 7)) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = lambda l: sorted(map(tuple, quality.classify(docs, l).collect()))
    assert rows(labels) == rows(other)


def test_quality_of_hard_rows(hard, hard_rows, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (11, 0)], "doc_id long, quality int")
    rows = quality.classify(hard, labels).collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.classify(none, labels).count() == 0 and quality.classify(hard, labels.limit(0)).count() == len(hard_rows)
    kept = quality.good_documents(hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.good_documents(none, labels).count() == 0
