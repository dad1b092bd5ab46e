"""Exact copies, repeated byte strings and similar documents against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hoptrail.llm import exact, jaccard, substrings
from hoptrail.llm.words import distinct, shingles_of, words_of

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates(hard, hard_rows):
    groups = defaultdict(list)
    for r in hard_rows:
        groups[(r[1] or "").translate(ASCII)].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(hard).collect())
    assert got == want


def test_without_copies(hard, hard_rows):
    rows = exact.without_copies(hard).collect()
    assert rows[0].__fields__ == hard.columns
    texts = Counter((r.text or "").translate(ASCII) for r in rows)
    assert texts.keys() == {(r[1] or "").translate(ASCII) for r in hard_rows} and set(texts.values()) == {1}
    assert {r.doc_id for r in rows if r.text == hard_rows[11][1].upper()} == {23}


def test_hash_collisions_do_not_join_texts(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    real = exact._hashed

    def colliding(batches, with_text):
        for b in real(batches, with_text):
            for name in ("h1", "h2"):
                b = b.set_column(b.schema.get_field_index(name), name, pa.array([0] * b.num_rows))
            yield b

    monkeypatch.setattr(exact, "_hashed", colliding)
    assert {(r.doc_id, r.keep_id) for r in exact.exact_duplicates(d).collect()} == {(1, 3), (2, 2), (3, 3)}


@pytest.mark.parametrize("fn", [exact.exact_duplicates, exact.without_copies, jaccard.without_similar,
                                substrings.remove_repeated, jaccard.similar_documents])
def test_empty_table(none, fn):
    assert fn(none).count() == 0


def removed_by_brute_force(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        yield gone


def check_removed(df, rows, length):
    want = Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for r, t, gone in zip(rows, texts, removed_by_brute_force(texts, length)):
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        want[(r[0], len(t), tuple(edges[::2].tolist()), tuple(edges[1::2].tolist()), np.frombuffer(t, np.uint8)[~gone].tobytes())] += 1
    got = Counter((r.doc_id, r.n_bytes, tuple(r.begins), tuple(r.ends), bytes(r.kept)) for r in substrings.remove_repeated(df, length).collect())
    assert got == want


@pytest.mark.parametrize("class_rows", [2048, 2])
def test_repeated_substrings(hard, hard_rows, class_rows, monkeypatch):
    monkeypatch.setattr(substrings, "CLASS_ROWS", class_rows)
    check_removed(hard, hard_rows, 200)


def test_repeated_substrings_without_broadcast(hard, hard_rows, monkeypatch):
    monkeypatch.setattr(substrings, "broadcast_if", lambda df, size, most=0: df)
    check_removed(hard, hard_rows, 160)


def test_repeated_substrings_of_few_letters(spark):
    """Texts over two letters overlap, repeat inside themselves and share odd parts."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(100, 260))) for _ in range(6)]
    rows = [(k, "".join(rng.choice(pool)[rng.randint(0, 30):] for _ in range(rng.randint(1, 5)))) for k in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 199), (102, "a" * 200), (103, "b" * 201), (104, "abc" * 150 + "x" + "abc" * 150)]
    check_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 200)


def shingle_set(text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar_by_brute_force(rows, similarity=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
             for i in range(len(rows))]
    return sets, links


def classes_of(links):
    root = list(range(len(links)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, js in enumerate(links):
        for j in js:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(links))]


@pytest.mark.parametrize("block", [256, 3])
def test_similar_documents(hard, hard_rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [r for r in hard_rows if r[0] is not None]
    sets, links = similar_by_brute_force(rows)
    root = classes_of(links)
    least = defaultdict(lambda: 1 << 60)
    for r, c in zip(rows, root):
        least[c] = min(least[c], r[0])
    want = Counter((r[0], least[c], len(l), 1 + sum(sets[j] == sets[i] for j in l)) for i, (r, c, l) in enumerate(zip(rows, root, links)))
    members = jaccard.similar_documents(hard.where("doc_id IS NOT NULL"))
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in members.collect())
    assert got == want
    assert max(n for _, _, n, _ in want) > 20


def test_few_long_sets_in_several_blocks(spark, monkeypatch):
    """Pairs and triples whose shingles make more blocks than there are sets, so that blocks stay empty."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)
    rows = []
    for k in range(12):
        base = [f"c{k}w{j}" for j in range(100)]
        rows += [(10 * k + j, " ".join(base + [f"end{j}"])) for j in range(2 + k % 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(d).collect()}
    assert got == {i: (i // 10 * 10, 1 + i // 10 % 2) for i, _ in rows}


def test_rows_without_id(spark):
    t = "one two three four five six"
    d = spark.createDataFrame([(4, t), (None, t), (None, "other words"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(d).collect())
    assert got == Counter({(4, 4, 1): 1, (None, 4, 1): 1, (None, None, 0): 2})
    # texts without words all stay; of two rows without an id and with like texts one stays, after all rows with an id
    kept = Counter((r.doc_id, r.text) for r in jaccard.without_similar(d).collect())
    assert kept == Counter([(4, t), (None, "other words"), (None, None)])
    near = [(None, " ".join([f"w{j}" for j in range(60)] + [f"e{k}"])) for k in range(4)]
    assert jaccard.without_similar(spark.createDataFrame(near, "doc_id long, text string")).count() == 1


def test_words_that_defeat_polynomial_hashes(spark):
    twin = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    rows = [(1, twin), (2, twin.translate(str.maketrans("ab", "ba"))), (3, twin)]
    got = sorted(map(tuple, jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 1, 2), (2, 2, 0, 1), (3, 1, 1, 2)]


@pytest.mark.parametrize("names", [["_gone", "_again", "_nth", "key", "n_copies"], ["_key", "_each", "_over", "_first", "id"]])
def test_clashing_columns(hard, names):
    clash = hard.select("doc_id", "text", *[hard[c].alias(n) for c, n in zip(["h1", "lang", "size", "core", "sig"], names)])
    for fn in (jaccard.without_similar, exact.without_copies):
        out = fn(clash)
        assert out.columns == clash.columns
        plain = Counter((r.doc_id, r.text) for r in fn(hard).collect())
        assert Counter((r.doc_id, r.text) for r in out.collect()) == plain


def test_trees_that_meet(spark):
    rows = spark.createDataFrame([(k, f"w{k % 3} " * 3 + "a b c d e f g h", 1) for k in range(40)], "key long, text string, x int")
    described = jaccard._described(rows.select(rows.key.alias("doc_id"), "text", "key"))
    reps = described.withColumnRenamed("key", "id").where("id < 9")
    met = {r.id: r.trees for r in jaccard._shared_trees(reps, 6).collect()}
    assert set(met) == set(range(9)) and set(met.values()) >= {(1 << 32) - 1}
    alone = jaccard._shared_trees(reps.where("id = 0"), 6)
    assert alone.collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base, f"end{k}"])
    clean, other = " ".join(f"c{k}" for k in range(30)), [f"o{k}" for k in range(60)]
    rows = [(3, near(0)), (7, near(1)), (7, clean), (8, " ".join(other)), (8, " ".join(other + ["x"])), (8, " ".join(other)),
            (None, near(2)), (None, "alone without id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.similar_documents(d).collect())
    assert got == Counter({(3, 3, 2, 1): 1, (7, 3, 2, 1): 1, (7, 7, 0, 1): 1, (8, 8, 2, 2): 2, (8, 8, 2, 1): 1,
                           (None, 3, 2, 1): 1, (None, None, 0, 1): 1})
    kept = Counter((r.doc_id, r.text) for r in jaccard.without_similar(d).collect())
    assert [n for (i, _), n in kept.items() if i == 8] == [1]
    assert Counter({k: n for k, n in kept.items() if k[0] != 8}) == Counter([rows[0], rows[2], rows[7]])


def test_without_similar(hard, hard_rows):
    rows = jaccard.without_similar(hard.where("doc_id IS NOT NULL"))
    assert rows.columns == hard.columns
    kept = {r.doc_id for r in rows.collect()}
    given = [r for r in hard_rows if r[0] is not None]
    _, links = similar_by_brute_force(given)
    classes = defaultdict(set)
    for r, c in zip(given, classes_of(links)):
        classes[c].add(r[0])
    assert kept == {min(c) for c in classes.values()}


def test_recall_of_the_forest():
    assert jaccard.depth_for(0.8, 0.9999) == 6 and jaccard.recall(6, 0.8) > 0.9999 > jaccard.recall(7, 0.8)
    assert jaccard.depth_for(0.8, 0.9) > 6 and jaccard.depth_for(0.01, 0.9999999) == 1


def test_shingles_are_those_of_the_words():
    texts = ["", None, "a", "a b c d", "a b c d e", "a b c d e f a b c d e", "\ta\x0bb\n c  d\re\x0c", "é x y"]
    w = words_of(pa.array(texts))
    doc, h, _ = distinct(*shingles_of(w))
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(shingle_set(t)) for t in texts]
    assert h[doc == 4][0] in h[doc == 5] and h[doc == 6][0] == h[doc == 4][0]
