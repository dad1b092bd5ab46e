import random
import re
import zlib
from collections import Counter

import pytest

from hoptrail.llm import spelling


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows, shortest=5, least=3, one_in=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            if one_in:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % one_in == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    form, count = {}, {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return rows


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_counts_of_hard_rows(hard, hard_rows):
    rows = [(r[0], r[1]) for r in hard_rows]
    for shortest, least, one_in in ((5, 3, 97), (2, 1, 3), (1, 1, None)):
        got = spelling.word_counts(hard, shortest, least, one_in).collect()
        assert {r.word: r.n for r in got} == brute_counts(rows, shortest, least, one_in)


def test_query_on_hard_rows(hard, hard_rows):
    counts = brute_counts([(r[0], r[1]) for r in hard_rows], 5, 2, 7)
    assert result(spelling.variants(spelling.word_counts(hard, 5, 2, 7))) == brute_variants(counts)


def test_letters_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_CHARS", 50)
    rows = [(1, "Élan ÉLAN élan naïve NAÏVE naive x×÷y Straße straße ﬁnes fünfzehn Ünfzehn " * 30), (2, "a" * 400 + " naive naíve 中文words"),
            (None, "naive nave naives"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = brute_counts(rows, 4, 1, 5)
    assert {r.word: r.n for r in spelling.word_counts(df, 4, 1, 5).collect()} == counts
    assert result(spelling.variants(spelling.word_counts(df, 4, 1, 5))) == brute_variants(counts)


def test_ties_chains_and_runs_of_letters(spark):
    n = {"aaaa": 3, "aaaaa": 6, "aaaaaa": 12, "aaaab": 6, "baaaa": 6, "aabaa": 24, "aacaa": 24, "zzzzz": 5, "abab": 1, "ab": 8,
         "bab": 4, "aba": 4, "a": 16, "": 32, "éaaaa": 1, "x": 40}
    df = spark.createDataFrame(list(n.items()) + [(None, 7)], "word string, n long")
    assert result(spelling.variants(df)) == brute_variants(n)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_random_words(spark, letters):
    rng = random.Random(3)
    n = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.randint(1, 40) for _ in range(400)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(7)
    assert result(spelling.variants(df)) == brute_variants(n)


def test_long_words(spark):
    rng = random.Random(4)
    n = {}
    for base in ("".join(rng.choice("abc") for _ in range(m)) for m in (46, 47, 48, 49, 60, 200)):
        n[base] = 50
        for _ in range(12):
            i, c = rng.randrange(len(base)), rng.choice("abcé")
            for w in (base[:i] + base[i + 1:], base[:i] + c + base[i + 1:], base[:i] + c + base[i:]):
                n[w] = n.get(w, rng.randint(1, 30))
    # a word and its complement whose plain polynomial hashes modulo 2**64 agree
    twin = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    n |= {twin: 9, twin.translate(str.maketrans("ab", "ba")): 2, twin[:-1]: 4}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert result(spelling.variants(df)) == brute_variants(n)


def test_empty(none):
    assert spelling.variants(spelling.word_counts(none)).collect() == []
