import random
import re

from hoptrail.llm import licenses

PHRASE_WORDS = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]


def words_of(text):
    return re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words_of(text)
    at = [(k, label) for label, p in PHRASE_WORDS for k in range(len(w)) if w[k:k + len(p)] == p]
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))


def by_id(df):
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_base_columns_of_hard_rows(hard, hard_rows):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(hard).collect()), key=str)
    assert got == sorted(((r[0], *base(r[1])) for r in hard_rows), key=str)


def test_random_texts(spark):
    rng = random.Random(2)
    pieces = ["MIT", "License", "license", "APACHE", "general", "public", "gnu", "mit-license", "ſ", "É", "x", "K", "2.0", "_", "\n", "licenſe"]
    rows = [(k, rng.choice([" ", "", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for k in range(500)]
    rows += rows[:5] + [(7, "the MIT license"), (None, "mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(
        ((i, *base(t)) for i, t in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_passages_with_changes(spark):
    notice = licenses.PASSAGES[0][1].split()
    filler = "nothing to see in these plain words at all ".split()
    edited = notice[:20] + ["really"] + notice[20:30] + notice[31:]
    rows = [(1, " ".join(filler * 9 + notice + filler * 9)), (2, " ".join(filler + edited)), (3, " ".join(notice[:20])),
            (4, " ".join(notice[:24] + filler * 5 + notice[24:])), (5, " ".join(filler * 50)), (6, " ".join(notice[::-1])),
            (7, "Licensed under CC BY-NC 4.0."), (8, " ".join(notice).upper()), (9, "of the software " * 40)]
    got = by_id(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [got[k].labels for k in range(1, 10)] == ["mit", "mit", "", "", "", "", "cc-by-nc", "mit", ""]
    assert got[1].score == got[8].score == 1.0 and 0.6 < got[2].score < 1 and 0 < got[3].score < 0.6 and got[5].score == 0
    assert all(got[k].base_labels == "" and got[k].n_base == 0 and got[k].first_word is None for k in got)
    found = {(r.doc_id, r.start, r.end) for r in licenses.spans(licenses.votes(
        spark.createDataFrame(rows, "doc_id long, text string"))).where("verified").collect()}
    assert (1, len(filler) * 9, len(filler) * 9 + len(notice)) in found


def test_a_phrase_repeated_many_times(spark):
    rows = [(1, "mit license " * 20_000), (2, "general public " * 500 + "license"), (3, "mit  \n license")] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.last_word) for r in got) == sorted(
        [(1, 20_000, 0, 39_998), (2, 1, 998, 998), (3, 1, 0, 0)] * 2)


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    row = licenses.scan(df, phrases=[("a", "two three")], passages=[("b", "two three four five six")]).first()
    assert (row.n_base, row.first_word, row.base_labels, row.labels) == (1, 1, "a", "a,b")


def test_no_python_workers(spark, hard):
    plan = licenses.scan(hard)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "MapInPandas"))


def test_empty(none):
    assert licenses.scan(none).collect() == []
