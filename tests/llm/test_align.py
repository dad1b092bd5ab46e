import hashlib
import random
from collections import Counter

import pytest

from hoptrail.llm import align, tokens


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    entry = {i: e for e, i in a.get_vocab().items()}
    byte = align.byte_alphabet()
    return (a, lambda i: bytes(byte[c] for c in entry[i]), b,
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def brute(rows, tools):
    a, bytes_a, b, bytes_b = tools
    docs, counts = [], Counter()
    for i, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, x)) != whole or b"".join(map(bytes_b, y)) != whole:
            docs.append((i, 0, 0, [], ""))
            continue
        ends, at = [], 0
        for k, t in enumerate(x):
            at += len(bytes_a(t))
            ends.append((at, 0, k))
        at = 0
        for k, t in enumerate(y):
            at += len(bytes_b(t))
            ends.append((at, 1, k))
        ends.sort()
        groups, links, lo = [], [], (0, 0)
        for (e, _, k), (f, side, m) in zip(ends, ends[1:]):
            if e == f and side == 1:
                groups.append(",".join(map(str, x[lo[0]:k + 1])) + "|" + ",".join(map(str, y[lo[1]:m + 1])))
                links.append((x[k], y[m]))
                lo = (k + 1, m + 1)
        counts.update(links)
        docs.append((i, len(x), len(y), links, ";".join(groups)))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    return sorted(((i, n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, n_a, n_b, links, g in docs), key=str)


def got(df, paths):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in align.aligned_with_strength(df, *paths).select(*names).collect()), key=str)


ODD = ["  two  spaces  ", " lead", "trail ", "\n", "a\n\n b \t c", "<|endoftext|> <s> </s> <unk> <0x41> x", "space▁mark", "中文字 の é", "x\x00y",
       "　wide", "don't we'll I'd", "a" * 3000, "  ", " ", "\x85 x \x1c y", "🙂🙂 ok", "1234 5678,90", "\r\n\r\n z", "é ﬁ Å", "a  b"]


def test_hard_rows(hard, hard_rows, paths, tools):
    assert got(hard, paths) == brute([(r[0], r[1]) for r in hard_rows], tools)


def test_odd_texts(spark, paths, tools):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, paths) == brute(rows, tools)


def test_random_texts(spark, paths, tools):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("ab XY12 \n\t'.é中 ▁"[:15 + k % 2]) for _ in range(rng.randint(1, 60)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, paths) == brute(rows, tools)


def test_a_very_long_text_goes_in_parts(spark, paths, tools, monkeypatch):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(60_000))
    tool = align.Aligner(*paths)
    whole = list(next(tool.parts([text[:900_000]])))
    assert len(whole) == 1
    cut = list(tokens.long_pieces(text[:900_000], 10_000))
    assert len(cut) > 20 and " ".join(cut) == text[:900_000]
    rows = [(1, text * 5), (2, text[:500])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), paths) == brute(rows, tools)


def test_groups_are_given_on_demand(spark, paths, tools):
    df = spark.createDataFrame([(1, "unbelievable alignment"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in align.aligned(df, *paths, groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    a = tools[0].encode(" unbelievable alignment").ids
    assert [int(x) for g in rows[1].groups.split(";") for x in g.split("|")[0].split(",")] == a
    assert (rows[2].groups, rows[2].groups_sha256, rows[2].n_a) == ("", "", 0)


def test_common_ends():
    assert align.common_ends([1, 2, 3], [3, 3]) == [(2, 1), (3, 2)]
    assert align.common_ends([4, 2], [1, 3, 2]) == [(1, 2), (2, 3)]
    assert align.common_ends([], []) == []


def test_empty(none, paths):
    assert got(none, paths) == []
