"""Token encoding, counts, records and packing against the plain tokenizer."""

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hoptrail.llm import counts, packing, records
from hoptrail.llm.tokens import Encoder

key = lambda x: (x is None, x if x is not None else 0)


@pytest.fixture(scope="module")
def enc(tokenizer_path):
    return Encoder(tokenizer_path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'st .,!?\n\t 　\x85\x1c1é<|>", max_size=40), max_size=5))
def test_cut_encoding_is_exact(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    global _pair
    if "_pair" not in globals():
        _pair = Encoder(path), Tokenizer.from_file(path)
    got = _pair[0].encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [_pair[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_special_token_in_text(enc, ids_of):
    for t in ("a<|endoftext|> b", "<|endoftext|>", " <|endoftext|>  x", "y <|endoftext|>"):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids_of(t)


def test_small_cache_gives_the_same(enc, ids_of, monkeypatch):
    monkeypatch.setattr("hoptrail.llm.tokens.CACHE_ENTRIES", 3)
    for t in ("one two three four", "five six", "one two"):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids_of(t)


def test_counts(hard, hard_rows, tokenizer_path, ids_of):
    lengths = [len(ids_of(r[1])) for r in hard_rows]
    rows = counts.context_totals(counts.length_histogram(hard, tokenizer_path)).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        within = [x for x in lengths if x <= r.n_tokens]
        assert (r.docs_within, r.tokens_within) == (len(within), sum(within))
        assert (r.docs_beyond, r.tokens_beyond) == (len(lengths) - len(within), sum(lengths) - sum(within))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.quantile == len(within) / len(lengths)


def test_counts_for_any_limit(hard, hard_rows, tokenizer_path, ids_of):
    totals = counts.context_totals(counts.length_histogram(hard, tokenizer_path)).cache()
    lengths = sorted(len(ids_of(r[1])) for r in hard_rows)
    for limit in (0, 1, 7, 333, 10 ** 6):
        assert counts.at_limit(totals, limit).first().truncated_tokens == sum(min(x, limit) for x in lengths)
    assert counts.length_at(totals, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]


def test_counts_of_nothing(none, tokenizer_path):
    totals = counts.context_totals(counts.length_histogram(none, tokenizer_path))
    assert totals.count() == 0
    assert counts.at_limit(totals, 5).first().truncated_tokens == 0


def test_records_round_trip(hard, hard_rows, tokenizer_path, ids_of):
    index = records.write_records(hard, tokenizer_path, end_id=2)
    read = records.read_records(index).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4))
    rows = records.with_starts(read).orderBy("part", "seq", "record").collect()
    assert [r.doc_id for r in rows] == sorted([r[0] for r in hard_rows], key=lambda x: (x is not None, x or 0))
    want = defaultdict(list)
    for r in hard_rows:
        want[r[0]].append(ids_of(r[1]) + [2])
    start = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    assert not any(want.values())


def test_shuffled_reads_of_some_records(hard, tokenizer_path):
    index = records.write_records(hard, tokenizer_path, end_id=2)
    some = index.where("offset % 3 = 0").orderBy(F.rand(1))
    assert records.read_records(some).count() == some.count()


def test_null_ids_and_wide_tokens(hard, hard_rows, tokenizer_path):
    index = records.write_records(hard.limit(0).unionByName(hard), tokenizer_path, end_id=2)
    assert index.count() == len(hard_rows)
    data = records.frame(records.payload_of(None, np.array([1, 70000], np.uint32)))
    assert records.parse_payload(records.unframe(memoryview(data))) == (None, struct.pack("<II", 1, 70000))


def test_damage_is_found():
    data = bytearray(records.frame(records.payload_of(7, np.arange(5))))
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            records.unframe(memoryview(bytes(bad)))


def test_records_of_nothing(none, tokenizer_path):
    index = records.write_records(none, tokenizer_path, end_id=2)
    assert index.count() == 0 and records.read_records(index).count() == 0


def pack_of(docs, tokenizer_path, capacity=256):
    pieces = packing.cut_documents(docs, tokenizer_path, capacity, 0)
    return packing.pack(pieces, capacity)


def test_packing(hard, hard_rows, tokenizer_path, ids_of):
    rows = pack_of(hard, tokenizer_path).collect()
    want = Counter()
    for r in hard_rows:
        ids = ids_of(r[1]) + [0]
        first = len(ids) % 256 or 256
        edges = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * -(-total // 256) + 1


def test_packing_nothing(none, tokenizer_path):
    assert pack_of(none, tokenizer_path).count() == 0


def test_packing_keeps_columns(spark):
    pieces = spark.createDataFrame([(1, 5, "a", 9), (2, 3, "b", 9), (3, 8, "c", 9), (4, 5, "d", 9)], "doc_id long, length long, x string, rank int")
    rows = packing.pack(pieces, 8).collect()
    assert {r.x for r in rows} == set("abcd") and len({r.sequence_id for r in rows}) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_uses_every_piece_once(lengths):
    have = np.bincount(lengths, minlength=25) if lengths else np.zeros(25, np.int64)
    used = np.zeros(25, np.int64)
    for need, times in packing.plan(have, 24):
        assert times > 0 and sum(p * k for p, k in need.items()) <= 24
        for p, k in need.items():
            used[p] += k * times
    assert (used == have).all()


def test_plan_fills_exact_complements():
    have = np.zeros(101, np.int64)
    have[[60, 40]] = 7
    have[[50, 30, 20]] = 4
    have[[70, 10]] = 3, 9
    plan = packing.plan(have, 100)
    assert sum(t for _, t in plan) == -(-int((have * np.arange(101)).sum()) // 100)


def test_packing_with_clashing_columns(spark):
    names = ["length", "_task", "_local", "_rank", "_before", "_n", "sequence_id", "offset"]
    pieces = spark.createDataFrame([(1 + k % 9, *range(7)) for k in range(50)], ", ".join(f"{n} long" for n in names))
    out = packing.pack(pieces, capacity=10)
    assert out.columns == names[:6] + ["sequence_id", "offset"]
    rows = out.collect()
    assert len(rows) == 50 and all(tuple(r)[1:6] == (0, 1, 2, 3, 4) for r in rows)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 10


def test_pieces_end_before_every_kind_of_space(enc, ids_of):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{s} b{s}c {s}d e{s}{s} f" for s in spaces] + [f"é{s} \u2019 x\u200b y\u180e z" for s in spaces]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of(t) for t in texts]


def test_blocks_and_forgetting(tokenizer_path, ids_of, monkeypatch):
    import random

    monkeypatch.setattr("hoptrail.llm.tokens.CACHE_ENTRIES", 300)
    monkeypatch.setattr("hoptrail.llm.tokens.BLOCK_BYTES", 1000)
    rng, fresh = random.Random(6), Encoder(tokenizer_path)
    word = lambda: "".join(rng.choice("abcdeé<|>.\n") for _ in range(rng.choice([0, 1, 3, 8, 80, 300])))
    for _ in range(30):
        texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(6)] + ["x" * 3000 + " y", ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in fresh.encode(texts)] == [ids_of(t) for t in texts]
    assert len(fresh.keys) < 2000


def test_names_of_stores():
    from hoptrail.llm.common import file_system, pyarrow_uri

    assert [pyarrow_uri(f"{x}://bucket/folder/x") for x in ("s3a", "s3n", "s3", "hdfs")] == [
        f"{x}://bucket/folder/x" for x in ("s3", "s3", "s3", "hdfs")]
    assert file_system("file:/tmp/x")[1] == file_system("/tmp/x")[1] == "/tmp/x"
