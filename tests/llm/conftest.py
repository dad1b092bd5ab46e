import random

import pytest

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long, h1 string, size string, core string, target int, sig int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows, shared passages; extra columns clash."""
    rng = random.Random(5)
    base, passage = words(rng, 120).split(), words(rng, 60)
    long = words(rng, 6000)
    texts = ["", None, " \t\n", "one", "one two three", "One Two Three", long, long + " end", "a" * 900, "é" * 300, "ab " * 400]
    texts += [" ".join(base)] * 12 + [" ".join(base).upper()]
    for k in range(12):
        near = list(base)
        near[k * 7 % 120] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(6)]
    texts += [words(rng, rng.randint(1, 300)) for _ in range(40)]
    texts += ["don't  stop\n\nnow <|endoftext|> é　ü \x85 x", "  lead", "trail  ", "a  b", "x" * 5000]
    rows = [(k, t, "en", ["s1", "s0", None, "s3"][k % 4] if k > 30 else "s1", k, "x", "y", "z", 1, 2) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, "no id", "en", "s1", 1, "x", "y", "z", 1, 2), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, DOC_DDL).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_DDL)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def ids_of(tokenizer_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids
