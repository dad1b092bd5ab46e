"""What a task and its Python worker hold: batches bounded by bytes, texts sent once, free memory given back."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from hoptrail.llm import exact
from hoptrail.session import configure

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """2000 texts of 20 kB came to Python in one batch of 40 MB."""
    other = configure(spark.newSession())
    docs = other.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("word "), 4000).alias("text"))

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "n": [b.num_rows]})

    seen = docs.mapInArrow(measured, "size long, n long").collect()
    assert sum(r.n for r in seen) == 2000
    assert max(r.size for r in seen) < 5 << 20
    set_by_caller = spark.newSession()
    set_by_caller.conf.set(BYTES, "1m")
    assert configure(set_by_caller).conf.get(BYTES) in ("1m", str(1 << 20), f"{1 << 20}b")


def test_copies_leave_with_each_text_sent_once(spark, monkeypatch):
    """The text went to the worker twice, as itself and as the column to hash."""
    rows = [(1, "a" * 50, "x"), (2, "A" * 50, "y"), (3, None, "z"), (4, "", "w"), (5, "b", "v"), (5, "b", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    whole = exact._hashed

    def once(batches, *given):
        def seen():
            for b in batches:
                columns = [c.to_pylist() for c in b.columns]
                assert all(a != c for k, a in enumerate(columns) for c in columns[:k])
                yield b
        return whole(seen(), *given)

    monkeypatch.setattr(exact, "_hashed", once)
    assert sorted(map(tuple, exact.without_copies(docs).collect())) == [(2, "A" * 50, "y"), (4, "", "w"), (5, "b", "v")]


HELD = """
import re
import numpy as np, pyarrow as pa
from hoptrail.llm.common import slices
size = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
kept = [np.ones(60_000, np.uint8) for _ in range(4000)]
before = size()
kept = kept[::100]
for _ in slices(iter([pa.RecordBatch.from_pydict({"x": [1, 2, 3]})])):
    pass
print(before - size())
"""


def test_a_worker_gives_back_free_memory_between_pieces_in_use():
    """240 MB freed around a few arrays in use stayed with the worker when its task was over."""
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(exact.__file__).parents[2])
    assert int(done.stdout) > 150
