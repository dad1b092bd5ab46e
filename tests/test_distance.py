"""Pairs of addresses within a distance, over several blocks."""

import itertools
import random

from hoptrail.operators import distance as D


def test_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    rng = random.Random(2)
    seen = {ip: {v: rng.randint(1, 50) for v in rng.sample("abcdefgh", rng.choice([1, 2, 3, 8]))} for ip in range(100, 190)}
    seen |= {ip: {f"far{ip % 3}": ip % 20} for ip in range(40)}   # no vantage in common with the others
    rows = [(v, ip, d) for ip, ds in seen.items() for v, d in ds.items()]
    out = D.pairs_within_distance(spark.createDataFrame(rows, "vantage string, ip bigint, d int"), 14)
    want = []
    for a, b in itertools.combinations(sorted(seen), 2):
        gaps = [abs(seen[a][v] - seen[b][v]) for v in seen[a].keys() & seen[b].keys()]
        if gaps and sum(gaps) / len(gaps) <= 14:
            want.append((a, b, sum(gaps) / len(gaps), len(gaps)))
    assert sorted(map(tuple, out.select("ip1", "ip2", "d", "n").collect())) == sorted(want) and len(want) > 500
