"""Operators without an SQL twin against a plain reading of their rules, trace by trace."""

from collections import defaultdict

from hoptrail.operators import graph as G
from hoptrail.operators import infer as I
from hoptrail.operators import repair as R
from hoptrail.plans import infer as PI
from hoptrail.plans import tables as T


def _by_trace(rows):
    out = defaultdict(set)
    for r in rows:
        out[(r.src, r.dst)].add((r.ttl, r.resp, tuple(r.rr)))
    return out


def _moved(probes, p):
    """Probes of a trace with plain hops `p` once no lazy probe is left, and the number of rounds."""
    rounds = 0
    while True:
        lazy = sorted(x for x in probes if x[2] and (x[0] + 1, x[1]) in p and (x[0], x[1]) not in p
                      and not any(y[0] == x[0] + 1 and y[1] == x[1] for y in probes))
        if not lazy:
            return probes, rounds
        demark, rounds = lazy[0][2][-1], rounds + 1
        probes = {(t + 1, a, l) if demark in l else (t, a, l) for t, a, l in probes}


def test_lazy_rounds_in_one_trace(spark):
    """Six lazy routers behind one another, two of which share a demark; another trace has none."""
    probes = {(2 * k + 1, k, (100 + min(k, 4),)) for k in range(6)} | {(3, 50, (100, 102)), (20, 51, ())}
    p = {(2 * k + 2, k) for k in range(6)}
    want, rounds = _moved(probes, p)
    assert rounds > 3
    rr = spark.createDataFrame([(1, 2, *x) for x in probes] + [(1, 3, *x) for x in probes], "src bigint, dst bigint, ttl int, resp bigint, rr array<bigint>")
    tr = spark.createDataFrame([(1, 2, *x) for x in p], "src bigint, dst bigint, ttl int, resp bigint")
    got = _by_trace(R.lazy_routers(rr, tr)[0].collect())
    assert got == {(1, 2): want, (1, 3): probes}


def test_lazy_probes_move(spark, sf):
    rr, tr = T.rr_probes(spark, sf), T.tr_probes(spark, sf)
    plain = defaultdict(set)
    for r in tr.select("src", "dst", "ttl", "resp").distinct().collect():
        plain[(r.src, r.dst)].add((r.ttl, r.resp))
    traces = _by_trace(R.rr_set(rr).collect())
    moved = 0
    for key, probes in traces.items():
        traces[key], n = _moved(probes, plain[key])
        moved += n
    got, tags, fixed, level2 = R.lazy_routers(rr, tr)
    assert moved > 0 and level2.count() > 0 and fixed.count() > 0 and tags.count() > 0
    assert _by_trace(got.collect()) == traces


def _near(a, b):
    return b is not None and abs(a - b) == 1 and a >> 8 == b >> 8


def test_router_classes(spark, sf):
    rr = PI._rr(spark, sf).cache()
    tr = T.tr_probes(spark, sf).cache()
    stupid = {(r.src, r.dst) for r in R.stupid_routers(rr, tr).collect()}
    want, kinds = {}, {1: "A", 2: "B", 4: "N"}
    for key, probes in _by_trace(rr.collect()).items():
        if key in stupid:
            continue
        mask, hidden = {x[1]: 7 for x in probes}, defaultdict(bool)
        pairs, bad = [], False
        for t, a, l in probes:
            n1, n2 = _near(a, l[-1] if l else None), _near(a, l[-2] if len(l) > 1 else None)
            if n1 and not n2:
                mask[a] &= 5
            for t0, b, m in probes:
                if t0 != t - 1:
                    continue
                same = all(x == y for x, y in zip(l, m))
                if a == b or (same and len(l) - len(m) not in (-1, 0, 1, 2)):
                    bad = True
                if same:
                    pairs.append((t0, b, m, a, l, len(l) - len(m), not n1 or n2))
        if bad:
            continue
        zeros = {(t + 1, a, l) for t, b, m, a, l, d, _ in pairs if d == 0}
        for t, b, m, a, l, d, _ in pairs:
            if d == 2 or (t == 0 and d == 1):
                mask[a] &= 2
                mask[b] &= 1
            if d == 0 and len(l) < 9:
                mask[a] &= 5
                mask[b] &= 6
            if d == 0 and (t, b, m) in zeros:
                mask[b] &= 4
                mask[a] &= 5
        while True:
            new, hid = dict(mask), dict(hidden)
            for t, b, m, a, l, d, plus_b in pairs:
                if d == 1 and mask[b] in kinds and mask[a] not in kinds:
                    if mask[b] == 1:
                        new[a] &= 1 if hidden[b] else 5
                    elif plus_b:
                        new[a] &= 2
                        new[b] &= 6
                    else:
                        new[a] &= 1
                        hid[a] = True
                if d == 1 and mask[b] not in kinds and not mask[a] & 2:
                    new[b] &= 1
            if new == mask and all(hidden[k] == v for k, v in hid.items()):
                break
            mask = new
            hidden.update(hid)
        if 0 in mask.values():
            continue
        for a, m in mask.items():
            want[(*key, a)] = "HA" if m == 1 and hidden[a] else kinds.get(m, "U")
    got = {(r.src, r.dst, r.resp): r.type for r in I.classify_routers(rr, tr).select("src", "dst", "resp", I.type_name().alias("type")).collect()}
    assert len(set(want.values())) >= 4
    assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 2000 + i) for i in range(500)]
    c = G.connected_components(spark.createDataFrame(chain + hub, "ip1 bigint, ip2 bigint"))
    roots = {r.ip: r.root for r in c.collect()}
    assert all(roots[i] == 0 for i in range(301)) and all(roots[2000 + i] == 1000 for i in range(500))
    again = G.connected_components(c.selectExpr("root AS ip1", "ip AS ip2"))
    assert {r.ip: r.root for r in again.collect()} == roots


def test_best_of_linked_classes_is_symmetric(spark):
    a = spark.createDataFrame([(1, 2, "x"), (3, 2, "y"), (9, 9, "z")], "ip1 bigint, ip2 bigint, source string")
    t = {(r.ip1, r.ip2): (r.derived, r.sources) for r in G.transitive_aliases(a).collect()}
    assert t == {(1, 2): (False, ["x"]), (2, 3): (False, ["y"]), (1, 3): (True, ["x", "y"])}


def test_settled_pairs_are_those_of_all_pairs(spark, sf):
    rr = PI._rr(spark, sf)
    cols = ["src", "dst", "ttl", "resp1", "rr1", "resp2", "rr2", "delta", "same", "off", "plus_b"]
    want = I.path_pairs(rr).where("same OR resp1 = resp2").select(cols)
    got = I.settled_pairs(rr).select(cols)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()
