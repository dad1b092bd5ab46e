"""Pruning of candidates before a sweep of weights."""

import itertools
import random

import pytest

from hoptrail.operators import constraints as C


def cheapest(rows, ranges):
    """Least cost per (weights, test, golden) over all candidates."""
    out = {}
    axes = [range(ranges.get(r, (1, 1))[0], ranges.get(r, (1, 1))[1] + 1) for r in C.SWEPT]
    for w in itertools.product(*axes):
        for test, golden, l10, l7, *n in rows:
            cost = (l10, l7, sum(a * b for a, b in zip(n, w)))
            key = (w, test, golden)
            out[key] = min(out.get(key, cost), cost)
    return out


@pytest.mark.parametrize("ranges", [{}, {C.SWEPT[0]: (0, 4)}, {C.SWEPT[0]: (1, 5), C.SWEPT[1]: (0, 3), C.SWEPT[-1]: (2, 6)}])
def test_lower_front_keeps_what_may_be_cheapest(spark, ranges):
    rng = random.Random(len(ranges))
    rows = list({(f"t{rng.randint(1, 4)}", rng.random() < 0.4, rng.choice([0, 0, 1]), rng.choice([0, 0, 0, 2]),
                  *[rng.randint(0, 9) for _ in C.SWEPT]) for _ in range(600)})
    names = ["n_alias_link", "n_type_c", *[f"n_{r}" for r in C.SWEPT]]
    df = spark.createDataFrame(rows, "test string, golden boolean, " + ", ".join(f"{n} bigint" for n in names))
    kept = [tuple(r) for r in C.lower_front(df, ranges).select("test", "golden", *names).collect()]
    assert set(kept) <= set(rows) and cheapest(kept, ranges) == cheapest(rows, ranges)
    assert len(kept) < len(rows) / 3


def by_hand(facts):
    """Violations by nested loops over the distinct facts."""
    f = sorted(set(facts), key=str)
    n = {}
    add = lambda m, rule: n.update({(m, rule): n.get((m, rule), 0) + 1})
    of = lambda m, p: [x for x in f if x[0] == m and x[1] == p]
    for m in {x[0] for x in f}:
        al, lk, ob = ([x for x in of(m, p) if x[2] is not None and x[3] is not None] for p in ("alias", "link", "offbyone"))
        for a, l in itertools.product(al, lk):
            for u, w in ((l[2], l[3]), (l[3], l[2])):
                if (a[2], a[3]) == (u, w):
                    add(m, "alias_link")
        ends = [(u, w, out) for x in al for u, w, out in ((x[2], x[3], True), (x[3], x[2], False))]
        for o in ob:
            x, y = o[2:4]
            for a in al:
                if a[2:4] == (x, y):
                    add(m, "offbyone_alias")
            for (u, z, out), (v, z2, fwd) in itertools.product(ends, ends):
                if u == x and v == y and z == z2 and (out or not fwd):
                    add(m, "offbyone_alias")
            if not any(l[2:] == (y, x, "1") for l in lk):
                for t, r in itertools.product(of(m, "tr"), of(m, "rr")):
                    if t[2] == x and r[2] == y and r[3] in (1, 2) and t[4] is not None and t[4] == r[4]:
                        add(m, "offbyone_link")
        for x in of(m, "type"):
            if x[4] in ("c", "h", "n"):
                add(m, f"type_{x[4]}")
        for x in of(m, "badAlias") + of(m, "badNotAlias"):
            add(m, {"mercatorsource": "bad_alias_merc", "name": "bad_alias_name"}.get(x[4], "bad_alias"))
    return n


def test_violations_by_hand_and_without_a_join_per_rule(spark):
    rng = random.Random(4)
    ip = lambda: rng.choice([1, 1, 2, 2, 3, 4, 5, None])
    made = {"alias": lambda: (ip(), ip(), rng.choice(["rule", "name", None])), "link": lambda: (ip(), ip(), rng.choice(["1", "2", None])),
            "offbyone": lambda: (ip(), ip(), rng.choice(["", "x"])), "tr": lambda: (ip(), rng.choice([None, 1]), rng.choice(["a", "b", None])),
            "rr": lambda: (ip(), rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None])), "type": lambda: (ip(), None, rng.choice("chna")),
            "badAlias": lambda: (ip(), ip(), rng.choice(["mercatorsource", "name", "ally", None])), "other": lambda: (ip(), None, "mpls")}
    facts = [(f"m{rng.randint(1, 6)}", p, *made[p]()) for p in rng.choices(list(made), k=500)] + [("quiet", "other", 1, None, "mpls")]
    df = spark.createDataFrame(facts, "model string, pred string, a1 bigint, a2 bigint, a3 string")
    found = C.violations(df)
    assert {(r.model, r.rule): r.n for r in found.collect()} == by_hand(facts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    cost = {r.model: r.l10 + r.l7 + r.l5 for r in C.model_cost(df).collect()}
    want = by_hand(facts)
    assert cost == {m: sum(x for (k, _), x in want.items() if k == m) for m in {x[0] for x in facts}}
