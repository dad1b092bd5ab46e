"""Tables dealt out by keys once, and the queries that read them without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from hoptrail import session
from hoptrail.operators import chains, constraints, infer
from hoptrail.operators import repair as R


def exchanges(df):
    """Shuffles of a plan that Spark would run now."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def shuffles(spark, monkeypatch):
    """Shuffles of each table that an operator keeps in parts; no join is broadcast."""
    seen, whole = [], session.keep_parts
    monkeypatch.setattr(session, "parts_for", lambda rows: 3)
    monkeypatch.setattr(session, "keep_parts", lambda df, *a: seen.append(exchanges(df)) or whole(df, *a))
    monkeypatch.setattr(session.Keep, "result", lambda self, df: seen.append(exchanges(df)) or session.keep_table(df, self.caller))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def traces(spark, n=400, seed=3):
    rnd = random.Random(seed)
    some = lambda *x: rnd.choice([*x, *x, *x, *x, None])
    rows = [(some(1, 2, 3), some(8, 9), some(*range(1, 7)), some(*range(1, 6), 9), [rnd.randrange(1, 4) for _ in range(rnd.randrange(4))]) for _ in range(n)]
    tr = [(some(1, 2, 3), some(8, 9), some(*range(1, 7)), some(*range(1, 6))) for _ in range(n // 8)]
    return (spark.createDataFrame(rows, "src bigint, dst bigint, ttl int, resp bigint, rr array<bigint>"),
            spark.createDataFrame(tr, "src bigint, dst bigint, ttl int, resp bigint"))


def facts(spark, n=300):
    rnd = random.Random(5)
    ip = lambda: rnd.randrange(1, 5)
    rows = [(f"m{rnd.randint(1, 4)}", p, ip(), ip() % 3 if p == "rr" else ip(), rnd.choice(["1", "name"]))
            for p in rnd.choices(["alias", "link", "offbyone", "tr", "rr", "badAlias"], k=n)]
    return spark.createDataFrame(rows, "model string, pred string, a1 bigint, a2 bigint, a3 string")


rows_of = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_dealt_tables_need_no_shuffle_and_the_callers_settings_stay(spark):
    old = {k: spark.conf.get(k) for k in session.DEALT_CONF}
    d = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), (F.col("id") % 50).alias("c"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        keep, x, y = session.dealt(["a", "b"], d, d.where("c < 9"), distinct=True)
        both = x.unionByName(y.where("c > 2")).distinct().join(y.select("a", "b", (F.col("c") + 1).alias("c")), ["a", "b", "c"], "left_anti")
        assert exchanges(both) == 0 and x.sparkSession.conf.get(threshold) == "-1"
        got = keep(both.groupBy("a", "b", "c").count())
        assert {k: spark.conf.get(k) for k in session.DEALT_CONF} == old    # other threads may plan meanwhile
    finally:
        spark.conf.set(threshold, before)
    assert not spark.catalog.listTables()
    near = {(r.a, r.b, r.c + 1) for r in d.where("c < 9 AND b IS NOT NULL").collect()}
    assert {(r.a, r.b, r.c) for r in got.collect()} == {(r.a, r.b, r.c) for r in d.distinct().collect()} - near


def test_a_key_with_many_rows_is_not_dealt(spark, sf, monkeypatch):
    import __spark_entry__ as e

    rr, tr = traces(spark)
    found = lambda: [rows_of(chains.trace_facts(chains.repair_chain(rr, tr))), rows_of(constraints.violations(facts(spark))),
                     *(rows_of(e.queries()[q](spark, sf)) for q in ("classify_routers", "paranoid_pairs"))]
    want = found()
    assert all(want)
    monkeypatch.setattr(session, "MOST", 1)
    keep, d, _ = session.dealt(["src"], rr, tr)
    assert not keep.parts and all(d.sparkSession.conf.get(k) == "true" for k in session.DEALT_CONF)
    assert found() == want


def test_violations_are_counted_where_facts_lie(spark, shuffles):
    found = constraints.violations(facts(spark))
    found.createOrReplaceTempView("found_here")     # the result is of the caller's session
    assert spark.table("found_here").count() == found.count()
    assert shuffles == [1, 0, 0]    # the facts, their tally, the result


def test_chain_of_repairs_stays_with_its_traces(spark, shuffles):
    chains.repair_chain(*traces(spark))
    # only the two inputs, responders of other traces, what goes on to be checked and those fixed are dealt out
    assert shuffles[:2] == [1, 1] and sum(n > 0 for n in shuffles) <= 5 and len(shuffles) > 10


def test_router_classes_stay_with_their_traces(spark, shuffles):
    infer.classify_routers(*traces(spark))
    assert shuffles[:2] == [1, 1] and not any(shuffles[2:]) and len(shuffles) > 5


def test_checked_pairs_stay_with_their_traces(spark, sf, shuffles):
    import __spark_entry__ as e

    e.queries()["paranoid_pairs"](spark, sf)
    assert shuffles[:2] == [1, 1] and sum(n > 0 for n in shuffles[2:]) == 1    # responders of other traces


def test_known_probes_of_dealt_tables(spark):
    rr, tr = traces(spark)
    rr = rr.where("src IS NOT NULL AND dst IS NOT NULL AND ttl IS NOT NULL AND resp IS NOT NULL")
    want = rows_of(R.known_probes(rr, tr))
    keep, x, y = session.dealt(["src", "dst"], rr, tr, distinct=True)
    assert rows_of(R.known_probes(x, y, keep)) == want
    assert any("in_tr=True" in r for r in want) and any("in_tr=False" in r for r in want)


def test_input_of_probes_is_made_once(spark, sf):
    from hoptrail.plans import repair, tables

    assert tables.recorded_hops(spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    d = repair._flaky_input(spark, sf)
    plain = tables.rr_probes(spark, sf)
    gaps = plain.where("part % 5 = 0 AND size(rr) >= 3").withColumn("rr", F.concat(F.slice("rr", 1, 1), F.expr("slice(rr, 3, size(rr))")))
    assert rows_of(d) == rows_of(plain.unionByName(gaps))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation") == plain._jdf.queryExecution().optimizedPlan().toString().count("Relation")
