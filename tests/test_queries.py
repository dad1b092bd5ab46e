"""Every registered query against its SQL twin over the whole tables; queries without a twin must give rows."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from compare import check, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# rows need a larger scale than the test's
MAY_BE_EMPTY = {"rr_full_pairs", "graph_subset", "graph_subset_links"}


@pytest.fixture(scope="module")
def outcomes(spark, sf):
    con = connect(sf)

    def run(name):
        try:
            return name, check(spark, con.cursor(), sf, name, QUERIES[name], ORACLE.get(name))
        except Exception as e:  # the test of that query reports it
            return name, (False, repr(e)[:2000], 0)

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    ok, message, _ = outcomes[name]
    assert ok, message
    assert name in MAY_BE_EMPTY or not message.startswith("0 rows"), "no rows compared"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["router", "degree", "rank", "pct"] and df.count() > 0


def test_twins_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
