"""Every registered query against its SQL twin on whole tables; queries without one must give rows."""

import pytest
from oracle import compare, connect

from gridscan.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert slow not in plan
    assert compare(spark, con, sf, lambda *_: df, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1
