"""Every check query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from checks import ORACLES, QUERIES
from checks.compare import check, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 130


def no_row_python_and_no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in plan, banned


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = check(spark, duck, SMALL, name, no_row_python_and_no_cross_join)
    assert ok, note
