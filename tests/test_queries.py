"""Every registered query against its SQL in DuckDB."""

import os

import pytest

from roadpulse.operators import aggregates
from roadpulse.plans import catalog, extracts, ingest, registry  # noqa: F401
from roadpulse.plans.testbed import Testbed

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        assert compare(df, con, registry.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_signals_are_chosen_among_plain_columns(spark):
    plan = Testbed(spark, SF).signals()._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" in plan and "map(" not in plan[plan.index("Window") :]


def test_a_summary_of_keyframes_sorts_its_boxes_once(spark):
    plan = aggregates.keyframe_summary(Testbed(spark, SF).perception())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
