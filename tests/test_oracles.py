"""Every registered query against its SQL twin, at the scale of the correctness gate."""

import os

import compare
import pytest

import __spark_entry__ as entry_points
from probestats.plans.catalog import all_queries
from probestats.plans.oracles import all_oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, con, name):
    rows = QUERIES[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.differences(rows, con, ORACLES[name]) is None


def test_only_model_fits_lack_sql():
    own = set(all_queries())
    assert own - set(ORACLES) == {"k_sweep"}
    assert not set(ORACLES) - set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["feature_pos", "n_case", "n_ctrl", "d", "p_ks", "fdr_bh"]
    assert rows.count() == 64
