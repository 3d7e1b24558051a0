"""Corpus queries against their SQL twins, and that all of them are registered."""

import compare
import pytest

import __spark_entry__ as entry_points
from probestats.llm.queries import llm_oracles, llm_queries


@pytest.fixture(scope="module")
def con():
    return compare.duck("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(llm_queries()[name](spark, "/root/testdata/sf0.01"), con, llm_oracles()[name]) is None


def test_registered():
    names = set(entry_points.queries())
    assert {n.split("_")[0] for n in llm_queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(llm_queries()) | {"pipeline"} <= names
    assert set(llm_oracles()) <= set(entry_points.oracle_sql())
