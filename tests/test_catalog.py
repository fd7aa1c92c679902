"""Every registered query against its SQL on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

from nestfold.catalog import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    diff, _, _ = compare.difference(spark, con, name, SF)
    assert diff is None


def test_every_query_has_sql():
    assert sorted(set(QUERIES) - set(ORACLE)) == []


def test_entry_is_lazy_and_stable(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["rank", "listing_key", "tier", "score"]
    assert [r["rank"] for r in out.orderBy("rank").collect()] == list(range(1, 11))
