import pytest

from __spark_entry__ import entry
from check_oracle import compare, connect
from ledgerloom.plans.checks import QUERIES
from ledgerloom.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_but_these_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"a11_describe_columns"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert not compare(spark, db, name, FOLDER).startswith("FAIL")


def test_entry(spark):
    assert entry(spark).count() > 0
