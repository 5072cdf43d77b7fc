"""Every registered query against its check SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck
from polyphon.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = dict(catalog.QUERIES)
CHECKS = dict(catalog.CHECKS)


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.instances > 0 and 0 <= row.accuracy <= 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, CHECKS[name]) == []
