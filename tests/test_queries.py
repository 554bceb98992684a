"""All registered queries of the library's own operators against their SQL, in one session."""

import os

import pytest

from compare import connect, differences
from larder.queries import ORACLES, QUERIES

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# The forest takes minutes whatever the scale; LARDER_ALL_QUERIES=1 runs it too.
SLOW = set() if os.environ.get("LARDER_ALL_QUERIES") else {"train_validate_forest"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == []


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)
