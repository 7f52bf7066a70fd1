"""Every query of the subpackage against its SQL on small tables; the others are tested in the files of their operators."""

import pytest

from clientscope.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
