"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
ROWS_ONLY = [n for n in queries() if n not in oracle_sql()]
FITS = [n for n in ROWS_ONLY if n.startswith(("ml_", "topk_", "score_"))]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n not in FITS])
def test_has_rows(spark, name):
    assert queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["epk", "top_category"] and df.count() > 0


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())
