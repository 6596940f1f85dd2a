"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from quirework.plans.registry import QUERIES
from quirework.plans.registry import SQL as TWINS

#: Order-dependent folds, tested elsewhere; every other query of the library has a SQL twin.
NO_TWIN = {
    "lines_to_markdown", "word_diff", "diff_highlights", "moved_text", "moved_highlights",
}

SF = "/root/testdata/sf0.001"
QS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QS))
def test_query(spark, con, name):
    res = compare(spark, con, SF, name, QS[name], SQL.get(name))
    # rows alone pass only where no SQL twin is possible
    assert res == "" or name in QUERIES.keys() - NO_TWIN and res == "empty" or (name not in QUERIES or name in NO_TWIN) and res.startswith("rows only"), res


def test_only_listed_queries_have_no_twin():
    assert set(QUERIES) - set(TWINS) == NO_TWIN


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QS)
