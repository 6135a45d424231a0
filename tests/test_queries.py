"""Every query that SQL can express gives DuckDB's rows."""

import pytest

from quernstone import plans
from tests.duck import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql()) | set(plans.UNLIKE_SQL)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, con, name):
    same(plans.queries()[name](spark, FOLDER), con, plans.oracle_sql()[name])


def test_all_verdicts_occur(spark):
    found = {(r.verdict, r.swing) for r in plans.queries()["advantage_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert {v for v, _ in found} == {"none", "jump", "tactic", "short", "ok"} and ("ok", True) in found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
