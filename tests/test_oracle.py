"""Every query that SQL can express gives the same rows as its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import database, rows, same

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns, got = rows(df.columns, df.collect())
    answer = con.execute(entry.oracle_sql()[name])
    expected_columns, want = rows([c[0] for c in answer.description], answer.fetchall())
    assert columns == expected_columns
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))] == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
