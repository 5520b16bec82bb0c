import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from seamstone.plans import queries as core
from tools.compare import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).iterdir():
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def holds(spark, duck, name):
    """Whether a query has the rows of its SQL."""
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr(tuple(norm(v) for v in row)) for row in cur.fetchall())
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    return sorted(repr(tuple(norm(r[c]) for c in cols)) for r in got.collect()) == want


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["context_id", "rel", "parent_ix", "ix", "val"]


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert holds(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
