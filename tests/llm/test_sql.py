from pathlib import Path

import duckdb
import pytest

from seamstone.llm import queries
from tools.compare import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    cur = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr(tuple(norm(v) for v in row)) for row in cur.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols) and sorted(repr(tuple(norm(r[c]) for c in cols)) for r in got.collect()) == want


def test_rates_follow_from_the_files(spark):
    bad = {r["file_id"] for r in queries.p3_found(spark, SF).collect()}
    rates = queries.p3_rates(spark, SF).collect()
    assert sum(r["n_unparsed"] for r in rates) == len(bad) > 0
    assert all(r["rate"] == round(r["n_unparsed"] / r["n_files"], 6) for r in rates)
