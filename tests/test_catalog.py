import os
from pathlib import Path

import pytest

from normlattice.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(names, found):
    show = lambda x: repr(round(x, 9)) if isinstance(x, float) else str([show(y) for y in x]) if isinstance(x, list) else str(x)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalog.ORACLES[name])
    assert got == rows([d[0] for d in found.description], found.fetchall())
