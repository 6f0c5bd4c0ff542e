import os

import duckdb
import pytest

from quarrymill import tables
from quarrymill.plans import catalogue

DATA = os.environ.get("QUARRYMILL_TEST_DATA", "/root/testdata/sf0.001")


def cell(v):
    return "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = [tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in tables.NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(rows) == sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
