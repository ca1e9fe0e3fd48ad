import math

import duckdb
import pytest

from fieldwarden.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got or name in ("constraint_dates",)
    if name in ORACLE_SQL:
        result = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
        assert got == want
