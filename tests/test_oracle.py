"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from readlake.plans import all_queries

QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if isinstance(v, int | str | bytes) else float(v)


def counted(rows, columns, names):
    at = [names.index(c) for c in columns]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert counted(rows, columns, df.columns) == counted(got.fetchall(), columns, names)
