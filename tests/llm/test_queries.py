"""The registered queries of this package against DuckDB at the smallest size."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        rel = con.execute(ORACLE[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert mine == bag(names, rel.fetchall())
