"""Every registered query of the core with SQL against DuckDB at the smallest size, and the package without its llm part."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from graphloom.plans import graph_queries, problems  # noqa: E402

DATA = "/root/testdata/sf0.001"
CORE = {n: f for n, f in entry.queries().items() if n in {*problems.QUERIES, *graph_queries.QUERIES}}
ORACLE = {n: sql for n, sql in entry.oracle_sql().items() if n in CORE}

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


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    df = CORE[name](spark, DATA)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        rel = con.execute(ORACLE[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert mine == bag(names, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["a", "n_triangles"]


def test_nothing_outside_imports_llm():
    code = "import sys; sys.modules['graphloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'triangle_count' in q and len(q) == len({*e.problems.QUERIES, *e.graph_queries.QUERIES}), sorted(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "graphloom.llm" not in p.read_text(), p
