"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarrygrid import queries as grid


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)) or isinstance(v, int) and not isinstance(v, bool):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def sorted_rows(rows, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=lambda t: [(v is None, str(v)) for v in t])


@pytest.mark.parametrize("name", sorted(grid.SQL))
def test_query(spark, small, duck, name):
    df = grid.QUERIES[name](spark, small)
    out = duck.execute(grid.SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in out.fetchall()]
    assert sorted_rows([r.asDict() for r in df.collect()], sorted(names)) == sorted_rows(want, sorted(names))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
