"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def rows(columns, data):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return v if v is None or isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(SQL[name])
    want = rows([d[0] for d in want.description], want.fetchall())
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_names_are_unique_and_checked_names_are_queries():
    assert set(SQL) <= set(entry.queries())
