"""Queries of the subpackage against their oracle SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quernstone.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, DATA)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cell = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 8) if isinstance(x, float) else x
    rows = lambda got, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in got), key=repr)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)
