"""Every query that has SQL against DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
OWN = [n for n in E.queries() if not n.startswith("op") or n.startswith("ocr")]
NAMES = [n for n in OWN if n != "pipeline"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in E.oracle_sql():
        assert rows
        return
    r = duck.execute(E.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in columns]
    assert sorted(repr([norm(x) for x in row]) for row in rows) == sorted(repr([norm(row[i]) for i in at]) for row in r.fetchall())
