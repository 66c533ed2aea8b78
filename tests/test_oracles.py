"""Every query with an oracle gives the rows of its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_rows_equal_the_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(([plain(v) for v in row] for row in want.fetchall()), key=str)
    got = sorted(([plain(v) for v in row] for row in df.select(*columns).collect()), key=str)
    assert len(got) == len(want) and got
    for a, b in zip(got, want, strict=True):
        assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(SQL) <= set(entry.queries())
