"""Every named query with an SQL form, against DuckDB on the same tables."""

import decimal
import math

import duckdb
import pytest

from pulsegrid.plans import all_queries

QUERIES, ORACLES = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(names, columns, rows):
    at = [columns.index(n) for n in names]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert rows_of(names, df.columns, df.collect()) == rows_of(names, columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_stream_ends_like_the_batch(spark, sf_dir):
    names = ["metric", "local_date", "count", "sum", "min", "max", "last"]
    batch = QUERIES["daily_rollup"](spark, sf_dir).select(*names)
    stream = QUERIES["streaming_rollup"](spark, sf_dir).select(*names)
    assert rows_of(names, names, stream.collect()) == rows_of(names, names, batch.collect())
