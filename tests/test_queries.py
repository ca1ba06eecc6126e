"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from docloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 4)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    run = db.execute(plans.ORACLES[name])
    names = [c[0] for c in run.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in run.fetchall())
    assert found == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
