"""Every catalog query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return str(value)
    return value


def rows(columns, records):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=lambda t: tuple((x is not None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = [dict(zip(names, r)) for r in res.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert rows(sorted(names), got) == rows(sorted(names), want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
