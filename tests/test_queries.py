"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*' if path.is_dir() else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (str, int, bool, date, datetime)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    names = sorted(frame.columns)
    ours = [tuple(plain(r[c]) for c in names) for r in frame.collect()]
    found = duck.execute(entry.oracle_sql()[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    wanted = [tuple(plain(dict(zip(theirs, r, strict=True))[c]) for c in names) for r in found.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(wanted, key=key)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_return_rows(spark, sf_dir):
    from foliant.plans import reference

    for name in reference.QUERIES.keys() - reference.ORACLE.keys():
        assert reference.QUERIES[name](spark, sf_dir).count() > 0
