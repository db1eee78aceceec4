"""Every registered query against its SQL counterpart on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    assert rows
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
        assert _sorted(rows) == _sorted(want)
