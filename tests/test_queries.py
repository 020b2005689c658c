"""Every registered query against its SQL on the smallest data set."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallywright.plans import catalog, oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def _plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    assert rows, "no rows"
    assert _sorted(rows) == _sorted(expected)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
