"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from papyra.sources.fixtures import BASE_TABLES
from tools.oracle_check import digest

from .conftest import SF_SMALL

NAMES = sorted(E.queries())
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    assert len(set(cols)) == len(cols)
    if name not in ORACLES:
        pytest.skip("no SQL oracle (rows-only check)")
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"type_name", "sample_count", "field_count", "is_new"} <= set(df.columns)
