"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from __spark_entry__ import queries as all_queries
from commitlens.plans.queries import QUERIES
from conftest import SF_SMALL

def queries():
    return QUERIES


TABLES = "customer part orders lineitem documents conversations pages".split()


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 9)) if not math.isnan(v) else "nan"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle():
    assert set(queries()) <= set(oracle_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _digest(df.columns, got) == _digest(ocols, want)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["word", "word_count", "rank", "bar_length"]
    assert df.count() > 0
