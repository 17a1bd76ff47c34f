"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from quern.plans import REGISTRIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: query for r in REGISTRIES for name, query in r.queries.items()}
ORACLES = {name: sql for r in REGISTRIES for name, sql in r.oracles.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


def value(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    return repr(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)


def plain(frame):
    return sorted(tuple(map(value, row)) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_a_library(tmp_path):
    """Where the training-data operators cannot be imported, all other queries are there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), "False", "True"]
