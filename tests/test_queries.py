"""Each registered query of the engine gives the rows that DuckDB gives on the unsharded tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from shardloom import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return f"{value.normalize():f}" if isinstance(value, Decimal) else str(value)


def in_order(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, tables, name):
    ours = queries.queries()[name](spark, FOLDER)
    theirs = tables.execute(queries.oracle_sql()[name])
    assert in_order(ours.columns, ours.collect()) == in_order([d[0] for d in theirs.description], theirs.fetchall())


def test_rows_only(spark):
    for name in queries.queries().keys() - queries.oracle_sql().keys():
        assert queries.queries()[name](spark, FOLDER).count() > 0
