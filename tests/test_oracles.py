"""Every registered graph query with SQL has the rows that DuckDB gets from it."""

from __future__ import annotations

import duckdb
import pytest

from vialume import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def test_every_oracle_has_a_query():
    assert set(oracles.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
