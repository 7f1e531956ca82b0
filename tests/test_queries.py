"""Every registered query that SQL can express, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pulselake import queries as Q


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if type(v).__name__ in ("date", "Timestamp", "datetime", "Decimal") else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, sf, db, name):
    got = Q.QUERIES[name](spark, sf)
    want = db.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_time_warping_query(spark, sf):
    assert Q.QUERIES["dtw_similarity"](spark, sf).filter("score < 0 or score > 1").count() == 0
