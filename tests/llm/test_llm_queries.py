"""Every training-data query: SQL where there is some, empty tables, doubled tables with nulls and clashing columns."""

import glob
import math
import os

import duckdb
import pytest

from lodestrand.llm.queries import QUERIES, SQL


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(norm, r)) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, emptied, name):
    assert QUERIES[name](spark, emptied).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_and_null_rows(spark, doubled, data, name):
    once, twice = QUERIES[name](spark, data), QUERIES[name](spark, doubled)
    assert once.columns == twice.columns
    a, b = once.distinct().count(), twice.distinct().count()
    assert b >= a > 0 or name in ("p4_groups",) and b > 0
