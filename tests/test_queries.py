"""Every core query against its SQL, and over empty, doubled and null-ridden tables."""

import glob
import math
import os

import duckdb
import pytest

from lodestrand.plans import queries
from lodestrand.plans.queries import QUERIES, SQL


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(norm, r)) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.execute(SQL[name]).df())


ROWWISE = [n for n in sorted(QUERIES) if n not in ("packed_evidence", "direct_evidence", "scaled_corpus")]


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_tables(spark, emptied, name):
    n = QUERIES[name](spark, emptied).count()
    assert n == (1 if name == "mode_consistency" else 0)


@pytest.mark.parametrize("name", ["sentence_split", "entity_mentions", "p7_found", "token_f1", "heuristic_decompose", "given_facts", "doc_dedup", "mode_consistency"])
def test_repeated_and_null_rows(spark, doubled, data, name):
    once = QUERIES[name](spark, data)
    twice = QUERIES[name](spark, doubled)
    assert twice.columns == once.columns and twice.distinct().count() >= once.distinct().count() > 0


@pytest.mark.parametrize("name", ["packed_evidence", "direct_evidence"])
def test_evidence_answers_every_question(spark, tmp_path, monkeypatch, name):
    """All questions reach the pipeline, whatever their ids."""
    docs = [(1, "c", 0, "T", "Ada Byron came.")]
    spark.createDataFrame(docs, "doc_id long, corpus_id string, document_index int, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(7, "c", "Who came?"), (100, "c", "Who left?"), (101, "c", "Who came?"), (102, "c", None)]
    spark.createDataFrame(asked, "example_id long, corpus_id string, question string").write.parquet(f"{tmp_path}/per_example.parquet")
    monkeypatch.setattr(queries.pipeline, "answer", lambda index, rows, *a, **k: {"packed": rows})
    assert sorted(r.query_id for r in QUERIES[name](spark, str(tmp_path)).collect()) == [7, 100, 101]
