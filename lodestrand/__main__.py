"""``python -m lodestrand index CORPUS OUT`` and ``python -m lodestrand query INDEX QUESTION``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph, retrieval
from .plans import pipeline
from .sources import payloads


def main() -> None:
    parser = argparse.ArgumentParser(prog="lodestrand")
    verbs = parser.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index", help="build an index of a corpus payload (JSON, JSON Lines or Parquet)")
    index.add_argument("corpus")
    index.add_argument("out")
    index.add_argument("--corpus-id", default="main")
    query = verbs.add_parser("query", help="print the evidence of a question")
    query.add_argument("index")
    query.add_argument("question")
    query.add_argument("--corpus-id", default="main")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("lodestrand").getOrCreate()
    if args.verb == "index":
        rows = payloads.documents(payloads.read_objects(spark, args.corpus))
        docs = rows.select(F.lit(args.corpus_id).alias("corpus_id"), F.col("document_index").cast("long").alias("doc_id"), "document_index", "title", "text")
        payloads.write_index(graph.build(docs, encode=retrieval.hashed_encoder()), args.out)
    else:
        tables = {k: v.filter(F.col("corpus_id") == args.corpus_id) for k, v in payloads.read_index(spark, args.index).items()}
        asked = spark.createDataFrame([(0, args.corpus_id, args.question)], "query_id long, corpus_id string, query string")
        for row in pipeline.answer(tables, asked)["texts"].collect():
            print(row.text)


if __name__ == "__main__":
    main()
