"""Problem 4: records that are equal but for spacing, case, punctuation or the order of their lines.

Byte-identical rows collapse first, with counts; only the distinct survivors are canonicalised, and groups form on
the full canonical text, summing the counts. Members then find their group through 32-byte digests of those texts,
so no group, however large, is ever collected into one row or task: skewed joins on digests are rows of a few dozen
bytes that adaptive execution can split.

Null titles count as empty. Rows whose text is null, or of which canonicalisation leaves nothing, are in no group.
A group keeps its smallest doc_id; repeated rows with one doc_id count as copies. Empty tables give empty results,
and other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

#: A line ``Label: value``, or one without letters and digits.
LABEL_LINE = r"^[^:]{1,60}:.*[\p{L}\p{N}]|^[^\p{L}\p{N}]*$"


def bare_column(text: Column) -> Column:
    """Lower-cased, with everything but letters and digits (Unicode L and N) dropped."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def lines_key(text: Column) -> Column:
    """For a text made only of ``Label: value`` lines, its bare lines in code-point order; else null."""
    lines = F.split(text, r"\R")
    bare_lines = F.filter(F.transform(lines, bare_column), lambda x: x != "")
    return F.when(text.contains(":") & F.forall(lines, lambda x: x.rlike(LABEL_LINE)), F.array_join(F.array_sort(bare_lines), "\n"))


def digest(*cols: Column) -> Column:
    """SHA-256 over the length-prefixed values."""
    return F.unhex(F.sha2(F.concat(*[x for c in cols for x in (F.length(c).cast("string"), F.lit(":"), c)]).cast("binary"), 256))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "text")


def _survivors(docs: DataFrame) -> DataFrame:
    """Distinct (title, text) rows with their counts, canonicalised: raw and same (digests), rep, n, t, x, k.

    Written to the shared folder, so that the canonical text is made once, and of survivors only: otherwise conditions
    on it would be pushed below the collapse of the raw rows and be worked out for every one of them.
    """
    raw = _rows(docs).groupBy("title", "text").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    made = raw.select(
        digest(F.col("title"), F.col("text")).alias("raw"), "rep", "n", bare_column(F.col("title")).alias("t"), bare_column(F.col("text")).alias("x"), lines_key(F.col("text")).alias("k")
    )
    return stored(made.withColumn("same", digest(F.col("t"), F.col("x")))).filter("x <> ''")


def _bare_groups(survivors: DataFrame) -> DataFrame:
    """Groups of equal full canonical text; ``final`` names the group that ignores the order of lines.

    A bare group of which one member is made of ``Label: value`` lines goes with its sorted lines.
    """
    by_text = survivors.groupBy("t", "x").agg(F.first("same").alias("same"), F.min("rep").alias("keep"), F.sum("n").alias("copies"), F.max("k").alias("k"))
    return by_text.select(
        "same", "keep", "copies",
        digest(F.col("t"), F.when(F.col("k").isNull(), F.col("x")).otherwise(F.concat(F.lit("\n"), "k"))).alias("final"),
    )


def groups(docs: DataFrame) -> DataFrame:
    """keep, copies: every distinct record once (its smallest doc_id), with the number of its copies."""
    by_text = _bare_groups(_survivors(docs))
    return by_text.groupBy("final").agg(F.min("keep").alias("keep"), F.sum("copies").alias("copies")).select("keep", "copies")


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, keep, copies for every row of a group with more than one member."""
    survivors = _survivors(docs)
    by_text = _bare_groups(survivors)
    final = by_text.groupBy("final").agg(F.min("keep").alias("keep"), F.sum("copies").alias("copies")).filter("copies > 1")
    by_same = by_text.select("same", "final").join(final, "final").select("same", "keep", "copies")
    by_raw = survivors.select("raw", "same").join(by_same, "same").select("raw", "keep", "copies")
    return _rows(docs).select("doc_id", digest(F.col("title"), F.col("text")).alias("raw")).join(by_raw, "raw").select("doc_id", "keep", "copies")


def copies(docs: DataFrame) -> DataFrame:
    """keep_doc_id, copy_doc_id: one row for each member of a group but the one it keeps."""
    return membership(docs).filter("doc_id <> keep").select(F.col("keep").alias("keep_doc_id"), F.col("doc_id").alias("copy_doc_id")).distinct()
