"""Corpora put together from samples: required documents, distractors, growing scales, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import stored


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of every key in a total order (not whichever a shuffle brings first)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def sample_documents(samples: DataFrame) -> DataFrame:
    """sample_id, place, idx, title, text, is_supporting, key of the documents of samples; blank texts go."""
    rows = samples.select("sample_id", F.posexplode("documents").alias("place", "d")).select("sample_id", "place", "d.*")
    return rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("key", F.md5(X.document_key(F.col("title"), F.col("text"))))


def required(samples: DataFrame) -> DataFrame:
    """key, title, text, sample_ids: the supporting documents of each sample (all of them where none is marked), once."""
    rows = sample_documents(samples)
    any_marked = F.max(F.coalesce(F.col("is_supporting"), F.lit(False)).cast("int")).over(Window.partitionBy("sample_id"))
    needed = rows.withColumn("m", any_marked).filter((F.col("m") == 0) | F.coalesce("is_supporting", F.lit(False)))
    return needed.groupBy("key").agg(F.min_by(F.struct("title", "text"), F.struct("sample_id", "place")).alias("d"), F.sort_array(F.collect_set("sample_id")).alias("sample_ids")).select("key", "d.title", "d.text", "sample_ids")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with their key; of equal ones the smallest doc_id."""
    rows = docs.filter("text is not null").select("doc_id", "corpus_id", "title", "text").withColumn("key", F.md5(X.document_key(F.col("title"), F.col("text"))))
    return first_per_key(rows, ["key"], ["doc_id"])


def distractors(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Documents that no sample needs."""
    return keyed(docs).join(needed.select("key"), "key", "left_anti")


def seeded_order(by: str, seed: int) -> Column:
    """A column that orders rows by a seeded hash of ``by``: the same for any number of partitions."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(by).cast("string")))


def seeded_sample(rows: DataFrame, by: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order of ``by``."""
    return rows.orderBy(seeded_order(by, seed), by).limit(n)


def scaled(docs: DataFrame, needed: DataFrame, scale: int | None = None, seed: int = 42, share: float = 1.0) -> DataFrame:
    """All required documents and seeded distractors up to ``scale`` documents; fails if there are too few.

    Without a scale it takes ``share`` of the distractors, as many whole documents as that is. The distractors are
    found once and stored; they are in a total order, so a scale holds every smaller one of the same seed.
    """
    must = needed.select("key", "title", "text", F.lit(True).alias("required"))
    others = stored(distractors(docs, needed).select("key", "title", "text"))
    n, there = must.count(), others.count()
    if scale is None:
        scale = n + int(share * there)
    if not n <= scale <= n + there:
        raise ValueError(f"a corpus of {scale} cannot hold {n} required documents with {there} distractors")
    rest = seeded_sample(others, "key", scale - n, seed)
    return must.union(rest.select("key", "title", "text", F.lit(False).alias("required")))


def already_in(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """key of the required documents that a corpus holds already."""
    return needed.select("key").join(keyed(docs).select("key"), "key", "left_semi")


def plan_scales(total: int, needed: int, presets: tuple[int, ...] = (500, 1000, 2000, 5000, 10000)) -> list[tuple[int, str]]:
    """(scale, '' or why it is left out) of every preset."""
    return [(s, "below the required documents" if s < needed else "above the corpus" if s > total else "") for s in presets]
