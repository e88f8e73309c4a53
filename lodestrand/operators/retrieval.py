"""Batched retrieval: every question against its corpus, channel by channel, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import text as X
from ..functions.scores import cosine, l1_normalised, passage_weights
from ..runtime import BROADCAST_LIMIT, planned_bytes, small_side, stored
from . import graph

DIMENSIONS = 128


def hashed_encoder(dimensions: int = DIMENSIONS):
    """A deterministic stand-in for a text encoder: hashed words with signs, L2-normalised; any UDF of one text column fits."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import zlib

        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimensions, np.float32)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dimensions] += 1.0 if h >> 31 else -1.0
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.Series(out)

    return encode


def top_k(scored: DataFrame, by: list[str], k: int, order: list[str], score: str = "score") -> DataFrame:
    """The ``k`` best rows per group with their rank; ties by ``order``. Ranks above k are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def contenders(scored: DataFrame, by: list[str], k: int, score: str = "score") -> DataFrame:
    """The rows that can be among the ``k`` best of their group: those at the ``k``-th best score or above.

    For scores of few values: rows are counted per score, so neither all rows nor what they carry are sorted.
    """
    levels = scored.groupBy(*by, score).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc(score))) - F.col("_n")
    least = stored(levels.withColumn("_above", above).filter(F.col("_above") < k).groupBy(*by).agg(F.min(score).alias("_least")))
    return scored.join(small_side(least), by).filter(F.col(score) >= F.col("_least")).drop("_least")


def meet(queries: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Every query (keys, query_id, ...) with every item (keys, id, ...) of its keys, or with all without keys.

    The query side is a stated query set. If its estimated size is small it is broadcast; else queries are dealt into
    blocks, and items meet each block under a key of its own (with ``SALT`` parts of items), so that no key holds a
    whole corpus.
    """
    if planned_bytes(queries) <= BROADCAST_LIMIT:
        q = F.broadcast(queries)
        return q.crossJoin(items) if not keys else items.join(q, keys)
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    part, salt = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(SALT))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.withColumn("_block", part).withColumn("_salt", every(SALT))
    return items.withColumn("_salt", salt).withColumn("_block", every(blocks)).join(q, [*keys, "_block", "_salt"]).drop("_block", "_salt")


def dense(queries: DataFrame, items: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Per query (keys, query_id, query_vec) the ``k`` items (keys, id, vec, ord) of highest cosine, clamped at 0."""
    scored = meet(queries, items, keys).withColumn("score", cosine(F.col("query_vec"), F.col("vec")))
    ranked = top_k(scored, ["query_id"], k, ["ord"])
    return ranked.select("query_id", "id", "ord", "rank", F.greatest("score", F.lit(0.0)).alias("score"))


#: Parts that the items of one key are dealt into where questions and items meet in a shuffle, and questions in a block.
SALT, QUERY_BLOCK = 16, 4096


def term_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """corpus_id, query_id, id, score: the share of each question's terms (corpus_id, query_id, query_terms) that an item
    of its corpus (corpus_id, id, terms) has; items that share none are not there.

    Terms are exploded and equi-joined, so only items that have a term meet the question, and no key holds a corpus.
    """
    asked = queries.select("corpus_id", "query_id", F.size("query_terms").alias("n"), F.explode("query_terms").alias("term"))
    had = items.select("corpus_id", "id", F.explode("terms").alias("term"))
    return had.join(small_side(asked), ["corpus_id", "term"]).groupBy("corpus_id", "query_id", "id").agg((F.count("*") / F.first("n")).alias("score"))


def entity_channel(parts: DataFrame) -> DataFrame:
    """query_id, id, score: of an id found for several query entities the last one's score stays; then L1.

    ``parts`` has query_id, part (number of the query entity), id, score.
    """
    last = parts.groupBy("query_id", "id").agg(F.max_by("score", "part").alias("score"))
    return l1_normalised(last, ["query_id"])


def max_channel(parts: DataFrame) -> DataFrame:
    """query_id, id, score: the largest score over parts; then L1."""
    return l1_normalised(parts.groupBy("query_id", "id").agg(F.max("score").alias("score")), ["query_id"])


def fact_channel(parts: DataFrame) -> DataFrame:
    """Like ``max_channel``, over 0.85 dense + 0.15 lexical overlap of the query fact (query_text) with the fact (text)."""
    blended = parts.withColumn("score", 0.85 * F.col("score") + 0.15 * X.lexical_overlap(F.col("query_text"), F.col("text")))
    return max_channel(blended)


def rerank_facts(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, id, rank, score: the best ``fact_rerank_top_k`` by score, reranked with lexical overlap, kept and L1.

    ``scored`` has query_id, query, id, text, ord, score.
    """
    first = top_k(scored, ["query_id"], config.fact_rerank_top_k, ["ord"])
    again = first.withColumn("score", 0.7 * F.col("score") + 0.3 * X.lexical_overlap(F.col("query"), F.col("text"))).drop("rank")
    kept = top_k(again, ["query_id"], config.fact_rerank_keep_k, ["ord"])
    return l1_normalised(kept, ["query_id"]).select("query_id", "id", "ord", "rank", "score")


def seed_scores(fact_scores: DataFrame, facts: DataFrame, chunk_scores: DataFrame, queries: DataFrame, counts: DataFrame, degree: DataFrame, sentence_scores: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """query_id, node_id, score: the restart seeds of every question.

    Fact ends get the fact's score times the fact share over the entity's chunk count, chunks theirs times the chunk
    share; entities are then damped by their degree. Questions without facts add chunk scores and half the sentence
    scores, undamped. L1 at the end. Inputs: (query_id, id, score) and queries (query_id, corpus_id, alpha).
    """
    share = lambda k: F.greatest(F.col(f"alpha.{k}"), F.lit(0.05))
    q = small_side(queries.select("query_id", "corpus_id", "alpha"))
    ends = facts.groupBy("corpus_id", F.col("fact_id").alias("id")).agg(F.max_by(F.struct("head_id", "tail_id"), F.struct("ord", "sentence_index", "fact_index")).alias("e"))
    hit = fact_scores.join(q, "query_id").join(ends, ["corpus_id", "id"]).select("query_id", "corpus_id", F.explode(F.array("e.head_id", "e.tail_id")).alias("node_id"), (F.col("score") * share("fact")).alias("s"))
    from_facts = hit.join(counts.withColumnRenamed("entity_id", "node_id"), ["corpus_id", "node_id"]).select("query_id", "corpus_id", "node_id", (F.col("s") / F.greatest("chunk_count", F.lit(1))).alias("s"))
    from_chunks = chunk_scores.join(q, "query_id").select("query_id", "corpus_id", F.col("id").alias("node_id"), (F.greatest("score", F.lit(0.0)) * share("chunk")).alias("s"))
    summed = from_facts.union(from_chunks).groupBy("query_id", "corpus_id", "node_id").agg(F.sum("s").alias("s"))
    damp = F.when(F.col("node_id").startswith("entity:"), 1 + config.entity_hub_suppression * F.log1p(F.coalesce("degree", F.lit(0)))).otherwise(1.0)
    damped = summed.join(degree, ["corpus_id", "node_id"], "left").select("query_id", "node_id", (F.col("s") / damp).alias("score"))
    if config.enable_no_fact_fallback:
        bare = queries.select("query_id").join(fact_scores.select("query_id").distinct(), "query_id", "left_anti")
        more = [chunk_scores.select("query_id", F.col("id").alias("node_id"), F.greatest("score", F.lit(0.0)).alias("score"))]
        if sentence_scores is not None:
            more.append(sentence_scores.select("query_id", F.col("id").alias("node_id"), (0.5 * F.greatest("score", F.lit(0.0))).alias("score")))
        damped = damped.union(reduce(DataFrame.union, more).join(bare, "query_id", "left_semi").select("query_id", "node_id", "score"))
    total = damped.groupBy("query_id", "node_id").agg(F.sum("score").alias("score"))
    return l1_normalised(total, ["query_id"])


# Weights of the contributions to a passage's score where a question's shares do not set them.
FIXED_WEIGHTS = {"chunk_rank": 0.70, "sentence_rank": 0.20, "entity_rank": 0.05, "dense": 0.30, "fact": 0.15}
ENTITY_TO_CHUNK = 0.08


def rank_passages(ranks: DataFrame, index: dict[str, DataFrame], chunk_scores: DataFrame, ranked_facts: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, chunk_id, rank, score: passages by five weighted contributions. ``ranks`` are scores of nodes, or the sums
    of ``graph.passage_sums``.

    An entity counts for a chunk once per edge, in either direction, to one of its sentences; without a sentence layer,
    to the chunk itself. Weights follow the question's shares, or are fixed where the settings say so.
    """
    weight = passage_weights(F.col("alpha"))
    if not (config.enable_granularity_awareness and config.evidence_use_alpha_weights):
        weight = {k: F.lit(v) for k, v in FIXED_WEIGHTS.items()}
        if not config.enable_sentence_layer:
            weight["entity_rank"] = F.lit(ENTITY_TO_CHUNK)
    q = small_side(queries.select("query_id", "corpus_id", "alpha"))
    if "through" not in ranks.columns:
        ranks = graph.passage_sums(ranks, index["edges"], index["nodes"], queries, config)
    graph_part = weight["chunk_rank"] * F.col("own") + weight["sentence_rank"] * F.col("inner_sum") + weight["entity_rank"] * F.col("through")
    placed = ranks.join(q, "query_id").select("query_id", "chunk_id", graph_part.alias("s"))
    direct = chunk_scores.join(q, "query_id").select("query_id", F.col("id").alias("chunk_id"), (weight["dense"] * F.col("score")).alias("s"))
    boost = config.fact_chunk_boost if config.enable_fact_chunk_boost else 0.0
    by_fact = ranked_facts.filter(F.col("rank") <= config.fact_top_k).join(q, "query_id").select("query_id", "chunk_id", ((weight["fact"] + boost) * F.col("score")).alias("s"))
    total = reduce(DataFrame.union, [placed, direct, by_fact]).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))
    return top_k(total, ["query_id"], config.passage_output_top_k, ["chunk_id"]).select("query_id", "chunk_id", "rank", "score")


def sentence_scores(ranks: DataFrame, dense_scores: DataFrame, ranked_facts: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, node_id, score: sentences by rank, dense score and the facts found in them; L1."""
    parts = [
        ranks.filter(F.col("node_id").startswith("sentence:")).select("query_id", "node_id", (0.65 * F.col("score")).alias("score")),
        dense_scores.select("query_id", F.col("id").alias("node_id"), (0.35 * F.col("score")).alias("score")),
        ranked_facts.filter((F.col("rank") <= config.fact_top_k) & (F.col("sentence_id") != "")).select("query_id", F.col("sentence_id").alias("node_id"), (0.45 * F.col("score")).alias("score")),
    ]
    return l1_normalised(reduce(DataFrame.union, parts).groupBy("query_id", "node_id").agg(F.sum("score").alias("score")), ["query_id"])


def direct_scores(channels: DataFrame) -> DataFrame:
    """query_id, node_id, score: the largest score of a node over the entity, sentence and chunk channels (no propagation)."""
    return channels.filter("channel <> 'fact'").groupBy("query_id", F.col("id").alias("node_id")).agg(F.max(F.greatest("score", F.lit(0.0))).alias("score"))


def diverse(scored: DataFrame, k: int) -> DataFrame:
    """query_id, node_id, rank: of (query_id, node_id, title, score) the best row per lower-case title (all rows without
    one), up to ``k``; ties by node_id. Titles are reduced to their best row before anything is ranked."""
    key = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    keyed = scored.withColumn("key", F.when(key == "", F.concat(F.lit("\n"), F.col("node_id"))).otherwise(key))
    best = keyed.groupBy("query_id", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("node_id"))).alias("b")).select("query_id", "b.node_id", (-F.col("b.s")).alias("score"))
    return top_k(best, ["query_id"], k, ["node_id"]).select("query_id", "node_id", "rank")


def neighbours(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """query_id, sentence_id, score: the sentences next to a fact's sentence in its chunk, at 0.82 of its score.

    A range join bounded by construction: each hit is met by at most three sentence numbers, as an equi-join.
    """
    wide = hits.withColumn("sentence_index", F.explode(F.array(F.col("sentence_index") - 1, F.col("sentence_index"), F.col("sentence_index") + 1)))
    met = wide.join(sentences.select("corpus_id", "chunk_id", "sentence_index", F.col("sentence_id").alias("near")), ["corpus_id", "chunk_id", "sentence_index"])
    return met.groupBy("query_id", F.col("near").alias("sentence_id")).agg(F.max(0.82 * F.col("score")).alias("score"))


Filter = Callable[[str, list[tuple[str, str]]], list[str]]


def filter_facts(scored: DataFrame, choose: Filter | None = None, keep: int = 5) -> DataFrame:
    """query_id, id, score: facts chosen by a model, or the first ``keep`` without one; earlier ones weigh more; L1.

    ``choose`` takes the question and (id, text) pairs and returns the ids to keep, in order; what it raises counts as
    no answer. Candidates per question are few (``fact_rerank_llm_candidate_k``), so a question is one group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        ids: list[str] = []
        if choose is not None:
            try:
                ids = [i for i in dict.fromkeys(choose(rows["query"].iloc[0], list(zip(rows["id"], rows["text"])))) if i in set(rows["id"])]
            except Exception:  # noqa: BLE001
                ids = []
        ids = ids or list(rows["id"][:keep])
        score = dict(zip(rows["id"], rows["score"]))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": ids, "score": [score[i] * (1 + 0.05 * (len(ids) - k)) for k, i in enumerate(ids)]})

    kind = dict(scored.dtypes)["query_id"]
    return l1_normalised(scored.groupBy("query_id").applyInPandas(run, f"query_id {kind}, id string, score double"), ["query_id"])
