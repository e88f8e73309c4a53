"""Evaluation runs: samples answered against their indexes, their rows, means and summaries, and corpora of growing size."""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import reader
from ..operators import corpus, evaluation, graph
from ..runtime import small_side, stored
from ..sources import payloads
from . import pipeline

# Settings that samples of a source are evaluated with, over those for all.
BASE = {"passage_output_top_k": 10, "enable_fact_source_first_evidence": True, "enable_fact_chunk_boost": True, "fact_chunk_boost": 0.4, "enable_fair_sentence_context": True,
        "evidence_extra_ranked_sentence_k": 3, "evidence_max_sentences": 15, "evidence_title_limit": 3, "evidence_passage_context_k": 1, "evidence_passage_excerpt_tokens": 100,
        "evidence_chunk_max_tokens": 256, "evidence_packing_mode": "alpha_count", "evidence_alpha_total_units": 20, "chunk_size_words": 256, "chunk_overlap_words": 64, "use_paragraph_as_chunk": True}
BY_SOURCE = {"naturalquestions": {"qa_passage_top_k": 0}, "narrativeqa": {"qa_passage_top_k": 5, "chunk_size_words": 1024, "chunk_overlap_words": 128, "use_paragraph_as_chunk": False}}
OTHERS = {"qa_passage_top_k": 4}
#: The columns of a metrics row, in order; ``edge_`` columns follow.
METRIC_ORDER = ["variant", "scale", "num_queries", "F1", "EM", "parse_fail_rate", *(f"avg_{c}" for c in evaluation.MEANS)]


def of_source(config: Config, source: str) -> Config:
    """The settings for samples of a source."""
    return replace(config, **{**BASE, **BY_SOURCE.get(source, OTHERS)})


def with_profile_defaults(config: Config, given: frozenset[str] = frozenset()) -> Config:
    """A forced single hop reads no passages, unless ``given`` names that setting as chosen by the user."""
    if config.task_profile == "single_hop" and "qa_passage_top_k" not in given:
        return replace(config, qa_passage_top_k=0)
    return config


def index_records(index: dict[str, DataFrame]) -> DataFrame:
    """corpus_id, nodes and edges in all and by type (``edge_types``, a map): what is known of each corpus's index."""
    nodes = index["nodes"].groupBy("corpus_id").agg(F.count("*").alias("nodes"), *[F.count_if(F.col("node_type") == k).alias(f"{k}_nodes") for k in ("entity", "sentence", "chunk")])
    facts = index["facts"].groupBy("corpus_id").agg(F.count("*").alias("fact_nodes"))
    kinds = index["edges"].groupBy("corpus_id", "edge_type").agg(F.count("*").alias("n"))
    edges = kinds.groupBy("corpus_id").agg(F.sum("n").alias("edges"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("edge_type", "n")))).alias("edge_types"))
    return nodes.join(facts, "corpus_id", "left").join(edges, "corpus_id", "left").fillna(0, ["fact_nodes", "edges"])


def samples_to_documents(samples: DataFrame) -> DataFrame:
    """The documents of samples as one corpus for each sample."""
    rows = samples.select(F.col("sample_id").alias("corpus_id"), F.posexplode("documents").alias("document_index", "d"))
    return rows.select("corpus_id", F.col("document_index").cast("long").alias("doc_id"), "document_index", "d.title", "d.text")


def evaluate(index: dict[str, DataFrame], samples: DataFrame, config: Config = Config(), encode=None, models: pipeline.Models = pipeline.Models(), by_source: bool = False, mode: str = "batch") -> DataFrame:
    """One row per sample (sample_id, corpus_id, question, answer, answer_aliases, source_dataset) that has a question and an
    index of its corpus: the answer, its scores, the question's profile, its evidence and the index's counts.

    ``by_source`` evaluates the samples of each source with its own settings, each in a plan of its own. Without a reader
    the answer is the first line of evidence. Samples without a corpus in the index are left out.
    """
    records = stored(index_records(index))
    known = samples.filter(F.trim(F.coalesce("question", F.lit(""))) != "").join(small_side(records.select("corpus_id")), "corpus_id")
    known = stored(known.withColumn("source", F.coalesce("source_dataset", F.lit(""))))
    if by_source:
        named = list(BY_SOURCE)
        parts = [(of_source(config, s), known.filter(F.col("source") == s)) for s in named] + [(of_source(config, ""), known.filter(~F.col("source").isin(named)))]
    else:
        parts = [(config, known)]
    rows = [_answered(index, rows, c, encode, models) for c, rows in parts]
    told = reduce(DataFrame.unionByName, rows).join(small_side(records), "corpus_id")
    return told.withColumn("execution_mode", F.lit(mode))


def _answered(index, samples: DataFrame, config: Config, encode, models: pipeline.Models) -> DataFrame:
    asked = samples.select(F.col("sample_id").alias("query_id"), "corpus_id", F.col("question").alias("query"))
    result = pipeline.answer(index, asked, encode, config, models=models)
    shares = evaluation.token_shares(result["texts"])
    if models.read is not None:
        answers = result["answers"].select("query_id", "predicted_answer")
    else:
        answers = result["packed"].filter("place = 0").select("query_id", F.col("line").alias("predicted_answer"))
    routed = result["routed"].select("query_id", "profile", "parse_failed", F.col("alpha.fact").alias("alpha_f"), F.col("alpha.sentence").alias("alpha_s"), F.col("alpha.chunk").alias("alpha_c"))
    evidence = result["texts"].join(shares, "query_id").withColumnRenamed("tokens", "final_evidence_tokens").drop("text")
    met = samples.withColumnRenamed("sample_id", "query_id").join(routed, "query_id").join(answers, "query_id", "left").join(evidence, "query_id", "left")
    golds = evaluation.gold_set(F.col("answer"), F.col("answer_aliases"))
    em, f1 = evaluation.best(F.col("predicted_answer"), F.col("golds"))
    counts = [f"{k}_{x}" for k in ("fact", "sentence", "chunk") for x in ("count", "tokens")]
    made = met.withColumn("golds", golds).withColumn("em", em).withColumn("f1", f1).fillna(0, ["final_evidence_tokens", *counts])
    return made.select("query_id", "corpus_id", "question", F.col("answer").alias("gold_answer"), "predicted_answer", "f1", "em", "source_dataset", "profile", "parse_failed", "alpha_f", "alpha_s", "alpha_c", "final_evidence_tokens", *counts)


def metrics(rows: DataFrame, variant: str = "baseline", scale: int | None = None) -> DataFrame:
    """One row of means over evaluated samples, with the mean number of edges of each type over samples that have it."""
    means = [F.avg(c).alias(f"avg_{c}") if c in rows.columns else F.lit(None).cast("double").alias(f"avg_{c}") for c in evaluation.MEANS]
    one = rows.agg(F.count("*").alias("num_queries"), F.avg("f1").alias("F1"), F.avg("em").alias("EM"), evaluation.parse_fail_rate(F.col("parse_failed")).alias("parse_fail_rate"), *means)
    kinds = evaluation.edge_type_averages(rows).groupBy().pivot("edge_type").agg(F.first("edges"))
    named = kinds.select(*[F.col(f"`{c}`").alias(f"edge_{c}") for c in kinds.columns])
    placed = one.select(F.lit(variant).alias("variant"), F.lit(scale).cast("long").alias("scale"), "*")
    return placed.join(F.broadcast(named)) if named.columns else placed


def write_run(rows: DataFrame, path: str, config: Config = Config(), variant: str = "baseline") -> DataFrame:
    """The files of a run: a row per example, the metrics, four summaries and the manifest. Gives the metrics back."""
    kept = stored(rows)
    payloads.write_rows(kept, f"{path}/per_example", "json", "overwrite")
    told = stored(metrics(kept, variant))
    payloads.write_metrics(told, path, METRIC_ORDER)
    for name, table in evaluation.summaries(kept).items():
        payloads.write_rows(table, f"{path}/{name}", "csv", "overwrite")
    settings = {f.name: getattr(config, f.name) for f in fields(config)}
    payloads.write_manifest(rows.sparkSession, path, config=settings, corpus_manifest={"corpora": kept.select("corpus_id").distinct().count(), "samples": kept.count()})
    return told


def global_scaling(docs: DataFrame, samples: DataFrame, scales: list[int], config: Config = Config(), encode=None, models: pipeline.Models = pipeline.Models(), repeats: int = 1, seed: int = 42) -> DataFrame:
    """Metrics of the samples against one corpus of each scale: all documents they need, filled up with distractors of
    ``docs``; with ``repeats``, one row for every repeat, whose distractors differ. Scales that cannot be are left out."""
    needed = stored(corpus.required(samples))
    total, least = corpus.distractors(docs, needed).count() + needed.count(), needed.count()
    out = []
    for scale, why in corpus.plan_scales(total, least, tuple(scales)):
        for turn in range(repeats if not why else 0):
            rows = corpus.scaled(docs, needed, scale, seed + turn).withColumn("corpus_id", F.lit(f"scale_{scale}"))
            made = rows.select("corpus_id", F.xxhash64("key").alias("doc_id"), F.lit(0).alias("document_index"), "title", "text")
            index = graph.materialised(graph.build(made, config, encode))
            asked = samples.withColumn("corpus_id", F.lit(f"scale_{scale}"))
            out.append(stored(metrics(stored(evaluate(index, asked, config, encode, models)), f"repeat_{turn}", scale)))
    if not out:
        raise ValueError("no scale holds all required documents")
    return payloads.union_header(out)


def compare_modes(index: dict[str, DataFrame], samples: DataFrame, config: Config = Config(), encode=None, models: pipeline.Models = pipeline.Models()) -> DataFrame:
    """How far answering question by question agrees with answering all in one plan (``mode_consistency``)."""
    one = [evaluate(index, samples.filter(F.col("sample_id") == r[0]), config, encode, models, mode="sequential") for r in samples.select("sample_id").toLocalIterator()]
    both = reduce(DataFrame.unionByName, [*one, evaluate(index, samples, config, encode, models, mode="multi_worker")])
    blank = both.withColumn("query_total_latency", F.lit(None).cast("double")).withColumn("retrieval_latency", F.lit(None).cast("double"))
    return evaluation.mode_consistency(blank.withColumn("loaded_at", F.lit(0)).withColumn("example_id", F.lit(0)))


def reader_model(answer) -> pipeline.Models:
    """Models with a reader that sends prompts to ``answer`` (a list of prompts to a list of replies) in Arrow batches."""
    return pipeline.Models(read=reader.reader(answer))
