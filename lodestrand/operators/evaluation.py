"""Answer scores and the summaries of evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Columns of evaluated samples whose means a metrics row has, where they are there.
MEANS = ("query_total_latency", "retrieval_latency", "qa_latency", "nodes", "entity_nodes", "fact_nodes", "sentence_nodes", "chunk_nodes", "edges", "final_evidence_tokens", "alpha_f", "alpha_s", "alpha_c",
         "fact_tokens", "sentence_tokens", "chunk_tokens", "fact_count", "sentence_count", "chunk_count")
METRICS = ("f1", "em", "query_total_latency", "retrieval_latency", "final_evidence_tokens")


def gold_set(answer: Column, aliases: Column) -> Column:
    """Answer and aliases without nulls, the first of each normal form."""
    both = F.filter(F.concat(F.array(answer), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: a.isNotNull() & (F.trim(a) != ""))
    forms = lambda arr: F.transform(arr, X.normal_answer)
    return F.filter(both, lambda a, i: F.array_position(forms(both), X.normal_answer(a)) == i + 1)


def best(prediction: Column, golds: Column) -> tuple[Column, Column]:
    """(best exact match, best F1) over gold answers; 0 without any."""
    em = F.array_max(F.transform(golds, lambda g: X.exact_match(prediction, g)))
    return F.coalesce(em, F.lit(0.0)), X.best_f1(prediction, golds)


def answer_match(candidates: Column, *texts: Column) -> Column:
    """The candidates whose normal form occurs in the texts' normal form."""
    blob = X.normal_answer(F.concat_ws(" ", *texts))
    return F.filter(candidates, lambda c: (X.normal_answer(c) != "") & blob.contains(X.normal_answer(c)))


def by_source(examples: DataFrame) -> DataFrame:
    """Means per source and over all (source ``overall``), as one rollup."""
    means = [F.avg(m).alias(f"avg_{m}") for m in METRICS]
    rolled = examples.withColumn("source", F.coalesce("source_dataset", F.lit("unknown"))).rollup("source").agg(F.count("*").alias("examples"), *means, F.grouping("source").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("source")).alias("source"), "examples", *[f"avg_{m}" for m in METRICS])


def alpha_spread(examples: DataFrame) -> DataFrame:
    """Means and population deviations of the granularity shares per source; 0 for a single example."""
    cols = [x for a in ("alpha_f", "alpha_s", "alpha_c") for x in (F.avg(a).alias(f"avg_{a}"), F.coalesce(F.stddev_pop(a), F.lit(0.0)).alias(f"std_{a}"))]
    return examples.groupBy(F.coalesce("source_dataset", F.lit("unknown")).alias("source")).agg(F.count("*").alias("examples"), *cols)


def repeat_summary(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation over repeated runs per key; 0 for a single run."""
    cols = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.groupBy(key).agg(F.count("*").alias("runs"), *cols)


def mode_consistency(examples: DataFrame) -> DataFrame:
    """How far the two execution modes agree, query by query: the latest row of each mode per query."""
    latest = examples.filter("query_id is not null").groupBy("query_id", "execution_mode").agg(F.max_by(F.struct(*METRICS, "predicted_answer"), F.struct("loaded_at", "example_id")).alias("r"))
    a = latest.filter("execution_mode = 'sequential'").select("query_id", F.col("r").alias("a"))
    b = latest.filter("execution_mode = 'multi_worker'").select("query_id", F.col("r").alias("b"))
    same = lambda f: F.sum(F.when(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), 1).otherwise(0)).alias(f"same_{f}")
    met = a.join(b, "query_id", "left")
    return met.agg(F.count("*").alias("queries"), F.sum(F.when(F.col("b").isNotNull(), 1).otherwise(0)).alias("paired"), same("f1"), same("em"), same("final_evidence_tokens"), same("predicted_answer"))


def token_shares(packed: DataFrame) -> DataFrame:
    """query_id and the share of evidence tokens per kind; 0 without tokens."""
    total = F.col("fact_tokens") + F.col("sentence_tokens") + F.col("chunk_tokens")
    return packed.select("query_id", *[F.when(total > 0, F.col(f"{k}_tokens") / total).otherwise(0.0).alias(f"{k}_share") for k in ("fact", "sentence", "chunk")])


def parse_fail_rate(failed: Column) -> Column:
    """The share of questions whose model reply said nothing; 0 without questions."""
    return F.coalesce(F.avg(failed.cast("double")), F.lit(0.0))


def edge_type_averages(rows: DataFrame) -> DataFrame:
    """edge_type, edges: the mean number of edges of a type over the rows whose ``edge_types`` (a map) have it."""
    return rows.select(F.explode("edge_types").alias("edge_type", "n")).groupBy("edge_type").agg(F.avg("n").alias("edges"))


def token_allocation(rows: DataFrame) -> DataFrame:
    """Mean evidence tokens and counts per kind, by source and over all."""
    cols = [f"{k}_{x}" for k in ("fact", "sentence", "chunk") for x in ("tokens", "count")]
    by = rows.withColumn("source", F.coalesce("source_dataset", F.lit("unknown"))).rollup("source").agg(F.count("*").alias("examples"), *[F.avg(c).alias(f"avg_{c}") for c in cols], F.grouping("source").alias("g"))
    return by.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("source")).alias("source"), "examples", *[f"avg_{c}" for c in cols])


def summaries(rows: DataFrame) -> dict[str, DataFrame]:
    """The four summaries of a run: overall, by source, of the granularity shares, and of the tokens of each kind."""
    timed = reduce(lambda a, c: a if c in a.columns else a.withColumn(c, F.lit(None).cast("double")), METRICS, rows)
    means = by_source(timed)
    return {"summary_overall": means.filter("source = 'overall'"), "summary_by_source": means.filter("source <> 'overall'"), "summary_alpha": alpha_spread(rows), "summary_tokens": token_allocation(rows)}
