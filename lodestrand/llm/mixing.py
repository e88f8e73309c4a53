"""Problem 9: records of several sources mixed to target shares of all tokens.

Every record gets a hash-random key; keys fall into equal ranges, records are sorted by key within each source and
range, and running token counts come from sums within a range plus the totals of the ranges before it, so no source is
ever sorted or summed in one task. A source is cut at its exact budget: whole epochs first, then the records whose
running total stays within the remainder. Nothing is sampled: the size of a mixture is the largest at which every
source that has tokens can hold its share within its cap on repeats.

Records whose text is null or has no token, or whose source is null, are in no mixture. Sources that a mixture wants
but the records lack contribute nothing; their reached share is 0, and the shares of the others are kept against the
same size. Null shares count as 0 and null caps as 1. Repeated rows are separate records, told apart by their
number within one doc_id.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import small_side, stored

#: Records that one range of keys holds on average.
RANGE_ROWS = 50_000


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public tokenizer used where none is given."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@cache
def encoder(path: str, pattern: str):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, source, tokens of every record with a text and a source; special tokens count as ordinary text."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    def run(batches):
        for batch in batches:
            encode = encoder(path, pattern).encode_ordinary
            counts = [len(encode(t.encode("utf-8", "replace").decode())) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    chosen = docs.filter("text is not null and source is not null").select("doc_id", "source", "text")
    return chosen.mapInArrow(run, "doc_id long, source string, tokens long").filter("tokens > 0")


def running_totals(counted: DataFrame, seed: int = 42) -> DataFrame:
    """``counted`` with key and before: the tokens of its source at smaller keys.

    Ties of keys, which only records of one doc_id have, are broken by token count.
    """
    rows = counted.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    keyed = counted.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    keyed = keyed.withColumn("range", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("t"))
    offset = sums.withColumn("offset", F.sum("t").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    summed = keyed.withColumn("within", F.coalesce(within, F.lit(0)))
    return summed.join(small_side(offset.select("source", "range", F.coalesce("offset", F.lit(0)).alias("offset"))), ["source", "range"]).select("doc_id", "source", "tokens", "key", (F.col("within") + F.col("offset")).alias("before"))


def budgets(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """mixture_id, source, target_share, max_repeats, has, budget, epochs, rest of every wanted source.

    The size of a mixture is min over its present sources of has * max_repeats / share.
    """
    has = counted.groupBy("source").agg(F.sum("tokens").alias("has"))
    wanted = targets.filter("mixture_id is not null and source is not null").groupBy("mixture_id", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    both = wanted.join(has, "source", "left").withColumn("has", F.coalesce("has", F.lit(0)))
    room = F.when((F.col("has") > 0) & (F.col("target_share") > 0), F.col("has") * F.col("max_repeats") / F.col("target_share"))
    sized = both.withColumn("size", F.min(room).over(Window.partitionBy("mixture_id")))
    budget = F.least(F.floor(F.coalesce(F.col("size") * F.col("target_share"), F.lit(0.0)) + 1e-6), F.col("has") * F.col("max_repeats")).cast("long")
    cut = sized.withColumn("budget", F.when(F.col("has") > 0, budget).otherwise(F.lit(0)).cast("long"))
    epochs = F.when(F.col("has") > 0, F.floor(F.col("budget") / F.col("has"))).otherwise(0).cast("int")
    cut = cut.withColumn("epochs", epochs)
    return cut.select("mixture_id", "source", "target_share", "max_repeats", "size", "has", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("has")).alias("rest"))


def select(docs: DataFrame, targets: DataFrame, path: str | None = None, pattern: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chosen, budgets): chosen has mixture_id, source, doc_id, tokens, times for every record taken at least once."""
    counted = stored(token_counts(docs, path, pattern))
    plan = stored(budgets(counted, targets))
    totals = running_totals(counted, seed)
    met = totals.join(small_side(plan.filter("budget > 0").select("mixture_id", "source", "epochs", "rest")), "source")
    times = F.col("epochs") + F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    chosen = met.withColumn("times", times.cast("int")).filter("times > 0").select("mixture_id", "source", "doc_id", "tokens", "times")
    return chosen, plan


def shares(docs: DataFrame, targets: DataFrame, path: str | None = None, pattern: str | None = None, seed: int = 42) -> DataFrame:
    """One row per wanted source: its target and reached share, tokens, records, and most repeats."""
    chosen, plan = select(docs, targets, path, pattern, seed)
    reached = chosen.groupBy("mixture_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    rows = plan.join(small_side(reached), ["mixture_id", "source"], "left").fillna(0, ["reached_tokens", "documents", "most_repeats"])
    whole = F.sum("reached_tokens").over(Window.partitionBy("mixture_id"))
    share = F.when(whole > 0, F.round(F.col("reached_tokens") / whole, 6)).otherwise(0.0)
    return rows.select("mixture_id", "source", "target_share", "max_repeats", F.col("budget").alias("budget_tokens"), "reached_tokens", share.alias("reached_share"), "documents", "most_repeats")
