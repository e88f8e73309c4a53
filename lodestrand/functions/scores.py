"""Score functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config

KINDS = ("fact", "sentence", "chunk")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-8) * (F.sqrt(dot(b, b)) + 1e-8))


def l1_normalised(scores: DataFrame, by: list[str], column: str = "score") -> DataFrame:
    """Scores divided by their sum per group; rows at 0 or below, and nulls, go."""
    positive = scores.filter(F.col(column) > 0)
    return positive.withColumn(column, F.col(column) / F.sum(column).over(Window.partitionBy(*by)))


def alpha(fact: Column, sentence: Column, chunk: Column, entity: Column | None = None) -> Column:
    """A granularity profile that sums to 1; a legacy entity share counts as fact."""
    clamp = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    f, s, c = clamp(fact) + (clamp(entity) if entity is not None else F.lit(0.0)), clamp(sentence), clamp(chunk)
    total = F.when(f + s + c == 0, 1.0).otherwise(f + s + c)
    return F.struct((f / total).alias("fact"), (s / total).alias("sentence"), (c / total).alias("chunk"))


def entropy_confidence(profile: Column) -> Column:
    """1 minus the entropy of the profile over its largest value."""
    terms = [F.when(profile[k] > 0, profile[k] * F.log(profile[k])).otherwise(0.0) for k in KINDS]
    positive = reduce(lambda a, b: a | b, [profile[k] > 0 for k in KINDS])
    return F.when(positive, F.greatest(F.lit(0.0), 1 + reduce(lambda a, b: a + b, terms) / F.log(F.lit(3.0)))).otherwise(0.0)


def profile_of(profile: Column) -> Column:
    """The task profile that a granularity profile stands for."""
    return F.when(profile["chunk"] >= 0.42, "long_context").when(profile["sentence"] + profile["fact"] >= 0.62, "multi_hop").otherwise("single_hop")


def heuristic_alpha(query: Column, config: Config = Config()) -> Column:
    """The profile that words of the question suggest; parts of words count."""
    low = F.lower(F.coalesce(query, F.lit("")))
    prior = {k: alpha(*map(F.lit, v)) for k, v in config.profile_alpha_priors.items()}
    return (
        F.when(low.rlike("summary|overview|background|context|describe"), prior["long_context"])
        .when(low.rlike("employer|spouse|father|mother|after|before|whose|which"), prior["multi_hop"])
        .when(low.rlike("who|when|where|name"), prior["single_hop"])
        .otherwise(alpha(F.lit(0.40), F.lit(0.40), F.lit(0.20)))
    )


def parsed_alpha(text: Column) -> Column:
    """(profile, failed) of a model's reply: JSON members, else its first three numbers, else equal shares."""
    json = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    member = lambda *names: F.coalesce(*[F.get_json_object(json, f"$.{n}").try_cast("double") for n in names])
    f, s, c = member("alpha_F", "fact"), member("alpha_S", "sentence"), member("alpha_C", "chunk")
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    named = f.isNotNull() & s.isNotNull() & c.isNotNull() & (f + s + c > 0)
    third = F.lit(1.0)
    pick = lambda i, x: F.when(named, x).when(F.size(numbers) >= 3, F.get(numbers, F.lit(i)).try_cast("double")).otherwise(third)
    return F.struct(alpha(pick(0, f), pick(1, s), pick(2, c)).alias("alpha"), (~F.coalesce(named, F.lit(False)) & (F.size(numbers) < 3)).alias("failed"))


def uniform_mix(profile: Column, mix: float) -> Column:
    """The profile mixed with equal shares."""
    m = min(1.0, max(0.0, mix))
    return alpha(*[(1 - m) * profile[k] + m / 3 for k in KINDS])


def passage_weights(profile: Column) -> dict[str, Column]:
    """Weights of the five contributions to a passage's score."""
    return {
        "chunk_rank": 0.35 + 0.90 * profile["chunk"], "sentence_rank": 0.08 + 0.55 * profile["sentence"], "entity_rank": 0.02 + 0.25 * profile["fact"],
        "dense": 0.12 + 0.70 * profile["chunk"], "fact": 0.06 + 0.45 * profile["fact"],
    }


def pack_weight(profile: Column, kind: Column) -> Column:
    """Weight of an evidence kind in packing."""
    share = F.when(kind == "fact", profile["fact"]).when(kind == "sentence", profile["sentence"]).otherwise(profile["chunk"])
    return 0.05 + 3.0 * share


def hub_scale(degree: Column, penalty: float = Config().hub_penalty) -> Column:
    return 1 / (1 + penalty * F.log1p(degree))


def passage_limit(profile: Column, signal: Column, config: Config = Config()) -> Column:
    """Words that a passage may take: more with the chunk share and the passage's score or coverage."""
    most = max(80, config.evidence_chunk_max_tokens or config.evidence_passage_excerpt_tokens or 256)
    least = min(80, most)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    wish = F.rint(least + (most - least) * (0.85 * clamp(profile["chunk"]) + 0.15 * clamp(signal)))
    cap = most if config.evidence_soft_token_budget <= 0 else max(1, config.evidence_soft_token_budget)
    return F.greatest(F.lit(least), F.least(F.lit(min(most, cap)), wish)).cast("int")


def quota(shares: tuple[float, float, float], total: int, caps: tuple[int, int, int]) -> tuple[int, int, int]:
    """Units per kind by largest remainder within caps, what is left over going round by remainder, then share."""
    raw = [total * s for s in shares]
    given = [min(c, int(r)) for c, r in zip(caps, raw)]
    turn = sorted(range(3), key=lambda i: (raw[i] - int(raw[i]), shares[i]), reverse=True)
    left = total - sum(given)
    while left > 0 and any(given[i] < caps[i] for i in turn):
        for i in turn:
            if left > 0 and given[i] < caps[i]:
                given[i] += 1
                left -= 1
    return tuple(given)


def quota_of(profile: Column, config: Config = Config()) -> Column:
    """``quota`` of a profile column, as a struct of three counts."""
    total = max(1, config.evidence_alpha_total_units)
    caps = (config.fact_top_k, config.sentence_top_k, config.passage_output_top_k)

    @F.pandas_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in KINDS]))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shares in batches:
            yield pd.DataFrame([quota(tuple(row), total, caps) for row in shares[list(KINDS)].itertuples(index=False)], columns=KINDS)

    return run(profile)
