"""Text functions as column expressions; all but the F1 of tokens run in the JVM. Null texts give null or empty results, never errors."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists of the entity and term functions.
QUESTION_WORDS = "which what who whom whose when where why how tell list show name give find identify".split()
LIGHT_STOPWORDS = "a an the this that these those is are was were do does did and or of to for in on at with".split()
GENERIC_TERMS = ["he", "she", "they", "them", "him", "her", "his", "hers", "their", "theirs", "it", "its", "state", "states", "city", "country", "governor", "president", "american", "union", "confederate", "civil", "civil war", "war", "u s", "us", "united states", "currently", "introduction"]
CONTENT_STOPWORDS = "the a an and or of in on at to for with by from who what when where which how was were is are did does do this that its his her their has have had film song".split()
READER_STOPWORDS = "the a an and or of in on at to for with by from who what when where which how was were is are did does do this that its his her their person place film song".split()
ENTITY_PATTERN = r"[A-Z][A-Za-z0-9&.\-']*(?:\s+[A-Z][A-Za-z0-9&.\-']*){0,5}"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"


def array_of(words: list[str]) -> Column:
    """An array literal."""
    return F.array(*[F.lit(w) for w in words])


def spaced(text: Column) -> Column:
    """White space (Unicode) collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words of a text: runs of anything but white space."""
    return F.filter(F.split(spaced(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def truncated(text: Column, limit: Column | int) -> Column:
    """The first ``limit`` words, or the stripped text if it has no more."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    w = words(text)
    return F.when(F.size(w) <= n, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(F.array_join(F.slice(w, F.lit(1), F.greatest(n, F.lit(0))), " "))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words; none after the one that reaches the end."""
    step = max(1, size - overlap)
    w = words(text)
    last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step))).cast("int")
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences by punctuation followed by white space and a capital, digit or quote."""
    return F.filter(F.split(spaced(text), SENTENCE_BREAK), lambda s: F.trim(s) != "")


def node_id(prefix: str, *parts: Column) -> Column:
    """A stable id: parts joined, everything but ASCII letters and digits one underscore, at most 120 characters.

    White space around a part falls to the same underscore as the join beside it, so parts need no trimming of their own.
    """
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    clean = F.substring(F.lower(F.btrim(F.regexp_replace(joined, "[^a-zA-Z0-9]+", "_"), F.lit("_"))), 1, 120)
    return F.concat(F.lit(f"{prefix}:"), F.regexp_replace(clean, "^$", "node"))


_LEADING = "(?i)^(?:(?:" + "|".join(sorted({*QUESTION_WORDS, *LIGHT_STOPWORDS})) + ")(?: |$))+"
_TRAILING = "(?i)(?:(?:^| )(?:" + "|".join(LIGHT_STOPWORDS) + "))+$"
_GENERIC = "^(?:" + "|".join(GENERIC_TERMS) + r")?$|^\S(?: \S)*$"
_ASKS = r"(?i)(?:^|\s)(?:" + "|".join(QUESTION_WORDS) + r")(?=\s|$)"
_NAMED = r"(?:^|\s)\p{Lu}|^[^\s\p{Ll}]*\p{Lu}[^\s\p{Ll}]*$"


def clean_entity(text: Column) -> Column:
    """An entity without leading question words and articles and trailing small words; '' if under two characters.

    Each step reads its input once: nested copies of an expression would be evaluated anew inside array functions.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*"), F.lit(0))
    lead = F.regexp_replace(F.array_join(tokens, " "), _LEADING, "")
    return F.regexp_replace(F.regexp_replace(lead, _TRAILING, ""), "^.$", "")


def entity_key(text: Column) -> Column:
    """A comparison key: cleaned, lower case, letters and digits only, articles dropped."""
    plain = F.regexp_replace(F.lower(clean_entity(text)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(?:a|an|the)\b", " "), r"\s+", " "))


def is_generic(text: Column) -> Column:
    """Pronouns, general terms, nothing, or single characters only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[.\-_/\s]+", " ")).rlike(_GENERIC)


def is_named(text: Column) -> Column:
    """Looks like a name: not generic, no question word, and some token begins with a capital (a lone token may be all capitals)."""
    given = F.coalesce(text, F.lit(""))
    return ~is_generic(given) & ~given.rlike(_ASKS) & given.rlike(_NAMED)


def regex_entities(text: Column) -> Column:
    """Distinct cleaned names of a sentence in order: capitalised runs of up to six words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY_PATTERN), F.lit(0)), clean_entity)
    return F.array_distinct(F.filter(found, lambda e: (e != "") & is_named(e)))


def regex_triples(entities: Column) -> Column:
    """Facts of a sentence: each name related to the next, the first three."""
    n = F.least(F.lit(3), F.size(entities) - 1)
    pair = lambda i: F.struct(F.element_at(entities, i).alias("head"), F.lit("related_to").alias("relation"), F.element_at(entities, i + 1).alias("tail"), F.lit(0.35).alias("confidence"), F.lit("regex_fallback").alias("extractor"))
    kind = "array<struct<head:string,relation:string,tail:string,confidence:double,extractor:string>>"
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pair)).otherwise(F.array().cast(kind))


def clean_relation(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(clean == "", F.lit("related_to")).otherwise(clean)


def clean_entities(entities: Column) -> Column:
    """A given list of entities cleaned, filtered and without repeats."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(entities, F.array().cast("array<string>")), clean_entity), lambda e: (e != "") & is_named(e)))


def clean_triples(triples: Column) -> Column:
    """Given triples with clean ends, relation and confidence (null or 0 count as 1); those with empty or generic ends go."""
    made = F.transform(triples, lambda t: F.struct(clean_entity(t["head"]).alias("head"), clean_relation(t["relation"]).alias("relation"), clean_entity(t["tail"]).alias("tail"), F.when(F.coalesce(t["confidence"], F.lit(0.0)) == 0, 1.0).otherwise(t["confidence"]).alias("confidence"), F.coalesce(t["extractor"], F.lit("llm_or_heuristic")).alias("extractor")))
    return F.filter(made, lambda t: (t["head"] != "") & (t["tail"] != "") & ~is_generic(t["head"]) & ~is_generic(t["tail"]))


def overlap_terms(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) > 2))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's terms that the text has."""
    return term_share(overlap_terms(query), overlap_terms(text))


def term_share(query_terms: Column, terms: Column) -> Column:
    """Share of the distinct ``query_terms`` that ``terms`` has; 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query_terms, terms)), F.size(query_terms)), F.lit(0.0))


def content_terms(text: Column, stopwords: list[str] = CONTENT_STOPWORDS) -> Column:
    """Distinct ASCII words of more than two characters outside a stop list."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-z0-9']+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(stopwords)))


def coverage(question: Column, text: Column) -> Column:
    """Share of the question's content terms that the text has."""
    return term_share(content_terms(question), content_terms(text))


def term_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of terms; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def excerpt(text: Column, question: Column, limit: Column, stopwords: list[str] = CONTENT_STOPWORDS, lead_bonus: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The text if it fits ``limit`` words, else its best sentences by shared terms (earlier first on ties) that fit."""
    flat = spaced(F.coalesce(text, F.lit("")))
    terms = content_terms(question, stopwords)
    parts = F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    bonus = lambda i: F.when(i == 0, lead_bonus[0]).when(i == 1, lead_bonus[1]).otherwise(0.0)
    scored = F.transform(parts, lambda s, i: F.struct((-(F.size(F.array_intersect(terms, content_terms(s, stopwords))) + bonus(i))).alias("a"), i.alias("b"), s.alias("s"), F.size(F.split(s, " ")).alias("n")))
    ranked = F.array_sort(scored)
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"), F.lit(False).alias("any"))

    def add(acc, x):
        room = limit - acc["used"]
        cut = F.when(x["n"] > limit, F.array_join(F.slice(F.split(x["s"], " "), F.lit(1), F.greatest(room, F.lit(0))), " ")).otherwise(x["s"])
        cost = F.least(x["n"], F.when(x["n"] > limit, room).otherwise(x["n"]))
        take = (acc["used"] < limit) & (~acc["any"] | (x["n"] <= room))
        joined = F.when(acc["any"], F.concat(acc["out"], F.lit(" "), cut)).otherwise(cut)
        return F.struct(F.when(take, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(take, joined).otherwise(acc["out"]).alias("out"), (acc["any"] | take).alias("any"))

    chosen = F.aggregate(ranked, start, add, lambda acc: acc["out"])
    return F.when(word_count(flat) <= limit, flat).otherwise(chosen)


def normal_answer(text: Column) -> Column:
    """An answer for comparison: lower case, no ASCII punctuation, no articles, single spaces."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return spaced(F.regexp_replace(low, r"(?U)\b(a|an|the)\b", " "))


def _f1(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return float(a == b)
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _token_f1(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([_f1(a.split(), b.split()) for a, b in zip(prediction, gold)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _best_f1(prediction: pd.Series, golds: pd.Series) -> pd.Series:
    return pd.Series([max((_f1(a.split(), b.split()) for b in bs), default=0.0) for a, bs in zip(prediction, golds)], dtype=float)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the multisets of normal tokens; 1 if both are empty, 0 if one is.

    The JVM has no multiset intersection that is linear in the tokens, so normal texts are counted in Arrow batches.
    """
    return _token_f1(normal_answer(prediction), normal_answer(gold))


def best_f1(prediction: Column, golds: Column) -> Column:
    """The best F1 over an array of gold answers; 0 without any."""
    return _best_f1(normal_answer(prediction), F.coalesce(F.transform(golds, normal_answer), F.array().cast("array<string>")))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normal_answer(prediction) == normal_answer(gold)).cast("double")


def parsed_answer(text: Column) -> Column:
    """The first line after the last ``Answer:``, or the last line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    after = F.regexp_replace(F.substring_index(t, "Answer:", -1), r"(?U)^\s+|\s+$", "")
    marked = F.regexp_replace(F.regexp_replace(F.trim(F.get(F.split(after, r"\R"), F.lit(0))), "^\"+|\"+$", ""), r"^'+|'+$|\.+$", "")
    lines = F.split(t, r"\R")
    return F.when(t == "", "").when(t.contains("Answer:"), marked).otherwise(F.regexp_replace(F.trim(F.try_element_at(lines, F.lit(-1))), r"\.+$", ""))


def formatted_passage(rank: Column, title: Column, text: Column) -> Column:
    """``Passage i [title]:`` above the text."""
    head = F.concat(F.lit("Passage "), rank.cast("string"), F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ["), F.trim(title), F.lit("]"))))
    return F.concat(head, F.lit(":\n"), text)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def document_key(title: Column, text: Column) -> Column:
    """What makes two passages the same: spaced lower-case title and text."""
    return F.concat_ws("||", F.lower(spaced(F.coalesce(title, F.lit("")))), F.lower(spaced(F.coalesce(text, F.lit("")))))
