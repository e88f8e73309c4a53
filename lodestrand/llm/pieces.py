"""Problem 6: texts above a size limit cut into overlapping pieces at natural boundaries.

Every possible start of a piece is joined to the farthest boundary it may reach and from there, stepping back by the
overlap, to the start of the piece after it. Squaring that successor table (a join of it with itself) gives the starts
2, 4, 8 ... pieces on, so all cuts of the greedy division come out of a logarithmic number of joins, in parallel within
one text as across texts.

Boundaries are the ends of sentence units; a unit longer than the limit is cut at white space, or, where a stretch has
none, at the limit. Texts at or under the limit, null and empty ones give no pieces.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored
from .sentences import class_table, units

LIMIT, LEAST_OVERLAP, MOST_OVERLAP = 4000, 100, 200


def successors(text: str, first: np.ndarray, last: np.ndarray, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP):
    """(start, end, next start) for every possible start of a piece; next start is -1 at the end of the text.

    ``first`` and ``last`` are the text's sentence units. From an end e the next piece starts at the first unit that
    begins in [e - most, e - least], else at the first word that does, else at e - least.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(raw)
    blank = np.isin(class_table()[raw], (1, 2))
    words = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    finishes = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    natural = np.unique(np.concatenate([last, [n]]))
    room = limit - most
    ends = [natural]
    for a, b in pairwise([0, *natural.tolist()]):
        if b - a > room:
            inner = finishes[(finishes > a) & (finishes < b)]
            edges = np.concatenate([[a], inner, [b]])
            ends.append(inner)
            for x in np.flatnonzero(np.diff(edges) > room).tolist():
                ends.append(np.arange(edges[x] + room, edges[x + 1], room))
    forced = np.unique(np.concatenate(ends))

    def pick(pool: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(pool, low), max(0, len(pool) - 1))
        return np.where((pool[at] >= low) & (pool[at] <= high), pool[at], -1) if len(pool) else np.full(len(low), -1)

    step = np.maximum(forced - least, 0)
    start = pick(first, forced - most, forced - least)
    start = np.where(start >= 0, start, pick(words, forced - most, forced - least))
    start = np.where(start >= 0, start, step)
    starts = np.unique(np.concatenate([[0], start[forced < n]]))

    def reach(pool: np.ndarray) -> np.ndarray:
        at = np.searchsorted(pool, starts + limit, "right") - 1
        return np.where(at >= 0, pool[np.maximum(at, 0)], 0)

    far = reach(natural)
    # a natural end is taken if it lies beyond what the next piece would repeat; else the unit itself has to be cut
    far = np.where(far > starts + most, far, reach(forced))
    after = start[np.searchsorted(forced, far)]
    return starts, far, np.where(far >= n, -1, np.maximum(after, np.minimum(starts + 1, n)))


def successor_table(docs: DataFrame, model, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """doc_id, start, end, next, forced for every possible piece of every text above ``limit``."""
    weights, stripped = model

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, first, last = units([text], weights, stripped)
                start, end, after = successors(text, first, last, limit, least, most)
                forced = bool(len(first)) and bool((last - first > limit).any())
                k = len(start)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * k, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, end, after)), pa.array([forced] * k)], names=["doc_id", "start", "end", "next", "forced"])

    long = docs.filter(F.length("text") > limit).select("doc_id", "text")
    return long.mapInArrow(run, "doc_id long, start int, end int, next int, forced boolean")


def pieces(docs: DataFrame, model, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """doc_id, piece, start_char, end_char, forced: the pieces of every text above ``limit``, numbered from 0.

    ``forced`` tells whether some sentence unit of the text is longer than the limit. Rows repeated under one doc_id
    count once.
    """
    table = stored(successor_table(docs, model, limit, least, most).distinct())
    hop = table.filter("next >= 0").select("doc_id", "start", "next")
    reached = stored(table.filter("start = 0").select("doc_id", "start"))
    while not hop.isEmpty():
        onward = reached.join(hop, ["doc_id", "start"]).select("doc_id", F.col("next").alias("start"))
        reached = stored(reached.union(onward).distinct())
        hop = stored(hop.join(hop.select("doc_id", F.col("start").alias("next"), F.col("next").alias("then")), ["doc_id", "next"]).select("doc_id", "start", F.col("then").alias("next")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return table.join(reached, ["doc_id", "start"]).select("doc_id", number.alias("piece"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), "forced")


def cuts(docs: DataFrame, model, limit: int = LIMIT) -> DataFrame:
    """doc_id, cut: every text that was cut; ``forced`` if a sentence unit alone exceeds the limit, else ``boundary``."""
    return pieces(docs, model, limit).groupBy("doc_id").agg(F.max("forced").alias("f")).select("doc_id", F.when(F.col("f"), "forced").otherwise("boundary").alias("cut"))
