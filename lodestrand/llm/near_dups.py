"""Problem 1: groups of records that share most of their content but for small edits.

DartMinHash: every element (a stretch of ``SHINGLE`` bare characters, weight 1; any weights are supported) has a
region of rank x weight into which hashed darts are thrown; the earliest dart of each coordinate is kept. Equal
coordinates of two signatures come with the probability of their weighted Jaccard similarity. ``BANDS`` bands of
``BAND`` coordinates each give join keys; every candidate pair is then checked exactly on its full texts.

Texts of equal bare text are one class, named by 16 bytes of BLAKE2 over it. Null texts and texts with fewer than
``SHINGLE`` bare characters have no stretches and no partners. Repeated rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..runtime import stored
from .chars import bare_codes, mix, steps, window_hashes

SHINGLE_LOG2 = 3
SHINGLE = 1 << SHINGLE_LOG2
SIMILARITY = 0.6
BAND, BANDS = 5, 60
#: Rows of a bucket that a row meets in one sorted pass.
NEAR = 6
#: What ends a line for problem 4, so that both problems form the same groups.
_LINE_END = re.compile(r"\r\n|[\n\x0b\f\r\x85\u2028\u2029]")
_LABEL_LINE = re.compile(r"^[^:]{1,60}:.*\w|^[\W_]*$")
_U = np.uint64
_UNIT = float(2.0**-64)
_NONE = _U(0xFFFFFFFFFFFFFFFF)
#: Coordinates are a rank, as the bits of its floating-point number (which order as ranks do, however large), with the
#: lowest bits taken by the dart's own hash.
_LOW_BITS = 20
#: Codes of a large bucket in a block; blocks meet one another, so no task and no join key holds a whole bucket.
BLOCK = 256
#: Texts that a task remembers to pass over copies; a copy that it forgot gives its rows again, which changes nothing.
SEEN = 1 << 18


def throw_darts(hashes: np.ndarray, theta: np.ndarray, weights: np.ndarray | None = None):
    """All darts of rank under ``theta`` within each element's region: yields (index of element, rank, dart hash).

    The region of weight w is cut into cells [0, 1), [1, 2), [2, 4) ...; in each cell darts arrive in order of rank at
    a rate equal to its width, at hashed weights, and those at weights under w count. A dart depends only on the
    element, the cell and its number, so equal elements get equal darts in every record.
    """
    top = 1.0 if weights is None or not len(weights) else float(weights.max())
    low, width, cell = 0.0, 1.0, 0
    while low < top:
        at = np.arange(len(hashes)) if weights is None or low == 0 else np.flatnonzero(weights > low)
        h = mix(hashes[at] + _U(0x632BE59BD9B4E019 * (cell + 1) & 0xFFFFFFFFFFFFFFFF))
        rank = np.zeros(len(at))
        limit = theta[at]
        while len(at):
            rank = rank - np.log((h.astype(np.float64) + 1) * _UNIT) / width
            on = np.flatnonzero(rank < limit)
            at, rank, limit = at[on], rank[on], limit[on]
            h = mix(h[on] + _U(0x9E3779B97F4A7C15))
            if weights is None:
                yield at, rank, h
            else:
                hit = low + width * (mix(h).astype(np.float64) * _UNIT) < weights[at]
                yield at[hit], rank[hit], h[hit]
        low, width, cell = low + width, max(1.0, low + width), cell + 1


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The DartMinHash signatures (n x k) of n records; element i, of record owner[i], has hashes[i].

    An element named twice throws the same darts twice, which changes no minimum; only records that lack a coordinate
    after the first throw have their repeated elements dropped before the next. Records without elements keep the
    value 2**64 - 1 throughout.
    """
    out = np.full((n, k), _NONE)
    mass = np.bincount(owner, weights, n)
    theta = np.divide(k * np.log(k) + 2 * k, mass, out=np.zeros(n), where=mass > 0)
    first, todo = theta, np.arange(len(hashes))
    flat = out.reshape(-1)
    while len(todo):
        for at, rank, h in throw_darts(hashes[todo], theta[owner[todo]], None if weights is None else weights[todo]):
            key = (rank.view(_U) >> _U(_LOW_BITS) << _U(_LOW_BITS)) | (h >> _U(64 - _LOW_BITS))
            place = ((h & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)
            np.minimum.at(flat, owner[todo[at]] * k + place.astype(np.int64), key)
        lacking = (out == _NONE).any(axis=1) & (mass > 0)
        if not lacking.any():
            break
        if theta is first:
            todo = np.flatnonzero(lacking[owner])
            todo = todo[np.unique(mix(owner[todo].astype(_U) * _U(0x9E3779B97F4A7C15) + hashes[todo]), return_index=True)[1]]
            mass = np.bincount(owner[todo], None if weights is None else weights[todo], n)
            theta = np.divide(k * np.log(k) + 2 * k, mass, out=np.zeros(n), where=mass > 0)
        else:
            theta = theta * 2
            todo = todo[lacking[owner[todo]]]
    return out


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of the bare texts, and the number of the text each belongs to."""
    low, starts = bare_codes(texts)
    if len(low) < SHINGLE:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = window_hashes(low, SHINGLE_LOG2)
    counts = np.maximum(np.diff(starts) - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[:-1], counts)
    return h[place], owner


def text_key(values: np.ndarray) -> bytes:
    """16 bytes that stand for a run of code points."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def code_of(key: bytes) -> int:
    """The first 8 bytes of a class: what bands carry. Classes that share a code are told apart before the check."""
    return int.from_bytes(key[:8], "big", signed=True)


def _key_rows(batches):
    """(id, title, text) batches to (id, code, class, title_key, lines_key): of bare text, bare title, sorted lines."""
    for batch in batches:
        ids, titles, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
        keys, names, lines = [], [], []
        for a, b in steps([len(t) for t in texts]):
            low, starts = bare_codes(texts[a:b])
            keys += [text_key(low[x:y]) if y - x >= SHINGLE else None for x, y in pairwise(starts.tolist())]
            low, starts = bare_codes(titles[a:b])
            names += [text_key(low[x:y]) for x, y in pairwise(starts.tolist())]
            lines += [_lines_key(t) if ":" in t else None for t in texts[a:b]]
        codes = pa.array([k and code_of(k) for k in keys], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, codes, pa.array(keys, pa.binary()), pa.array(names, pa.binary()), pa.array(lines, pa.binary())], names=["doc_id", "code", "class", "title_key", "lines_key"])


def _lines_key(text: str) -> bytes | None:
    lines = [x for x in _LINE_END.split(text) if x]
    if not all(_LABEL_LINE.search(x) for x in lines):
        return None
    low, starts = bare_codes(lines)
    parts = sorted(low[x:y].tobytes() for x, y in pairwise(starts.tolist()) if y > x)
    return hashlib.blake2b(b"\n\0\0\0".join(parts), digest_size=16).digest()


def _band_rows(batches):
    """(text) batches to (bucket, code), ``BANDS`` rows for each bare text; copies within a task give rows once."""
    seen: set[bytes] = set()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in steps([len(t) for t in texts]):
            low, starts = bare_codes(texts[a:b])
            new = []
            if len(seen) > SEEN:
                seen.clear()
            for i, (x, y) in enumerate(pairwise(starts.tolist())):
                if y - x >= SHINGLE and (key := text_key(low[x:y])) not in seen:
                    seen.add(key)
                    new.append((a + i, key))
            if not new:
                continue
            h, owner = elements([texts[i] for i, _ in new])
            sig = signatures(h, owner, len(new), BAND * BANDS)
            key = np.zeros((len(new), BANDS), _U)
            for j in range(BAND):
                key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, j::BAND])
            key = mix(key + np.arange(BANDS, dtype=_U))
            owners = np.repeat(np.array([code_of(k) for _, k in new], np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(owners)], names=["bucket", "code"])


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard similarities of the sets of stretches, pair by pair."""
    cache: dict[str, np.ndarray] = {}

    def sets(texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in cache]
        h, owner = elements(new)
        for t, part in zip(new, np.split(h, np.searchsorted(owner, np.arange(1, len(new))))):
            cache[t] = np.unique(part)

    out = np.zeros(len(left))
    for a, b in steps([len(x) + len(y) for x, y in zip(left, right)]):
        cache.clear()
        sets(left[a:b] + right[a:b])
        for i in range(a, b):
            x, y = cache[left[i]], cache[right[i]]
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / max(1, len(both) - shared)
    return out


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact Jaccard similarity of two texts' stretches."""
    return pd.Series(jaccard(left.tolist(), right.tolist()))


def member_table(docs: DataFrame) -> DataFrame:
    """doc_id, class, record: the class of equal bare text and the group of problem 4 of every row with a stretch.

    One pass hashes all rows, without moving a text; groups of problem 4 form on the hashes: rows of equal bare title
    and text, or, where one member is made of ``Label: value`` lines, of equal sorted lines. Written to the shared folder.
    """
    keyed = docs.filter("text is not null").select("doc_id", "title", "text").mapInArrow(_key_rows, "doc_id long, code long, class binary, title_key binary, lines_key binary")
    keyed = stored(keyed.filter("class is not null"))
    labelled = keyed.filter("lines_key is not null").select("title_key", "class", "lines_key").distinct()
    joined = keyed.select("doc_id", "code", "title_key", "class").join(labelled, ["title_key", "class"], "left")
    return joined.select("doc_id", "code", "class", F.sha2(F.concat("title_key", F.coalesce("lines_key", "class")), 256).alias("record"))


def candidate_pairs(docs: DataFrame) -> DataFrame:
    """a, b: codes a < b that share a bucket, each pair once.

    Within a bucket, in order of code, every row meets the ``NEAR`` rows before it, in one pass over sorted rows, which
    is all pairs of most buckets. Larger ones (groups of edits, or copies seen by many tasks) are cut into blocks of
    about ``BLOCK`` codes, and every two blocks of a bucket meet under a key of their own: all pairs are compared,
    as the definition of the result asks, but no task gets a whole bucket.
    """
    bands = stored(docs.filter("text is not null").select("text").mapInArrow(_band_rows, "bucket long, code long"))
    order = Window.partitionBy("bucket").orderBy("code")
    met = bands.select("bucket", "code", *[F.lag("code", i).over(order).alias(f"c{i}") for i in range(1, NEAR + 2)]).filter("c1 is not null")
    met = stored(met)
    near = met.select(F.col("code").alias("b"), F.explode(F.array(*[f"c{i}" for i in range(1, NEAR + 1)])).alias("a")).filter("a < b").select("a", "b").distinct()
    large = met.filter(f"c{NEAR + 1} is not null").select("bucket").distinct()
    rows = stored(bands.join(large, "bucket").distinct())
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    left = dealt.select("bucket", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("code").alias("a"))
    right = dealt.select("bucket", F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"), F.col("code").alias("b"))
    more = left.join(right, ["bucket", "x", "y"]).filter("a <> b and (x < y or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.union(more).distinct()


def class_pairs(docs: DataFrame, members: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """a, b, similarity: all pairs of classes at ``threshold`` or above that share a bucket, checked on their full texts."""
    found = stored(candidate_pairs(docs))
    reps = members.groupBy("code", "class").agg(F.min("doc_id").alias("doc_id"))
    ids = stored(found.select(F.explode(F.array("a", "b")).alias("code")).distinct().join(reps, "code"))
    texts = stored(docs.filter("text is not null").select("doc_id", "text").join(ids, "doc_id").select("code", "class", "text"))
    left = texts.select(F.col("code").alias("a"), F.col("class").alias("class_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("code").alias("b"), F.col("class").alias("class_b"), F.col("text").alias("text_b"))
    both = found.join(left, "a").join(right, "b")
    checked = both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), similarity("text_a", "text_b").alias("similarity"))
    return checked.filter(F.col("similarity") >= threshold)


def pairs(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id_a, doc_id_b: pairs of rows at ``threshold`` or above that are not of one group of problem 4."""
    members = stored(member_table(docs))
    linked = class_pairs(docs, members, threshold)
    left = members.select(F.col("class").alias("a"), F.col("doc_id").alias("id_a"), F.col("record").alias("record_a"))
    right = members.select(F.col("class").alias("b"), F.col("doc_id").alias("id_b"), F.col("record").alias("record_b"))
    across = linked.select("a", "b").join(left, "a").join(right, "b")
    mixed = members.groupBy("class").agg(F.min("record").alias("x"), F.max("record").alias("y")).filter("x <> y").select(F.col("class").alias("a"))
    within = left.join(mixed, "a", "left_semi").join(right.withColumnRenamed("b", "a"), "a").filter("id_a < id_b")
    both = across.select("id_a", "id_b", "record_a", "record_b").union(within.select("id_a", "id_b", "record_a", "record_b"))
    return both.filter("record_a <> record_b and id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()


def groups(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id, links: every row with a stretch, its group (smallest id) and its class's number of partners.

    Copies are not expanded into pairs: groups join classes, and members follow their class.
    """
    members = stored(member_table(docs).select("doc_id", "code", "class"))
    linked = stored(class_pairs(docs, members, threshold).select("a", "b"))
    links = linked.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    labels = connected_components(linked).select(F.col("node").alias("class"), "component")
    placed = members.join(labels, "class", "left").join(links, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    return placed.join(least, "component").select("doc_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
