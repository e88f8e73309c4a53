"""Problem 8: held-out questions and passages that appear in documents.

Texts are canonicalised into templates whose windows are joined by hash, and the values in the slots of a hit decide:

* Passages and questions as they stand: over the bare text every digit is a placeholder. Windows of ``span`` characters
  are hashed at every place of the held-out texts and at every ``stride``-th place of a document, so that any common
  stretch of ``length`` characters (75; 24 where the question has Chinese characters) holds a window of both and none
  is lost. A hit is extended to both sides. Equal slots over the length are an exact case; slots that are replaced
  consistently (equal values by equal values) are a re-parameterised one.
* Questions with other values: over the words as they are written, numbers, names (words with a capital, except one that
  only begins a sentence) and units (a word after a number) are typed placeholders; runs of names are one. A window of
  five symbols (ten in Chinese and Japanese) of each question, the one with the most letters outside slots, is joined with
  all windows of the documents; the whole question must follow around it, with consistent slots. A question repeated word
  for word is found so too, however short.

Documents are read once whatever the size of the held-out set. What tasks get of it is a table of ``1 << BITS`` bits; it
passes over windows that no held-out text has, and the rest meet in a shuffled hash join. Held-out texts that several
samples share are indexed once. Null texts and texts shorter than a window match nothing; samples with null members use
those they have; repeated rows give one row.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_side, stored
from .chars import bare_codes, mix, steps

#: (length of a stretch, window, step between the windows of a document) of other texts and of those with Chinese questions.
PLAIN, HAN = (75, 44, 32), (24, 12, 13)
BITS = 24
HELD_OUT = ("test", "validation", "dev")
WORDS, WORDS_HAN = 5, 10
#: Least letters outside slots that a question must have to be looked for as a template.
LITERAL, LITERAL_HAN = 12, 6
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_HAN = "一-鿿㐀-䶿"
_DIGITS = str.maketrans("0123456789", "0" * 10)


# ---- windows of bare text -------------------------------------------------------------------------------------------


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _B), np.full(n + 1, _B_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Templates:
    """Prefix hashes over the bare texts of a batch with a placeholder for digits: a window's hash is one subtraction."""

    def __init__(self, texts: list[str]):
        self.low, self.starts = bare_codes(texts)
        self.up, self.down = _powers(1 << max(12, len(self.low).bit_length()))
        symbols = np.where((self.low >= 48) & (self.low <= 57), np.uint32(48), self.low).astype(np.uint64)
        self.prefix = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(mix(symbols + np.uint64(1)) * self.up[: len(self.low)], out=self.prefix[1:])

    def windows(self, span: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of text, place, hash) of the windows at every ``stride``-th place of each text."""
        counts = np.maximum((np.diff(self.starts) - span) // stride + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * stride + self.starts[owner]
        return owner, place, mix((self.prefix[place + span] - self.prefix[place]) * self.down[place] + np.uint64(span))

    def cut(self, text: int, a: int, b: int) -> tuple[str, int]:
        """The bare characters from a to b of a text, as far as it has them, and how many of them lie before a's window."""
        a, b = max(a, int(self.starts[text])), min(b, int(self.starts[text + 1]))
        return self.low[a:b].tobytes().decode("utf-32-le", "surrogatepass"), a


def _index_rows(batches):
    """(key, han, text) to (hash, key, place): all windows of held-out texts."""
    for batch in batches:
        keys, han, texts = (c.to_pylist() for c in batch.columns)
        for a, b in steps([len(t) for t in texts]):
            for kind, (_, span, _) in ((False, PLAIN), (True, HAN)):
                at = [i for i in range(a, b) if han[i] == kind]
                t = Templates([texts[i] for i in at])
                owner, place, h = t.windows(span)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array([keys[i] for i in at], np.int64)[owner]), pa.array(place - t.starts[owner])], names=["hash", "key", "place"])


def bit_table(hashes: DataFrame) -> np.ndarray:
    """One bit for every value of the first ``BITS`` bits of a 64-bit hash: whether ``hashes`` (hash) has it.

    Bits are combined by 64 before they reach the driver, which gets at most ``1 << BITS - 6`` rows.
    """
    slots = hashes.select(F.shiftrightunsigned("hash", 64 - BITS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.astype("<i8").view(np.uint8)


def passed(table: np.ndarray, hashes: np.ndarray) -> list[int]:
    """Places of the hashes whose bit is set."""
    slot = hashes >> np.uint64(64 - BITS)
    return np.flatnonzero(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).tolist()


def extent(context: str, left: int, text: str, place: int, span: int) -> tuple[int, int]:
    """How far two texts agree before and after a window that both have."""
    i = j = 0
    while left - i > 0 and place - i > 0 and context[left - i - 1] == text[place - i - 1]:
        i += 1
    a, b = left + span, place + span
    while a + j < len(context) and b + j < len(text) and context[a + j] == text[b + j]:
        j += 1
    return i, j


def consistent(pairs) -> bool:
    """Whether equal values stand for equal values in (left, right) pairs."""
    there, back = {}, {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


def verdict(context: str, left: int, text: str, place: int, length: int, span: int) -> bool | None:
    """True if a document's stretch and a held-out text agree over ``length`` characters around a common window, False if
    they do but for numbers that are replaced consistently, None otherwise."""
    if context[left : left + span] == text[place : place + span]:
        i, j = extent(context, left, text, place, span)
        if i + span + j >= length:
            return True
    a, b = context.translate(_DIGITS), text.translate(_DIGITS)
    if a[left : left + span] != b[place : place + span]:
        return None
    i, j = extent(a, left, b, place, span)
    if i + span + j < length:
        return None
    runs = re.finditer(r"(?<=\D)\d+(?=\D)", context[left - i : left + span + j])
    slots = [(m.group(), text[place - i + m.start() : place - i + m.end()]) for m in runs]
    letters = sum(c != "0" for c in a[left - i : left + span + j])
    return False if slots and any(x != y for x, y in slots) and consistent(slots) and letters * 2 >= length else None


def _verified(batches):
    """(doc_id, context, left, key, han, bare text, place) to (doc_id, key, han, exact)."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for doc, context, left, key, han, text, place in zip(*(c.to_pylist() for c in batch.columns)):
            length, span, _ = HAN if han else PLAIN
            exact = verdict(context, left, text, place, length, span)
            if exact is not None:
                for part, x in zip(rows, (doc, key, han, exact)):
                    part.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["doc_id", "key", "han", "exact"])


# ---- questions as templates of words --------------------------------------------------------------------------------

_TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|[{_HAN}ぁ-ヿ]|[^\W\d_{_HAN}ぁ-ヿ]+(?:['’][^\W\d_]+)*|[.!?…:。！？\"“„«]")
_STARTS = set(".!?…:。！？\"“„«")
_WIDE = re.compile(rf"[{_HAN}ぁ-ヿ]")


def symbols(text: str) -> list[str]:
    """The template of a text: ``w`` and a word in small letters, or a typed placeholder and its value (``N`` names, ``#`` numbers, ``u`` units)."""
    found = _TOKEN.findall(text)
    out: list[str] = []
    start = True
    for i, t in enumerate(found):
        if t in _STARTS:
            start = True
            continue
        if t[0].isdigit():
            out.append("#" + t)
        elif out and out[-1][0] == "#" and not start and t[0].islower():
            out.append("u" + t)
        elif t[0].isupper() and (not start or i + 1 < len(found) and found[i + 1][0].isupper()):
            if out and out[-1][0] == "N" and not start:
                out[-1] += " " + t
            else:
                out.append("N" + t)
        else:
            out.append("w" + t.lower())
        start = False
    return out


@cache
def _symbol_hash(symbol: str) -> int:
    return xxhash.xxh64_intdigest(symbol)


def window_hashes(said: list[str], size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` symbols, placeholders by their type."""
    if len(said) < size:
        return np.zeros(0, np.uint64)
    h = np.fromiter((_symbol_hash(s) if s[0] == "w" else ord(s[0]) for s in said), np.uint64, len(said))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * _B + h[k : len(h) - size + 1 + k] + np.uint64(size))
    return out


def _letters(said: list[str]) -> int:
    return sum(len(s) - 1 for s in said if s[0] == "w")


def _question_rows(batches):
    """(key, question) to (hash, key, place, said): each question's template and the window that it is looked for by."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for key, question in zip(*(c.to_pylist() for c in batch.columns)):
            said = symbols(question)
            wide = bool(_WIDE.search(question))
            size = WORDS_HAN if wide else WORDS
            if len(said) >= size and _letters(said) >= (LITERAL_HAN if wide else LITERAL):
                h = window_hashes(said, size).view(np.int64).tolist()
                # the first word may be written with a capital or without, so windows after it are better
                best = max(range(len(h) > 1, len(h)), key=lambda i: (_letters(said[i : i + size]), -i))
                for part, x in zip(rows, (h[best], key, best, said)):
                    part.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())))], names=["hash", "key", "place", "said"])


def same_question(asked: list[str], said: list[str], start: int) -> bool:
    """Whether a question's template stands at a place of a document's, with consistent slots."""
    if start < 0 or start + len(asked) > len(said):
        return False
    slots = []
    for i, (a, b) in enumerate(zip(asked, said[start : start + len(asked)])):
        if i == 0 and a[0] == "w" and b[0] == "N" and a[1:] == b[1:].lower():
            continue
        if a[0] != b[0] or a[0] == "w" and a != b:
            return False
        if a[0] != "w":
            slots.append((a, b))
    return consistent(slots)


def _asked_again(batches):
    """(doc_id, said, at, key, place, asked) to (doc_id, key) of questions that stand in documents."""
    for batch in batches:
        rows: list[list] = [[], []]
        for doc, said, at, key, place, asked in zip(*(c.to_pylist() for c in batch.columns)):
            if same_question(asked, said, at - place):
                rows[0].append(doc)
                rows[1].append(key)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "key"])


# ---- the operators --------------------------------------------------------------------------------------------------


def held_out(samples: DataFrame) -> DataFrame:
    """sample_id, question, key, han, text: the questions and documents of held-out rows."""
    rows = samples.filter(F.col("split").isin(*HELD_OUT) & F.col("sample_id").isNotNull())
    texts = F.array_distinct(F.array_append(F.transform(F.coalesce("documents", F.array()), lambda x: x["text"]), F.col("question")))
    made = rows.select("sample_id", "question", F.coalesce(F.col("question").rlike(f"[{_HAN}]"), F.lit(False)).alias("han"), F.explode(texts).alias("text")).filter("text is not null")
    return made.withColumn("key", F.xxhash64("text", "han"))


def _bare_rows(batches):
    """(key, han, text) to the same with bare texts."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        made = []
        for a, b in steps([len(t) for t in texts]):
            t = Templates(texts[a:b])
            made += [t.cut(i, 0, len(t.low))[0] for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["key", "han", "bare"])


def stretches(docs: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, sample_id, exact: stretches of held-out texts, as they stand or with other numbers."""
    texts = stored(held.select("key", "han", "text").distinct())
    index = stored(texts.mapInArrow(_index_rows, "hash long, key long, place long"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(index))

    def hits(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], []]
            for a, b in steps([len(t) for t in texts]):
                t = Templates(texts[a:b])
                for length, span, stride in (PLAIN, HAN):
                    owner, place, h = t.windows(span, stride)
                    for i in passed(table.value, h):
                        p = int(place[i])
                        context, begin = t.cut(int(owner[i]), p - (length - span), p + length)
                        for part, x in zip(rows, (int(h[i].view(np.int64)), int(ids[a + owner[i]]), context, p - begin)):
                            part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["hash", "doc_id", "context", "left"])

    found = docs.filter("text is not null").select("doc_id", "text").mapInArrow(hits, "hash long, doc_id long, context string, left long")
    bodies = small_side(stored(texts.mapInArrow(_bare_rows, "key long, han boolean, bare string")))
    met = found.join(index, "hash").join(bodies, "key").select("doc_id", "context", "left", "key", "han", "bare", "place")
    checked = met.mapInArrow(_verified, "doc_id long, key long, han boolean, exact boolean").groupBy("doc_id", "key").agg(F.max("exact").alias("exact"))
    return checked.join(small_side(stored(held.select("key", "sample_id").distinct())), "key").groupBy("doc_id", "sample_id").agg(F.max("exact").alias("exact"))


def questions(docs: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, sample_id: held-out questions that stand in documents, with the same or other values in their slots."""
    asked = held.filter("question is not null").select(F.xxhash64("question").alias("key"), "question").distinct()
    index = stored(asked.mapInArrow(_question_rows, "hash long, key long, place int, said array<string>"))
    longest = index.agg(F.max(F.size("said"))).first()[0] or 0
    table = docs.sparkSession.sparkContext.broadcast(bit_table(index))

    def hits(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = symbols(text)
                for size in (WORDS, WORDS_HAN):
                    h = window_hashes(said, size)
                    for i in passed(table.value, h):
                        a = max(0, i - longest)
                        for part, x in zip(rows, (int(h[i].view(np.int64)), doc, said[a : i + longest], i - a)):
                            part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32()))], names=["hash", "doc_id", "said", "at"])

    found = docs.filter("text is not null").select("doc_id", "text").mapInArrow(hits, "hash long, doc_id long, said array<string>, at int")
    met = found.join(index.withColumnRenamed("said", "asked"), "hash").select("doc_id", "said", "at", "key", "place", "asked")
    again = met.mapInArrow(_asked_again, "doc_id long, key long").distinct()
    return again.join(small_side(stored(held.select(F.xxhash64("question").alias("key"), "sample_id").distinct())), "key").select("doc_id", "sample_id").distinct()


def leaks(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, sample_id, exact: documents that hold a held-out text, exactly or with other values in its slots."""
    held = stored(held_out(samples))
    both = stretches(docs, held).union(questions(docs, held).select("doc_id", "sample_id", F.lit(False)))
    return both.groupBy("doc_id", "sample_id").agg(F.max("exact").alias("exact"))


def found(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, sample_id of the exact cases."""
    return stretches(docs, stored(held_out(samples))).filter("exact").select("doc_id", "sample_id")
