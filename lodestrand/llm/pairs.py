"""Problem 3: defective question-answer pairs, with the type of their defect.

Each answer field is judged against its row's question, in this order, the first that holds:

* ``empty``: null, or nothing left once a lead-in such as ``Answer:`` and everything but letters and digits is gone, or
  a placeholder for nothing.
* ``copies_question``: what is left once the question's own wording is taken out is at most filler.
* ``refusal``: openings are clustered by MinHash (DartMinHash signatures, bands, verified similarity). A cluster is a
  refusal template if it recurs across unrelated questions, whatever its wording: the other fields beside it differ from
  question to question, while hardly any of its answers shares a content word with its question or agrees with the other
  field. True answers that recur ("no", "copper") agree where they are right. Openings that recur too seldom to tell are
  held against known wording, in their first two sentences.
* ``other_language``: script or function words belong to another language than the question's, and none to its own.
* ``truncated``: the text breaks off: against the row's other answer, inside a word (a fragment that hardly ever
  stands at its place in the collection, while longer words that begin with it do), or inside a sentence (an
  ending that the collection's finished sentences do not have).

Counts cover all answers; words are counted once per question and text, so that copies do not vouch for themselves.
Null and empty questions leave the checks against the question out; repeated rows are judged alike; texts are judged
whole, however long. At most one defect per field. Contexts and places are counted by 64-bit hashes.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import small_side, stored
from .chars import mix, window_hashes
from .near_dups import signatures

#: Openings: characters taken, band layout, least similarity.
OPENING, BAND, BANDS, ALIKE = 32, 4, 20, 0.6
#: Openings of a bucket that one meets in order.
NEAR = 8
#: Openings of a larger bucket that all others of it are compared with at first.
LEADERS = 16
#: Openings of a larger bucket, about, that meet as many others under one key.
BLOCK = 256
#: A template's answers have to do with their row in at most the first share of cases; true answers in at least the
#: second; and the cases must be so many that the first would come by chance with a probability under the third.
LOOSE, BOUND, CHANCE = 0.25, 0.6, 1e-3
#: Share of endings at which a context counts as one that finished sentences have.
ENDS = 0.15
#: Occurrences that make a context before a word telling, and the most of a fragment there, as a share of its longer words.
TELLING, BROKEN = 5, 0.01

# Lead-ins, placeholders, fillers.
_LEAD = re.compile(r"^\W*(?:(?:final\s+)?answer|a|antwort|réponse|respuesta|ответ|答案|答)\s*[:：]\s*", re.I)
_NOTHING = {"", "na", "null", "none", "nan", "nil", "tbd", "nichts", "aucun", "nada", "undefined", "empty", "blank", "nothing", "пусто", "нет", "无", "空"}
_FILLER = set("answer question the is asks asked about of this my your repeat to for it a an q a here and die der das frage antwort lautet la le question pregunta es que est ответ вопрос 问题 答案 是 问 的".split())
# How refusals are worded.
_REFUSALS = re.compile(
    "|".join(
        (
            r"\b(?:can'?t|can’t|cannot|can not|could not|couldn'?t|unable to|not able to|not possible|impossible|decline|refuse)\b.{0,70}\b(?:answer|determin\w*|say|tell|provide|give|respond|derived?|find|identify|know|help|comment)\b",
            r"\b(?:do(?:es)? not|don'?t|don’t|doesn'?t|did not|didn'?t)\b.{0,40}\b(?:know|mention|specify|state|contain|say|have enough|have sufficient|provide|include|answer|give|indicate|tell|support)\b",
            r"\b(?:insufficient|not enough|no|lack of|lacks)\b.{0,24}\b(?:information|evidence|answer|context|data|details?|mention|indication)\b",
            r"\bnot (?:mentioned|specified|stated|answerable|available|provided|given|found|clear|known)\b",
            r"\b(?:kann|können|lässt|lassen|konnte)\b.{0,70}\b(?:nicht|kein\w*)\b.{0,60}(?:beantwort|sagen|bestimm|angeben|feststell|ermitteln|entnehmen|antworten|helfen)",
            r"\bkeine?n?\b.{0,20}(?:angabe|information|antwort|hinweis|auskunft)|\bweiß\b.{0,12}\bnicht\b|\bnicht (?:erwähnt|genannt|angegeben|möglich)\b",
            r"\bn[e'’]\s?(?:peux|peut|pouvons|permet\w*|contien\w*|mentionn\w*|précis\w*|di\w*|sai\w*|donn\w*|fourni\w*|indiqu\w*|ai|figure)\b.{0,40}\b(?:pas|aucune?)\b|\baucune? (?:information|réponse|indication|mention)|impossible d[e'’]",
            r"\bno (?:puedo|podemos|se puede|es posible|contien\w*|mencion\w*|especific\w*|sé|indica\w*|dice\w*|hay (?:información|datos|respuesta|suficiente)|aparece|permit\w*|tengo|dispongo|consta)\b|\bninguna (?:información|respuesta)|\bimposible (?:de|responder|saber)",
            r"\bне (?:могу|можем|могла?|удалось|указан\w*|содерж\w*|упомина\w*|знаю|сообща\w*|говорится|хватает|позволя\w*|представляется)|\bнет\b.{0,20}(?:сведений|данных|ответа|информации)|невозможно|недостаточно",
            r"无法|不能(?:回答|确定|提供)|没有(?:提到|提及|说明|足够|相关|给出|答案|信息|任何)|未(?:提及|说明|提到|给出)|不知道|信息不足|不清楚|分かりません|わかりません|答えられません|記載がありません|नहीं (?:दे|बता|जान)|لا (?:أستطيع|يمكن|أعرف|تذكر|توجد)",
        )
    ),
    re.I,
)
# Function words by language, none shared.
_FUNCTION = {
    "en": "the was were is are did does has had his her its their by for with from to at on as that this which who whom when where how why what and between only into about most some many other",
    "de": "der das und ist war wurde wurden von für mit dem den ein eine einer eines im am zum zur hat haben bei nicht nach über dort wann wer wie warum wo welche viel vom wirklich ihre",
    "fr": "le les des du est était fut une et dans pour avec sur par au aux qui que ses son sa leur ont quand où comment pourquoi quel quelle soit dit près cette",
    "es": "el los las del fue una y en por con para que se su sus al cuándo quién dónde cómo cuál es desde hasta entre muy ha cerca dijo",
}
_FUNCTION_SETS = {k: set(v.split()) for k, v in _FUNCTION.items()}
_LINKS = set("the of for and a an de la le les du der die das und von el los del y e et in".split())
_INVERTED = re.compile(r",\s*[A-Z]\w*\.?\s+(?:of|for)$")
_DANGLING = set("the of and for with a an to by from in at on or but because which that see der die das und von mit für dem den ein eine de la le les du et un une dans pour el los las y en un una con para и в на с по из от к у".split())
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_HAN, _KANA, _CYRILLIC, _ARABIC, _DEVANAGARI, _LATIN = (re.compile(x) for x in ("[一-鿿㐀-䶿]", "[ぁ-ヿ]", "[Ѐ-ӿ]", "[؀-ۿ]", "[ऀ-ॿ]", "[A-Za-zÀ-ɏ]"))
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？।؟])(?=\S)")
_FINISHED = re.compile(r"[.!?。！？।؟…]\W*$")
_HALT = re.compile(r"[,;:(\[{„“«「《\-–—、，；：]\s*$")


_FUNCTION_OF = {w: k for k, v in _FUNCTION_SETS.items() for w in v}
_QUOTED = re.compile(r"[\"“„«「『].*?[\"”“»」』]")
_OTHER_SCRIPT = re.compile("[一-鿿ぁ-ヿЀ-ӿ؀-ۿऀ-ॿ]{4}")
_NOT_BARE = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """Letters and digits in lower case."""
    return _NOT_BARE.sub("", text).lower()


def language(text: str, least: int = 1) -> str | None:
    """The language of a text by script, or by function words for Latin script; None if too little tells."""
    best = "latin"
    if text.isascii():
        if not _LATIN.search(text):
            return None
    else:
        counts = {k: len(p.findall(text)) for k, p in (("zh", _HAN), ("ja", _KANA), ("ru", _CYRILLIC), ("ar", _ARABIC), ("hi", _DEVANAGARI), ("latin", _LATIN))}
        if counts["ja"] * 8 > counts["zh"] and counts["ja"] > 1:
            counts["ja"] += counts.pop("zh")
        best = max(counts, key=counts.get)
        if not counts[best]:
            return None
    if best != "latin":
        return best
    hits = dict.fromkeys(_FUNCTION_SETS, 0)
    for w in _WORD.findall(text):
        if k := _FUNCTION_OF.get(w) or ("'" in w or "’" in w) and w.islower() and _FUNCTION_OF.get(w.replace("’", "'").split("'")[0]):
            hits[k] += 1
    lead = _WORD.match(text.lstrip("¿¡\"«„“ "))
    if lead and (k := _FUNCTION_OF.get(lead.group().lower())):
        hits[k] += 1
    top = sorted(hits.values())
    return max(hits, key=hits.get) if top[-1] >= least and top[-1] > top[-2] else None


_SAYS = re.compile(r"(?:[^\W_][\W_]*){10}")


def said(answer: str | None) -> str | None:
    """What an answer says after its lead-in; None if that is nothing."""
    if answer is None:
        return None
    body = _LEAD.sub("", answer).strip()
    return None if not _SAYS.search(body) and bare(body) in _NOTHING else body


def is_empty(answer: str | None) -> bool:
    return said(answer) is None


def is_copy(question: str | None, answer: str, q: str | None = None) -> bool:
    """Nothing but the question's wording (once or more) and fillers, most of the question being there.

    ``q`` may give the bare question.
    """
    q = bare(question or "") if q is None else q
    if not q or len(answer) * 3 < len(q):  # words and fillers cannot make up for so much
        return False
    a = bare(_LEAD.sub("", answer))
    if q in a:
        return not a.replace(q, "")
    if len(a) * 3 < len(q) or len(a) > 3 * len(q):
        return False
    one = _HAN if _HAN.search(q) else _WORD
    asked = {w.lower() for w in one.findall(question)}
    words = [w.lower() for w in one.findall(answer)]
    if any(w not in asked and w not in _FILLER for w in words):
        return False
    return len(words) * 4 <= len(one.findall(question)) * 5 and len(asked.intersection(words)) >= 0.75 * len(asked)


def is_other_language(question: str | None, answer: str) -> bool:
    """Whether an answer is wholly in another language than its question."""
    if answer.isascii() and (" " not in answer or answer.count(" ") < 3 and (question or "").isascii()):
        return False  # too few words to tell
    asked = language(question or "")
    if not asked:
        return False
    text = _QUOTED.sub(" ", answer)
    told = language(text, 2) or (language(answer, 2) if text != answer else None)
    if not told or asked == told:
        return False
    if told in _FUNCTION_SETS:
        mine = _FUNCTION_SETS.get(asked, set())
        words = [w for w in _WORD.findall(answer) if w.islower()]
        if asked not in _FUNCTION_SETS:
            return not _OTHER_SCRIPT.search(text)
        return len(words) >= 4 and sum(w in mine for w in words) * 4 <= sum(w in _FUNCTION_SETS[told] for w in words)
    script = {"zh": _HAN, "ja": _KANA, "ru": _CYRILLIC, "ar": _ARABIC, "hi": _DEVANAGARI}[told]
    return len(script.findall(answer)) >= 6 and len(_LATIN.findall(answer)) * 3 < len(answer)


_HAN_RUN = re.compile("[一-鿿㐀-䶿]{2,}")


def content(text: str | None) -> tuple[set[str], set[str]]:
    """(telling words, all words) of a text: words of more than three letters, numbers and pairs of Chinese characters tell."""
    words = {w.lower() for w in _WORD.findall(text or "")}
    telling = {w for w in words if len(w) > 3 or w[0].isdigit()}
    if text and not text.isascii():
        pairs = {r[i : i + 2] for r in _HAN_RUN.findall(text) for i in range(len(r) - 1)}
        telling = {w for w in telling if not _HAN.search(w)} | pairs
    return telling, words


def has_to_do(answer: tuple, question: tuple, other: tuple) -> bool:
    """Whether an answer (``content``) shares a telling word with its question or agrees with the other answer."""
    return bool(answer[0] & question[0]) or bool(answer[0] & other[0]) or bool(other[1]) and other[1] <= answer[1]


def against_other(answer: str, other: str | None) -> bool | None:
    """Whether ``answer`` breaks off compared with the row's other answer; None if that one does not continue it."""
    b = (other or "").strip()
    if len(b) + 8 < len(answer):
        return None
    a = _LEAD.sub("", answer).strip().strip("\"'“”")
    if len(a) < 2 or len(b) <= len(a) or not b.lower().startswith(a.lower()):
        return None
    rest = b[len(a) :]
    if not re.search(r"\w", rest):
        return False
    if a[-1].isalnum() and rest[0].isalnum():
        return True if len(a) > 4 or _HAN.search(a) else None
    if _FINISHED.search(a):
        return False
    return True if is_sentence(a) else None


def is_sentence(text: str) -> bool:
    """Whether a text is more than a name or a value: it has words in small letters beside articles and the like."""
    if _HAN.search(text):
        return len(tokens(text)) >= 8
    words = _WORD.findall(text)
    return len(words) >= 4 and sum(w[0].islower() and w not in _LINKS for w in words) >= 2


def without_question(question: str | None, answer: str) -> str:
    """The answer after the question it restates, if it does."""
    q = (question or "").strip().rstrip("?？.。 ")
    return answer[len(q) :].lstrip("?？.。:： \n") if q and answer.lower().startswith(q.lower()) else answer


def tokens(text: str) -> list[str]:
    """Words, single Chinese or Japanese characters, with numbers as 9 and capitalised words as N."""
    out = []
    for w in re.findall(r"[一-鿿㐀-䶿ぁ-ヿ]|[^\W\d_一-鿿㐀-䶿ぁ-ヿ]+|\d+", text):
        out.append("9" if w[0].isdigit() else "N" if w[0].isupper() else w)
    return out


_END = "\x1e"
_H = "一-鿿㐀-䶿ぁ-ヿ"
_TOKEN = re.compile(rf"[{_H}]|[^\W\d_{_H}]+|\d+|{_END}|[.!?](?=\s+[^\s{_END}])|[。！？।؟](?=[^\s{_END}])|[.!?。！？।؟…](?=[^\w{_END}]*{_END})")
_BREAKS = set(".!?。！？।؟…")


@cache
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _kind_hash(token: str) -> int:
    """Words and characters by themselves, numbers as 9, capitalised words as N; marks and ends of texts as 0 and 1."""
    if token == _END:
        return 1
    if token in _BREAKS:
        return 0
    return _word_hash("9" if token[0].isdigit() else "N" if token[0].isupper() else token)


class _Kinds(dict):
    def __missing__(self, token):
        value = self[token] = (_kind_hash(token), bool(_HAN.match(token)))
        return value


def contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, end, done, text): the runs of 2 to 4 tokens (to 6 in sentences with Chinese characters) of every sentence.

    ``end`` marks the last run of its length in a sentence, ``done`` those whose sentence has its final mark, and
    ``text`` numbers the texts.
    """
    found = _TOKEN.findall(_END.join([*texts, ""]).replace("\x00", " ")) if texts else []
    kinds = _Kinds()
    pairs = [kinds[t] for t in found]
    h = np.fromiter((p[0] for p in pairs), np.uint64, len(pairs))
    han = np.fromiter((p[1] for p in pairs), bool, len(pairs))
    stop = h < 2
    number = np.cumsum(h == 1) - (h == 1)
    nth = np.cumsum(stop) - stop  # the sentence of a token; a mark and an end close it
    has_han = np.zeros(int(stop.sum()) + 1, bool)
    has_han[nth[han]] = True
    closed = h[stop] == 0
    out: list[tuple] = []
    run = h
    for n in range(2, 7):
        if len(h) < n:
            break
        run = mix(run[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :])
        inside = (nth[n - 1 :] == nth[: len(h) - n + 1]) & ~stop[n - 1 :] & ~stop[: len(h) - n + 1]
        if n > 4:
            inside &= has_han[nth[: len(h) - n + 1]]
        at = np.flatnonzero(inside)
        last = stop[np.minimum(at + n, len(h) - 1)]
        out.append((run[at] + np.uint64(n), last, closed[nth[at]] if len(closed) else last, number[at]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def endings(texts: list[str]) -> list[list[int]]:
    """The contexts that end each text (one sentence, without a final mark), the longest first."""
    key, end, _, number = contexts(texts)
    out: list[list[int]] = [[] for _ in texts]
    for k, i in zip(key[end].view(np.int64).tolist(), number[end].tolist()):
        out[i].insert(0, k)
    return out


def _counts(batches):
    """Per batch: contexts with how often they end a finished sentence or go on."""
    for batch in batches:
        key, end, done, _ = contexts([t for column in batch.columns for t in column.to_pylist() if t and len(t) > 1])
        kept = done | ~end
        keys, back = np.unique(key[kept], return_inverse=True)
        ends = np.bincount(back, end[kept], len(keys)).astype(np.int64)
        goes = np.bincount(back, ~end[kept], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ends), pa.array(goes)], names=["key", "ends", "goes"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LEVELS = np.array([[(level * 4 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(4)] for level in (1, 2)], np.uint64)
#: The place of a word anywhere.
ANYWHERE = 0


def _kind(word: str) -> str:
    return "9" if word[0].isdigit() else "N" if word[0].isupper() else word


def placed_words(body: str) -> list[tuple[str, list[int]]]:
    """Every word in small letters with its places, the closest first: after the word before it, after a word of that
    kind, anywhere. A word after nothing, or a last one after fillers alone, stands anywhere only."""
    found = list(_WORD.finditer(body))
    said = [m.group() for m in found]
    alone = all(w.lower() in _FILLER for w in said[:-1])
    out = []
    for i, w in enumerate(said):
        places = [ANYWHERE]
        if i and not (alone and i == len(said) - 1):
            k = w[0].isupper() * 2 + ("," in body[found[i - 1].end() : found[i].start()])
            places = [_signed(_word_hash(x) ^ int(_LEVELS[level, k])) for level, x in ((1, said[i - 1].lower()), (0, _kind(said[i - 1])))] + [ANYWHERE]
        out.append((w.lower(), places))
    return out


class _Pieces(dict):
    """By word: its number among the batch's words in small letters, the hashes of itself and its kind, its capital."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, word):
        low = word.lower()
        value = self[word] = (self.words.setdefault(low, len(self.words)), _word_hash(low), _word_hash(_kind(word)), word[0].isupper())
        return value


def open_end(body: str) -> bool:
    """Whether a text is more than a name or a value and its last word has nothing after it: it may be broken off."""
    return body[-1:].isalnum() and is_sentence(body)


_PIECE = re.compile(rf"{_WORD.pattern}|,")


def _placed(batches):
    """(text) to (place, word, n): the words of every text by place, without those that may be broken off."""
    for batch in batches:
        known, rows, first = _Pieces(), [], []
        comma: list[bool] = []
        for text in batch.column(0).to_pylist():
            if len(text) < 2:
                continue
            body = _LEAD.sub("", text).strip()
            found = _PIECE.findall(body)
            said = [w for w in found if w != ","] if "," in body else found
            if not said:
                continue
            alone = all(w.lower() in _FILLER for w in said[:-1])
            if open_end(body):
                said = said[:-1]
            elif alone and len(said) > 1:
                rows.append(known[said[-1]])
                first.append(True)
                comma.append(False)
                said = said[:-1]
            if not said:
                continue
            rows.extend([known[w] for w in said])
            first.append(True)
            first.extend([False] * (len(said) - 1))
            if said is found or "," not in found:
                comma.extend([False] * len(said))
            else:
                after = [b == "," for b in ["", *found[:-1]]]
                comma.extend([c for w, c in zip(found, after) if w != ","][: len(said)])
        n = len(rows)
        word, own, kind, capital = (np.fromiter((r[i] for r in rows), t, n) for i, t in enumerate((np.int64, np.uint64, np.uint64, np.int64)))
        later = np.flatnonzero(~np.array(first, bool))
        k = capital[later] * 2 + np.array(comma, np.int64)[later]
        at = np.concatenate([own[later - 1] ^ _LEVELS[1, k], kind[later - 1] ^ _LEVELS[0, k], np.zeros(n, np.uint64)])
        word = np.concatenate([word[later], word[later], word])
        keys, start, counts = np.unique(mix(at) + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        names = pa.array(list(known.words), pa.string()).take(pa.array(word[start]))
        yield pa.RecordBatch.from_arrays([pa.array(at[start].view(np.int64)), names, pa.array(counts.astype(np.int64))], names=["place", "word", "n"])


_JUDGED = "id long, field string, defect string, cue boolean, tied boolean, opening string, asked long, other long, fragment string, places array<long>, itself long, keys array<long>"
_JUDGED_TYPES = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]


def _long(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text))


def opening_of(body: str) -> str:
    """The first ``OPENING`` characters of what an answer says whatever it is about: its words in small letters, with
    one n for names (words with a capital, but for a first word that no other follows) and one 9 for numbers."""
    out: list[str] = []
    size = 0
    words = _WORD.finditer(body)
    at, after = next(words, None), next(words, None)
    while at is not None and size <= OPENING:
        w = at.group()
        capital = w[0].isupper() and (out or after is not None and after.group()[0].isupper())
        told = "n" if capital else "9" if w[0].isdigit() else w.lower()
        if told not in ("n", "9") or not out or out[-1] != told:
            out.append(told)
            size += len(told) + 1
        at, after = after, next(words, None)
    return " ".join(out)[:OPENING]


def head(body: str) -> str:
    """The first two sentences of an answer."""
    return " ".join(_SENTENCES.split(body, 2)[:2])


def _judge(batches):
    """(id, question, gold, predicted) to one row per field: what is settled at once, and what the counts settle."""
    for batch in batches:
        out: list[list] = [[] for _ in range(12)]
        lasts: list[str] = []
        waiting: list[int] = []
        for rid, question, gold, predicted in zip(*(c.to_pylist() for c in batch.columns)):
            q = bare(question) if question else ""
            bodies = [said(predicted), said(gold)]
            contents = None
            for i, field in enumerate(("predicted_answer", "gold_answer")):
                other, body, against = (gold, predicted)[i], bodies[i], bodies[1 - i]
                defect = opening = fragment = places = itself = asked_hash = other_hash = None
                cue = tied = False
                if body is None:
                    defect = "empty"
                elif is_copy(question, body, q):
                    defect = "copies_question"
                else:
                    told = opening_of(body)
                    if len(told) >= 8:
                        opening = told
                        cue = bool(_REFUSALS.search(head(body)))
                        contents = contents or [content(x) for x in (*bodies, question)]
                        tied = has_to_do(contents[i], contents[2], contents[1 - i])
                        if against is not None and q:
                            asked_hash, other_hash = _long(q), _long(bare(against))
                    else:
                        cue = bool(_REFUSALS.search(body))
                    breaks = None if cue else against_other(body, other)
                    if not cue and is_other_language(question, body):
                        defect = "other_language"
                    elif breaks:
                        defect = "truncated"
                    elif breaks is None and not cue and (body[-1].isalnum() or not _FINISHED.search(body)):
                        words = _WORD.findall(body)
                        if (not body[-1].isalnum() and _HALT.search(body) or body[-1].isalpha() and words and words[-1] in _DANGLING and not _INVERTED.search(body)) and len(tokens(body)) > 2:
                            defect = "truncated"
                        else:
                            last = _SENTENCES.split(without_question(question, body))[-1]
                            words = _WORD.findall(last)
                            if words and body[-1:].isalnum() and len(words[-1]) > 1:
                                fragment, places = placed_words(body)[-1]
                                itself = int(not open_end(body))
                            if is_sentence(last):
                                waiting.append(len(out[0]))
                                lasts.append(last)
                for part, x in zip(out, (rid, field, defect, cue, tied, opening, asked_hash, other_hash, fragment, places, itself, None)):
                    part.append(x)
        for i, keys in zip(waiting, endings(lasts)):
            out[-1][i] = keys
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _JUDGED_TYPES)], names=[x.split()[0] for x in _JUDGED.split(", ")])


def _opening_bands(batches):
    """(opening) to (bucket, opening): MinHash bands over stretches of four characters."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a in range(0, len(texts), 2000):
            part = texts[a : a + 2000]
            flat = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            starts = np.cumsum([0, *map(len, part)])
            h = window_hashes(flat, 2)
            owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1
            ok = np.arange(len(h)) + 4 <= starts[owner + 1]
            sig = signatures(h[ok], owner[ok], len(part), BAND * BANDS)
            key = np.zeros((len(part), BANDS), np.uint64)
            for j in range(BAND):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::BAND])
            key = mix(key + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(part).take(pa.array(np.repeat(np.arange(len(part)), BANDS)))], names=["bucket", "opening"])


def _alike(batches):
    """Keep the rows (a, b) whose sets of four-character stretches have a Jaccard similarity of ``ALIKE`` or more."""
    for batch in batches:
        left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sets = {t: {t[i : i + 4] for i in range(len(t) - 3)} for t in {*left, *right}}
        keep = []
        for a, b in zip(left, right):
            x, y = sets[a], sets[b]
            shared = len(x & y)
            keep.append(shared >= ALIKE * (len(x) + len(y) - shared))
        yield batch.filter(pa.array(keep, pa.bool_()))


def alike_openings(openings: DataFrame) -> DataFrame:
    """a, b: alike openings, enough of them to join all that a chain of alike openings joins, each two sharing a bucket.

    In order, every opening of a bucket is compared with the ``NEAR`` before it, which is all pairs of most buckets. In
    larger ones it is compared with ``LEADERS`` of them too; those that are like none go on to the next round, with four
    times as many leaders of their own, until none is left. Openings that these links join need no comparison of their
    own; all other pairs of a larger bucket are compared at the end (``apart``).
    """
    bands = stored(openings.mapInArrow(_opening_bands, "bucket long, opening string"))
    order = Window.partitionBy("bucket").orderBy("opening")
    met = stored(bands.select("bucket", "opening", *[F.lag("opening", i).over(order).alias(f"c{i}") for i in range(1, NEAR + 2)]).filter("c1 is not null"))
    near = met.select(F.explode(F.array(*[f"c{i}" for i in range(1, NEAR + 1)])).alias("a"), F.col("opening").alias("b")).filter("a is not null")
    found = [stored(near.distinct().mapInArrow(_alike, "a string, b string"))]
    large = stored(bands.join(met.filter(f"c{NEAR + 1} is not null").select("bucket").distinct(), "bucket"))
    rest = large
    many = LEADERS
    while not rest.isEmpty():
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("opening"), "opening"))
        ranked = stored(rest.withColumn("place", place))
        leaders = ranked.filter(F.col("place") <= many).select("bucket", F.col("opening").alias("a"), F.col("place").alias("at"))
        led = ranked.join(leaders, "bucket").filter("place > at").select("bucket", "place", "a", F.col("opening").alias("b"))
        linked = stored(led.select("a", "b").distinct().mapInArrow(_alike, "a string, b string"))
        found.append(linked)
        followers = led.join(linked, ["a", "b"], "left_semi").select("bucket", F.col("b").alias("opening")).distinct()
        rest = stored(ranked.filter(F.col("place") > many).select("bucket", "opening").join(followers, ["bucket", "opening"], "left_anti"))
        many *= 4
    links = reduce(DataFrame.union, found).distinct()
    if large.isEmpty():
        return links
    links = stored(links)
    labels = connected_components(links).select(F.col("node").alias("opening"), "component")
    placed = large.join(labels, "opening", "left").withColumn("component", F.coalesce("component", "opening"))
    return links.union(apart(placed).mapInArrow(_alike, "a string, b string"))


def apart(placed: DataFrame) -> DataFrame:
    """a, b: all pairs of (bucket, opening, component) that share a bucket and no component, each once.

    The largest component of a bucket meets the others of it and these each other, so a bucket of one component and
    a few strays has few pairs. Both sides are cut into blocks of about ``BLOCK`` that meet under keys of their own.
    """
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most")).filter("n > most.m")
    dealt = placed.join(sizes, "bucket").select("bucket", "opening", "component", F.xxhash64("opening").alias("h"), F.col("most.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("xs"), F.ceil((F.col("n") - F.col("most.m")) / BLOCK).cast("int").alias("ys"))
    dealt = stored(dealt)
    left = dealt.select("bucket", F.pmod("h", "xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.col("opening").alias("a"), F.col("component").alias("c"), (F.col("component") == F.col("main")).alias("in_main"))
    right = dealt.filter("component <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.pmod("h", "ys").alias("y"), F.col("opening").alias("b"), F.col("component").alias("d"))
    right = right.select("bucket", F.col("x").cast("long").alias("x"), "y", "b", "d")
    left = left.select("bucket", "x", F.col("y").cast("long").alias("y"), "a", "c", "in_main")
    met = left.join(right, ["bucket", "x", "y"]).filter("c <> d and (in_main or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def refusal_openings(judged: DataFrame) -> DataFrame:
    """opening: those of clusters that recur across unrelated questions and have nothing to do with them.

    Copies count once: a case is a question with the other field's answer. Distinct counts reduce before they shuffle,
    so an opening that a third of all rows has is no hot group.
    """
    rows = judged.filter("opening is not null and asked is not null and not coalesce(defect, '') in ('other_language')")
    cases = stored(rows.groupBy("opening", "asked", "other").agg(F.max(F.col("tied").cast("int")).alias("tied")))
    labels = connected_components(stored(alike_openings(judged.filter("opening is not null").select("opening").distinct())))
    labels = labels.select(F.col("node").alias("opening"), "component")
    placed = cases.join(labels, "opening", "left").withColumn("component", F.coalesce("component", "opening"))
    stats = placed.groupBy("component").agg(F.countDistinct("asked").alias("n"), F.countDistinct("other").alias("others"), F.avg("tied").alias("share"))
    # the probability that so few of n cases are tied, if a share BOUND were, is at most exp(-n KL(share, BOUND))
    term = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)
    share = F.col("share")
    evidence = F.col("n") * (term(share, BOUND) + term(1 - share, 1 - BOUND))
    templates = stats.filter((F.col("others") * 2 >= F.col("n")) & (share <= LOOSE) & (evidence >= -float(np.log(CHANCE)))).select(F.col("component").alias("c"))
    all_of = judged.filter("opening is not null").select("opening").distinct().join(labels, "opening", "left")
    return all_of.withColumn("c", F.coalesce("component", "opening")).join(templates, "c").select("opening")


def fragments(broken: DataFrame, texts: DataFrame) -> DataFrame:
    """fragment, places, itself, begun: those of ``broken`` that at their closest telling place are hardly ever a word of
    ``texts`` (question, text), but the beginning of some. ``itself`` is how often the fragment's own text counts there."""
    at = broken.select("fragment", "places", "itself", F.posexplode("places").alias("rank", "place"))
    wanted = small_side(stored(at.select("place", "fragment").distinct()))
    counted = texts.filter("text is not null").distinct().select("text").mapInArrow(_placed, "place long, word string, n long")
    words = stored(counted.join(small_side(stored(at.select("place").distinct())), "place", "left_semi").groupBy("place", "word").agg(F.sum("n").alias("n")))
    own = words.withColumnRenamed("word", "fragment").join(wanted, ["place", "fragment"]).withColumnRenamed("n", "own")
    starts = words.filter(F.length("word") > 2).select("place", F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 1), lambda i: F.substring("word", 1, i))).alias("fragment"), "n")
    longer = starts.join(wanted, ["place", "fragment"]).groupBy("place", "fragment").agg(F.sum("n").alias("longer"))
    met = at.join(own, ["place", "fragment"], "left").join(longer, ["place", "fragment"], "left")
    met = met.withColumn("own", F.greatest(F.coalesce("own", F.lit(0)) - F.col("itself"), F.lit(0))).withColumn("longer", F.coalesce("longer", F.lit(0)))
    told = met.filter((F.col("own") + F.col("longer") >= TELLING) | (F.col("place") == ANYWHERE)).groupBy("fragment", "places", "itself").agg(F.min_by(F.struct("own", "longer"), "rank").alias("s"))
    return stored(told.filter((F.col("s.longer") > 0) & (F.col("s.own") <= BROKEN * F.col("s.longer"))).select("fragment", "places", "itself", F.lit(True).alias("begun")))


def defects(examples: DataFrame, id_column: str = "example_id") -> DataFrame:
    """example_id, field, defect for every defective field."""
    rows = examples.select(F.col(id_column).cast("long").alias("id"), "question", "gold_answer", "predicted_answer")
    judged = stored(rows.mapInArrow(_judge, _JUDGED))
    counted = rows.select("question", "gold_answer", "predicted_answer").mapInArrow(_counts, "key long, ends long, goes long")
    # endings: the longest context that the collection knows decides
    open_ended = stored(judged.filter(F.col("defect").isNull() & (F.size("keys") > 0)).select("id", "field", F.posexplode("keys").alias("rank", "key")))
    asked_for = small_side(stored(open_ended.select("key").distinct()))
    known = counted.join(asked_for, "key", "left_semi").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")).filter("ends + goes > 2")
    met = open_ended.join(known, "key").groupBy("id", "field").agg(F.min_by(F.struct("ends", "goes"), "rank").alias("s"))
    unfinished = open_ended.select("id", "field").distinct().join(met, ["id", "field"], "left").filter(F.coalesce(F.col("s.ends") < ENDS * (F.col("s.ends") + F.col("s.goes")), F.lit(True))).select("id", "field", F.lit(True).alias("unfinished"))
    # fragments: hardly ever at their place, where longer words stand
    broken = stored(judged.filter("defect is null and fragment is not null").select("fragment", "places", "itself").distinct())
    begun = fragments(broken, rows.select("question", F.explode(F.array("question", "gold_answer", "predicted_answer")).alias("text")))
    said = stored(refusal_openings(judged).distinct().withColumn("said", F.lit(True)))
    # what is settled at once needs no join
    at_once = judged.filter("defect in ('empty', 'copies_question') or cue")
    settled = at_once.select("id", "field", F.when(F.col("defect").isin("empty", "copies_question"), F.col("defect")).otherwise("refusal").alias("defect"))
    open_rows = judged.filter("not (coalesce(defect in ('empty', 'copies_question'), false) or cue)").select("id", "field", "defect", "tied", "opening", "fragment", "places", "itself")
    all_of = open_rows.join(small_side(said), "opening", "left").join(small_side(unfinished), ["id", "field"], "left").join(small_side(begun), ["fragment", "places", "itself"], "left")
    defect = F.when(F.coalesce("said", F.lit(False)) & ~F.col("tied") & (F.coalesce("defect", F.lit("")) != "other_language"), "refusal")
    defect = defect.when(F.col("defect").isNotNull(), F.col("defect"))
    defect = defect.when(F.coalesce("begun", F.lit(False)) | F.coalesce("unfinished", F.lit(False)), "truncated")
    made = all_of.select("id", "field", defect.alias("defect")).filter("defect is not null").union(settled)
    return made.select(F.col("id").alias("example_id"), "field", "defect").distinct()
