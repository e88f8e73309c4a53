"""Problem 2: sentence units of texts in any language and script.

Characters are tagged boundary or inside by a linear-chain model decoded with Viterbi. Characters that end no
terminal mark are inside by constraint, so the chain is compressed to its candidates: ends of runs of terminal marks
(with closing quotes and brackets). A candidate's emission is the log-odds of its context (kind of mark, kind of word
before it, kind of what follows, white space, closers); a transition is the log-odds by the tag before and the distance
to it. Both are counts over all labelled sentences with a prior. Blocks between
blank lines, list lines and lines ``Label: value`` bound the chains, and what lies in matched quotes or brackets is inside.

What lies between two terminal marks in an uncased script is tagged character by character by a second chain, trained on
all texts in such scripts, whose marks are stripped (they are its labels). A boundary that no mark shows needs a mark to
have been left out: how likely that is follows from how many marks the block has for its length, and how long sentences
of the script are. So an unpunctuated text of any length is cut, and a punctuated one is left alone.

Null, empty and blank texts give no units; a text without any boundary is one unit, however long. Both models are
counted where the texts are; only their counts reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import STEP_CHARS, codes, steps

#: How many labelled cases a context's prior counts for.
PRIOR_CASES = 20.0
#: Distances (upper bounds, in characters) that transitions tell apart, and their prior: boundaries hardly ever follow so close.
DISTANCES = (3, 8, 16, 32, 64)
CLOSE_PENALTY = 4.0
#: Share of its marks that an unpunctuated block still has, and the odds that a block with, and without, marks is one.
STRAY, ODDS, ODDS_BARE = 0.1, 0.02, 0.5
#: Letters that a word must have for a full stop after it to end a sentence of an uncased script.
SHORTEST = 4
#: Chance that a mark is left out in a punctuated block.
OMITTED = 1e-4

OTHER, SPACE, LINE, LOWER, UPPER, UNCASED, DIGIT, DOT, EXCLAIM, STOP, OPEN_Q, CLOSE_Q, ASCII_Q, OPEN_B, CLOSE_B, LEAD = range(16)

# Marks by class.
_MARKS = {
    DOT: ".．", EXCLAIM: "!?‼⁇⁈⁉…", STOP: "。！？｡।॥؟۔።", OPEN_Q: "“„«「『‹‚", CLOSE_Q: "”»」』›", ASCII_Q: '"', OPEN_B: "([（【［{", CLOSE_B: ")]）】］}", LEAD: "¿¡—–-•*",
}
# Abbreviations by what may follow them.
_TITLES = "dr prof mr mrs ms messrs mx st mt ft pt rev hon gen gov col capt lt sgt sen rep mme mlle mgr hr fr sr sra srta dra dña д-р проф г-н г-жа डॉ श्री प्रो कि.ग्रा ग्रा रु د univ acad instit inst mus soc assn assoc intl int'l bros upr lab lk dept e.g i.e viz mio mrd tsd approx esp incl cf vs ca bzw vgl z.b d.h т.е см ул напр т.н सु"
_NUMBERS = "no nos nr vol vols fig figs p pp art sec ch bd abb núm nº pág págs cap t стр гл рис п.п jan feb mar apr jun jul aug sep sept oct nov dec may janv févr avr juil déc ene abr ago ext tel"
_MAYBE = "etc a.m p.m am pm ltd co comp corp inc jr sr usw u.s.a руб кг т.д т.п д.р gmbh ag s.a cie al"
_MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner"
TITLE_W, NUMBER_W, MAYBE_W, INITIAL, REVERSED, NUMERAL, LETTER, WORD, SHORT_U, AT = range(10)
N_UPPER, N_LOWER, N_CASELESS, N_DIGIT, N_UNCASED, N_OTHER, N_MONTH = range(7)
M_DOT, M_TWO, M_MANY, M_EXCLAIM, M_STOP = range(5)
_SHAPE = (5, 10, 7, 3, 3)


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110001, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch.isspace():
            out[c] = SPACE
        elif kind == "Lu" or kind == "Lt":
            out[c] = UPPER
        elif kind == "Ll":
            out[c] = LOWER
        elif kind[0] in "LM":
            out[c] = UNCASED
        elif kind[0] == "N":
            out[c] = DIGIT
    for k, marks in _MARKS.items():
        out[[ord(x) for x in marks]] = k
    out[10] = LINE
    return out


@cache
def lower_table() -> np.ndarray:
    """The single lower-case code point of every code point."""
    out = np.arange(0x110001, dtype=np.uint32)
    for c in range(0x250, 0x110000):
        if c < 0x2000 or 0xA640 <= c < 0xABC0 or 0xFF00 <= c < 0xFF60 or 0x10400 <= c < 0x10500:
            out[c] = ord(chr(c).lower()[0])
    for c in range(0x250):
        out[c] = ord(chr(c).lower()[0])
    return out


_WIDE = 10


def _word_hash(rows: np.ndarray) -> np.ndarray:
    """Hashes of words given as rows of ``_WIDE`` code points, padded with zeros."""
    h = np.zeros(len(rows), np.uint64)
    for j in range(_WIDE):
        h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@cache
def _words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of abbreviations with their kinds, and of month names."""
    def rows(text: str) -> np.ndarray:
        return np.array([([ord(x) for x in w] + [0] * _WIDE)[:_WIDE] for w in text.split()], np.uint32)

    h = np.concatenate([_word_hash(rows(x)) for x in (_TITLES, _NUMBERS, _MAYBE)])
    kinds = np.repeat([TITLE_W, NUMBER_W, MAYBE_W], [len(x.split()) for x in (_TITLES, _NUMBERS, _MAYBE)])
    order = np.argsort(h, kind="stable")
    return h[order], kinds[order], np.sort(_word_hash(rows(_MONTHS)))


def _gather(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(_WIDE)
    return np.where(np.arange(_WIDE) < length[:, None], low[np.minimum(at, len(low) - 1)], 0)


def prior() -> np.ndarray:
    """Log-odds of a boundary by context, before training: (mark, word before, what follows, white space, closer)."""
    w = np.full(_SHAPE, -3.0)
    sentence_words = [WORD, NUMERAL, MAYBE_W, REVERSED, SHORT_U]
    for gap in (1, 2):
        for nxt in (N_UPPER, N_DIGIT, N_UNCASED, N_OTHER):
            w[M_DOT, sentence_words, nxt, gap] = 3
        w[M_DOT, [WORD, NUMERAL, REVERSED], N_CASELESS, gap] = 3
        w[M_DOT, MAYBE_W, N_CASELESS, gap] = -1
        w[M_DOT, [LETTER], N_UPPER, gap] = 2
        w[M_DOT, NUMBER_W, [N_UPPER, N_OTHER], gap] = 1
        w[M_DOT, [TITLE_W, NUMBER_W, INITIAL], N_OTHER, gap] = -1
        w[M_DOT, NUMERAL, N_MONTH, gap] = -3
        w[M_DOT, WORD, N_MONTH, gap] = 3
        for mark in (M_TWO, M_MANY, M_EXCLAIM):
            w[mark, :, [N_UPPER, N_DIGIT, N_UNCASED, N_OTHER, N_MONTH], gap] = 3
        w[M_TWO, :, N_CASELESS, gap] = 2
        w[M_EXCLAIM, :, N_CASELESS, gap] = 2
        w[M_EXCLAIM, :, N_OTHER, gap] = 1
        w[M_DOT, [TITLE_W, INITIAL], N_CASELESS, gap] = -3
        w[:M_STOP, :, N_CASELESS, gap, 1] = -2
    w[M_DOT, [WORD, NUMERAL], N_LOWER, 1:, 0] = w[M_EXCLAIM, :, N_LOWER, 1:, 0] = 0
    w[M_DOT, WORD, N_DIGIT, 0] = 1
    w[M_DOT, [WORD, NUMERAL, REVERSED], N_UPPER, 0] = 3
    w[M_DOT, WORD, N_UNCASED, 0] = 2
    w[[M_TWO, M_EXCLAIM], :, N_UPPER, 0] = 3
    w[M_EXCLAIM, :, N_UNCASED, 0] = 2
    w[M_STOP] = 3
    w[M_STOP, :, [N_LOWER], :, 0] = 2
    w[:, AT] = -3
    return w


_BULLET = re.compile(r"[^\S\n]*[-–•*·▪◦‣][^\S\n]+\S")
_NUMBERED = re.compile(r"[^\S\n]*\(?\d{1,3}[.)][^\S\n]+\S")
_LABEL = re.compile(r"[^\S\n]*[^\W\d_][^:：\n.!?。！？]{0,40}[:：][^\S\n]*\S")
_MARK_IN = re.compile(r"[.!?…](?=\s)|[。！？।؟]")


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the blocks of a text; a whole one (list or label line) is one unit."""
    out: list[tuple[int, int, bool]] = []
    block: list[tuple[int, int]] = []

    def close() -> None:
        if not block:
            return
        lines = [text[a:b] for a, b in block]
        labels = [bool(_LABEL.match(x)) and len(x.split(":")[0].split()) <= 4 for x in lines]
        if all(labels) and (len(lines) > 1 or not _MARK_IN.search(lines[0]) and len(lines[0]) < 160):
            out.extend((a, b, True) for a, b in block)
        else:
            numbered = sum(bool(_NUMBERED.match(x)) for x in lines) > 1
            start = None
            for (a, b), x in zip(block, lines):
                if _BULLET.match(x) or numbered and _NUMBERED.match(x):
                    if start is not None:
                        out.append((start, a, False))
                        start = None
                    out.append((a, b, True))
                elif start is None:
                    start = a
            if start is not None:
                out.append((start, block[-1][1], False))
        block.clear()

    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line and not line.isspace():
            block.append((at, end))
        else:
            close()
        at = end + 1
    close()
    return out


_PAIRS = {"”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "›": "‹", ")": "(", "]": "[", "）": "（", "】": "【", "］": "［", "}": "{"}


def matched(events: list[tuple[int, str, bool, bool]]) -> list[tuple[int, int]]:
    """Spans of matched quotes and brackets; an event is (position, character, may open, may close)."""
    straight = [i for i, e in enumerate(events) if e[1] == '"']
    if len(straight) % 2 == 0:  # straight quotes that can pair off do so in turn, whatever the spacing
        events = list(events)
        for k, i in enumerate(straight):
            events[i] = (events[i][0], '"', k % 2 == 0, k % 2 == 1)
    stack: list[tuple[int, str]] = []
    spans = []
    for at, ch, may_open, may_close in events:
        openers = '"' if ch == '"' else _PAIRS.get(ch, "")
        if may_close and openers:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][1] in openers:
                    spans.append((stack[k][0], at))
                    del stack[k:]
                    break
            else:
                if may_open and ch in '"“':
                    stack.append((at, ch))
        elif may_open:
            stack.append((at, ch))
    return spans


def candidates(texts: list[str]):
    """The candidates of a batch of texts with their contexts, and the hard segments they lie in."""
    raw, starts = codes(texts)
    n = len(raw)
    cls = class_table()[raw]
    seg = []
    for t, a in zip(texts, starts):
        seg.extend((s + a, e + a, whole) for s, e, whole in segments(t))
    bounds = np.array([(s, e, w) for s, e, w in seg], np.int64).reshape(-1, 3)
    solid = np.flatnonzero((cls != SPACE) & (cls != LINE))
    padded = np.concatenate([cls, [SPACE, SPACE]]).astype(np.uint8)
    # quotes and brackets
    marks = np.flatnonzero((cls >= OPEN_Q) & (cls <= CLOSE_B))
    seg_of = np.searchsorted(bounds[:, 0], marks, "right") - 1
    before = padded[marks - 1] if len(marks) else marks
    gap_before = np.isin(before, (SPACE, LINE, OPEN_B, OPEN_Q)) | (marks == 0)
    gap_after = np.isin(padded[marks + 1], (SPACE, LINE))
    spans, inside = [], np.zeros(n + 2, np.int32)
    closes = cls == CLOSE_Q
    closes |= cls == CLOSE_B
    events: list = []
    last = -1
    for at, k, s, gb, ga, c in zip(marks.tolist(), raw[marks].tolist(), seg_of.tolist(), gap_before.tolist(), gap_after.tolist(), cls[marks].tolist()):
        if s != last:
            spans.extend(matched(events))
            events, last = [], s
        opens = c in (OPEN_Q, OPEN_B) or c == ASCII_Q and (gb or not ga)
        events.append((at, chr(k), opens, c in (CLOSE_Q, CLOSE_B) or c == ASCII_Q and not gb or k == 0x201C))
    spans.extend(matched(events))
    if spans:
        pairs = np.array(spans)
        np.add.at(inside, pairs[:, 0] + 1, 1)
        np.add.at(inside, pairs[:, 1] + 1, -1)
        closes[pairs[:, 1]] = True
    depth = np.cumsum(inside)
    ascii_q = np.flatnonzero(cls == ASCII_Q)
    if len(ascii_q):
        after_mark = np.isin(padded[ascii_q - 1], (DOT, EXCLAIM, STOP)) & (ascii_q > 0)
        closes[ascii_q[after_mark & np.isin(padded[ascii_q + 1], (SPACE, LINE))]] = True
    # ends of runs of terminal marks
    term = (cls == DOT) | (cls == EXCLAIM) | (cls == STOP)
    at = np.flatnonzero(term & ~np.append(term[1:], False))
    near = np.append(closes, [False, False])
    p = at + 1
    for _ in range(3):
        p = p + near[p]
    french = (padded[np.minimum(p, n)] == SPACE) & (np.append(raw, [0, 0])[np.minimum(p + 1, n + 1)] == 0xBB) & near[np.minimum(p + 1, n + 1)]
    p = np.where(french, p + 2, p)
    if not len(bounds):
        return raw, cls, solid, bounds, np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
    s = np.searchsorted(bounds[:, 0], at, "right") - 1
    nxt = solid[np.minimum(np.searchsorted(solid, p), len(solid) - 1)]
    ok = (s >= 0) & (p <= bounds[s, 1]) & (bounds[s, 2] == 0) & (nxt >= p) & (nxt < bounds[s, 1]) & (depth[np.minimum(p, n + 1)] == 0)
    at, p, s, nxt = at[ok], p[ok], s[ok], nxt[ok]
    # kind of mark
    runs = np.flatnonzero(term & ~np.concatenate([[False], term[:-1]]))
    first = runs[np.searchsorted(runs, at, "right") - 1]
    length = at - first + 1
    kind = np.where(cls[at] == STOP, M_STOP, np.where((cls[at] == DOT) & (cls[first] == DOT), np.where(length == 1, M_DOT, np.where(length == 2, M_TWO, M_MANY)), np.where(raw[at] == 0x2026, M_MANY, M_EXCLAIM)))
    # word before
    low = lower_table()[raw]
    wordy = (cls >= LOWER) & (cls <= DIGIT)
    dots = np.flatnonzero(cls == DOT)
    dots = dots[(dots > 0) & (dots < n - 1)]
    joined = dots[wordy[dots - 1] & wordy[dots + 1] & (cls[dots - 1] != DIGIT) & (cls[dots + 1] != DIGIT) & ~((cls[dots - 1] == LOWER) & (cls[dots + 1] == UPPER))]
    wordy[joined] = True
    gaps = np.flatnonzero(~wordy)
    k = np.searchsorted(gaps, first) - 1
    begin = np.where(k >= 0, gaps[np.maximum(k, 0)] + 1, 0) if len(gaps) else np.zeros(len(first), np.int64)
    text_start = starts[np.searchsorted(starts, first, "right") - 1]
    begin = np.maximum(begin, text_start)
    size = first - begin
    last_c = cls[np.maximum(first - 1, 0)]
    word = np.full(len(at), WORD)
    word[(last_c == DIGIT)] = NUMERAL
    word[(size == 1) & (last_c == LOWER)] = LETTER
    word[(size <= 2) & (last_c == UNCASED)] = SHORT_U
    lead_c = np.where(begin > text_start, cls[np.maximum(begin - 1, 0)], SPACE)
    single = (size == 1) & (last_c == UPPER) & np.isin(lead_c, (SPACE, LINE, DOT, OPEN_B, OPEN_Q, ASCII_Q))
    after_digit = single & (begin >= text_start + 2) & (cls[np.maximum(begin - 2, 0)] == DIGIT) & (cls[np.maximum(begin - 4, 0)] == SPACE) & (cls[np.maximum(begin - 5, 0)] == DIGIT)
    word[single & ~after_digit] = INITIAL
    back = np.maximum(begin - 3, 0)
    word[single & (begin >= text_start + 3) & (lead_c == SPACE) & (raw[back + 1] == 44) & (cls[back] >= LOWER) & (cls[back] <= UNCASED)] = REVERSED
    table, kinds, months = _words()
    short = np.flatnonzero((size > 0) & (size < _WIDE))
    h = _word_hash(_gather(low, begin[short], size[short]))
    hit = np.minimum(np.searchsorted(table, h), len(table) - 1)
    known = table[hit] == h
    word[short[known]] = kinds[hit[known]]
    # a dotted initial within a word, such as the last of T.E.
    inner = (size >= 3) & (last_c == UPPER) & (cls[np.maximum(first - 2, 0)] == DOT)
    word[inner & (word == WORD)] = INITIAL
    at_sign = (begin > text_start) & (raw[np.maximum(begin - 1, 0)] == 64)
    # what follows
    lead = nxt.copy()
    for _ in range(3):
        c = padded[np.minimum(lead, n)]
        skip = (c == OPEN_Q) | (c == OPEN_B) | (c == LEAD) | (c == ASCII_Q)
        lead = np.where(skip, lead + 1, lead)
        lead = np.where(skip & (padded[np.minimum(lead, n)] == SPACE), lead + 1, lead)
    c = padded[np.minimum(lead, n)]
    follow = np.full(len(at), N_OTHER)
    for k, v in ((UPPER, N_UPPER), (LOWER, N_LOWER), (DIGIT, N_DIGIT), (UNCASED, N_UNCASED)):
        follow[c == k] = v
    uppers = np.concatenate([[0], np.cumsum(cls == UPPER)])
    lowers = np.concatenate([[0], np.cumsum(cls == LOWER)])
    word[after_digit & (word == WORD) & (follow != N_UPPER)] = INITIAL
    first_letters = np.concatenate([[0], np.cumsum((cls >= LOWER) & (cls <= UPPER) & np.concatenate([[True], (cls[:-1] == SPACE) | (cls[:-1] == LINE)]))])
    capitals = np.concatenate([[0], np.cumsum((cls == UPPER) & np.concatenate([[True], (cls[:-1] == SPACE) | (cls[:-1] == LINE)]))])
    span = lambda x: x[bounds[s, 1]] - x[bounds[s, 0]]
    few = span(uppers) * 100 <= span(lowers)
    many = (span(capitals) * 20 >= span(first_letters) * 17) & (span(first_letters) > 12)
    follow[(follow == N_LOWER) & (few | many) | (follow == N_UPPER) & many] = N_CASELESS
    up = np.flatnonzero(((follow == N_UPPER) | (follow == N_CASELESS)) & (word == NUMERAL))
    if len(up):
        stops = np.append(gaps, n)
        e = stops[np.searchsorted(stops, lead[up])]
        h = _word_hash(_gather(low, lead[up], np.minimum(e - lead[up], _WIDE)))
        follow[up[months[np.minimum(np.searchsorted(months, h), len(months) - 1)] == h]] = N_MONTH
    gap = np.where(nxt == p, 0, np.where(np.concatenate([[0], np.cumsum(cls == LINE)])[nxt] > np.concatenate([[0], np.cumsum(cls == LINE)])[p], 2, 1))
    c = cls[p - 1]
    closer = np.where(p == at + 1, 0, np.where(c == CLOSE_B, 2, 1))
    # a mark without white space after it ends a sentence only after a whole word
    tight = (gap == 0) & (word == WORD) & ((size < 3) | (last_c == UPPER)) & (closer == 0) & (kind == M_DOT)
    word[tight | at_sign & (gap == 0)] = AT
    return raw, cls, solid, bounds, p, np.stack([kind, word, follow, gap, closer], 1)


def prior_moves() -> np.ndarray:
    """Log-odds of a boundary by (distance, tag before), before training."""
    moves = np.zeros((len(DISTANCES) + 1, 2))
    moves[0, 1] = -CLOSE_PENALTY
    return moves


def decode(score: np.ndarray, p: np.ndarray, moves: np.ndarray | None = None, chain: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Viterbi over chains of candidates: which are boundaries.

    ``chain`` numbers the chain of each candidate (ascending) and ``start`` gives where each candidate's chain begins,
    which is a boundary; without them all candidates are one chain that begins far away. All chains advance together.
    """
    n = len(p)
    if not n:
        return np.zeros(0, bool)
    moves = prior_moves() if moves is None else moves
    chain = np.zeros(n, np.int64) if chain is None else chain
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    size = np.diff(np.append(first, n))
    before = np.concatenate([[0], p[:-1]])
    before[first] = start[first] if start is not None else p[first] - 1_000_000
    kind = np.searchsorted(DISTANCES, p - before)
    step = moves[kind] + score[:, None]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    inside, bound = np.full(len(first), -np.inf), np.zeros(len(first))
    trace = np.zeros((n, 2), bool)
    for k in range(int(size[0])):
        m = alive[k]
        at = first[:m] + k
        to_bound = np.stack([inside[:m] + step[at, 0], bound[:m] + step[at, 1]])
        trace[at, 0] = bound[:m] > inside[:m]
        trace[at, 1] = to_bound[1] > to_bound[0]
        inside[:m] = np.maximum(inside[:m], bound[:m])
        bound[:m] = to_bound.max(axis=0)
    on = np.zeros(n, bool)
    state = bound > inside
    for k in range(int(size[0]) - 1, -1, -1):
        m = alive[k]
        at = first[:m] + k
        on[at] = state[:m]
        state[:m] = trace[at, state[:m].astype(int)]
    return on


def units(texts: list[str], weights, stripped: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of text, start, end) of every unit of a batch of texts; ``weights`` are emissions, or these and transitions."""
    emissions, moves = weights if isinstance(weights, tuple) else (weights, None)
    raw, cls, solid, bounds, p, x = candidates(texts)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    if not len(bounds):
        return (np.zeros(0, np.int64),) * 3
    score = emissions[tuple(x.T)] if len(p) else np.zeros(0)
    chain = np.searchsorted(bounds[:, 0], p - 1, "right") - 1
    ends = [bounds[:, 1], p[decode(score, p, moves, chain, bounds[chain, 0])]]
    if stripped:
        ends.append(_unpunctuated(raw, cls, bounds, stripped))
    cuts = np.unique(np.concatenate(ends))
    begins = np.unique(np.concatenate([bounds[:, 0], cuts]))
    begins = begins[(np.searchsorted(bounds[:, 0], begins, "right") - 1 >= 0)]
    s = np.searchsorted(bounds[:, 0], begins, "right") - 1
    begins = begins[begins < bounds[s, 1]]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3
    stop = cuts[np.searchsorted(cuts, begins, "right")]
    a = np.searchsorted(solid, begins)
    b = np.searchsorted(solid, stop) - 1
    ok = a <= b
    first, last = solid[a[ok]], solid[b[ok]] + 1
    owner = np.searchsorted(starts, first, "right") - 1
    return owner, first - starts[owner], last - starts[owner]


# ---- unpunctuated scripts -------------------------------------------------------------------------------------------


_DROPPED = (SPACE, LINE, OPEN_Q, CLOSE_Q, ASCII_Q)


def _script(ch: str) -> str:
    """The group of scripts whose sentences have like lengths: Chinese and Japanese, or the rest."""
    return "dense" if "\u3040" <= ch <= "\u30ff" or "\u3400" <= ch <= "\u9fff" else "spaced"


def _dense(c: np.ndarray) -> np.ndarray:
    """Which code points are of ``_script`` dense."""
    return (c >= 0x3040) & (c <= 0x30FF) | (c >= 0x3400) & (c <= 0x9FFF)


def _left_open(cls: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which characters lie within a quotation or a bracket that began in their text; a blank line ends what nothing closed."""
    n = len(cls)
    first = np.zeros(n, bool)
    first[starts[:-1][starts[:-1] < n]] = True
    first |= (cls == LINE) & np.concatenate([[False], raw[:-1] == 10])
    stretch = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    move = np.isin(cls, (OPEN_Q, OPEN_B)).astype(np.int64) - np.isin(cls, (CLOSE_Q, CLOSE_B))
    total = np.cumsum(move)
    walk = total - (total - move)[at][stretch]
    lower = stretch * (2 * n + 2)  # stretches lie below each other, so that a running minimum stays within one
    depth = walk - np.minimum(0, np.minimum.accumulate(walk - lower) + lower)
    straight = np.cumsum(cls == ASCII_Q)
    return (depth > 0) | ((straight - (straight - (cls == ASCII_Q))[at][stretch]) % 2 == 1)


def stripped_cells(texts: list[str]) -> tuple[tuple[np.ndarray, ...], dict]:
    """``stripped_counts`` with the contexts as arrays: (distance, first character, second or -1, at a boundary, anywhere)."""
    raw, starts = codes(texts)
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 5, {}
    cls = class_table()[raw]
    place = np.arange(n)
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    begin = starts[:-1][text_of]
    mark = (cls == DOT) | (cls == EXCLAIM) | (cls == STOP)
    kept = ~mark & ~np.isin(cls, _DROPPED)
    before = np.cumsum(kept)  # kept characters up to here
    head = np.concatenate([[0], before])[begin]  # and before the text
    # a full stop within a number or a word or after a short one, or a mark within a quotation, ends nothing
    letter = (cls >= LOWER) & (cls <= UNCASED)
    gap_at = np.maximum(np.maximum.accumulate(np.where(letter, -1, place)), begin - 1)
    word = np.where(place > begin, place - 1 - np.concatenate([[-1], gap_at[:-1]]), 0)
    joined = np.concatenate([(cls[1:] >= LOWER) & (cls[1:] <= DIGIT) & (text_of[1:] == text_of[:-1]), [False]])
    ends = mark & (before > head) & ~_left_open(cls, raw, starts) & ~((cls == DOT) & ((word < SHORTEST) | joined))
    at = np.flatnonzero(kept)
    c, owner = raw[at].astype(np.int64), text_of[at]
    bound = np.zeros(len(at), bool)
    bound[before[ends] - 1] = True
    dense = _dense(c)
    lengths: dict = {}
    last = np.flatnonzero(bound)
    if len(last):
        opens = np.searchsorted(owner, owner[last])
        prior_end = np.concatenate([[0], last[:-1] + 1])
        x = np.log(last + 1 - np.maximum(opens, prior_end))
        for script, of in (("dense", dense[last]), ("spaced", ~dense[last])):
            if of.any():
                lengths[script] = int(of.sum()), float(x[of].sum()), float((x[of] ** 2).sum())
    # where words are spaced, nothing ends within one
    spaces = np.cumsum((cls == SPACE) | (cls == LINE))[at]
    i = np.flatnonzero((owner[1:] == owner[:-1]) & ((spaces[1:] > spaces[:-1]) | bound[:-1] | dense[:-1])) + 1
    yes = bound[i - 1]
    same_back = (i > 1) & (owner[np.maximum(i - 2, 0)] == owner[i])
    after = np.minimum(i + 1, len(at) - 1)
    same_on = (i + 1 < len(at)) & (owner[after] == owner[i])
    none = np.full(len(i), -1)
    parts = []
    for distance, x, y in ((-1, c[i - 1], none), (-2, np.where(same_back, c[np.maximum(i - 2, 0)], c[i - 1]), np.where(same_back, c[i - 1], -1)), (1, c[i], none), (2, c[i], np.where(same_on, c[after], -1))):
        keys, back, counts = np.unique(x << 21 | y + 1, return_inverse=True, return_counts=True)
        parts.append((np.full(len(keys), distance), keys >> 21, (keys & (1 << 21) - 1) - 1, np.bincount(back, yes, len(keys)).astype(np.int64), counts))
    return tuple(np.concatenate(x) for x in zip(*parts)), lengths


def _context(first: int, second: int) -> str:
    return chr(first) + (chr(second) if second >= 0 else "")


def stripped_counts(texts: list[str]) -> tuple[dict, dict]:
    """What the second model counts, from texts whose terminal marks are stripped.

    Contexts: by (distance, characters), the one and two characters before a gap (-1, -2) and after it (1, 2), how often
    they stand at a boundary and anywhere. Lengths: by script, number, sum and sum of squares of the logarithms of the
    sentences' lengths.
    """
    cells, lengths = stripped_cells(texts)
    return {(k, _context(x, y)): (yes, n) for k, x, y, yes, n in zip(*(part.tolist() for part in cells))}, lengths


def stripped_model(contexts: dict, lengths: dict) -> dict:
    """Log-likelihood ratios of contexts at boundaries, the base rate (None), and (mean, deviation) of log lengths by script."""
    total, ends = sum(v for (k, _), (_, v) in contexts.items() if k == 1), sum(v for (k, _), (v, _) in contexts.items() if k == 1)
    if not ends:
        return {}
    base = np.log(ends / max(1, total - ends))
    out = {k: float(np.log((yes + 20 * ends / total) / (v - yes + 20 * (1 - ends / total))) - base) for k, (yes, v) in contexts.items()}
    for script, (n, one, two) in lengths.items():
        out["length", script] = one / n, max(0.3, float(np.sqrt(max(0.0, two / n - (one / n) ** 2))))
    return out | {None: float(base)}


def strip_counts(texts: list[str]) -> dict:
    """The second model of a few texts."""
    return stripped_model(*stripped_counts(texts))


def length_scores(model: dict, script: str, n: int) -> np.ndarray:
    """Log-probabilities of sentences of 1 to n characters."""
    mean, spread = model.get(("length", script)) or next(v for k, v in model.items() if k is not None and k[0] == "length")
    x = np.log(np.arange(1, n + 1))
    return -((x - mean) ** 2) / (2 * spread**2) - x - np.log(spread * np.sqrt(2 * np.pi))


def stripped_path(s: str, model: dict, omitted: float = 1.0, gaps: np.ndarray | None = None) -> list[int]:
    """Viterbi over the characters of a text without marks: positions where a unit ends.

    A boundary scores by its contexts (on either side of a gap the longer known one counts, as they are not independent)
    and by the chance ``omitted`` that a mark was left out there; the units between score by their lengths. States are
    numbered by where their unit began, so the best predecessor of a boundary is found in one vector operation.
    ``gaps`` tells before which characters words end, where the script spaces them; a boundary is at one of those.
    """
    n = len(s)
    known = [v for k, v in model.items() if k is not None and k[0] == "length"]
    if n < 2 or not known:
        return []
    script = "dense" if sum(_script(c) == "dense" for c in s) * 2 > n else "spaced"
    reach = min(n, max(256, *(int(np.exp(m + 5 * d)) for m, d in known)))
    length = length_scores(model, script, n)[::-1]  # by n - length
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    cost = np.log(omitted)
    places = range(1, n + 1)
    if gaps is not None and script == "spaced" and gaps.any():
        places = [*np.flatnonzero(gaps[1:n]) + 1, n]
        cost += np.log(n / len(places))  # lengths are spread over the gaps only
    for i in map(int, places):
        low = max(0, i - reach)
        options = best[low:i] + length[n - i + low : n]
        j = int(options.argmax())
        e = 0.0
        if i < n:
            left, right = (-2, s[max(0, i - 2) : i]), (2, s[i : i + 2])
            e = cost + (model[left] if left in model else model.get((-1, s[i - 1]), 0.0)) + (model[right] if right in model else model.get((1, s[i]), 0.0))
        best[i], back[i] = options[j] + e, low + j
    out, i = [], int(back[n])
    while i > 0:
        out.append(i)
        i = int(back[i])
    return out[::-1]


def left_out(marks: int, size: int, model: dict, script: str) -> float:
    """The chance that a sentence's mark was left out in a block of ``size`` characters with so many marks.

    A punctuated block has about one mark a sentence, an unpunctuated one ``STRAY`` of them: Poisson counts of both.
    """
    mean, spread = model.get(("length", script)) or next(v for k, v in model.items() if k is not None and k[0] == "length")
    expected = size / np.exp(mean + spread**2 / 2)
    odds = np.log(ODDS if marks else ODDS_BARE) + marks * np.log(STRAY) + (1 - STRAY) * expected
    share = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return float(share * (1 - STRAY) + (1 - share) * OMITTED)


def _unpunctuated(raw: np.ndarray, cls: np.ndarray, bounds: np.ndarray, model: dict) -> np.ndarray:
    """Ends of units that no mark shows, in runs of uncased script between terminal marks."""
    if not any(k is not None and k[0] == "length" for k in model):
        return np.zeros(0, np.int64)
    marks = np.flatnonzero((cls == DOT) | (cls == EXCLAIM) | (cls == STOP))
    bare = np.concatenate([[0], np.cumsum(cls == UNCASED)])
    kept = np.concatenate([[0], np.cumsum(~np.isin(cls, _DROPPED))])
    size = bounds[:, 1] - bounds[:, 0]
    at = np.flatnonzero((bounds[:, 2] == 0) & (size > 1) & ((bare[bounds[:, 1]] - bare[bounds[:, 0]]) * 2 > size))
    out = []
    for start, end, _ in bounds[at]:
        inside = marks[np.searchsorted(marks, start) : np.searchsorted(marks, end)]
        ends = inside[np.concatenate([inside[1:] - inside[:-1] > 1, [True]])] if len(inside) else inside
        letters = raw[start:end][cls[start:end] == UNCASED]
        dense = (((letters >= 0x3040) & (letters <= 0x30FF)) | ((letters >= 0x3400) & (letters <= 0x9FFF))).sum() * 2 > len(letters)
        omitted = left_out(len(ends), int(kept[end] - kept[start]), model, "dense" if dense else "spaced")
        if omitted < 0.01:
            continue  # a boundary here would have to be a hundred times likelier than its contexts can make it
        for a, b in zip([start, *(inside + 1)], [*inside, end]):
            if (bare[b] - bare[a]) * 2 > b - a > 1:
                solid = np.flatnonzero(~np.isin(cls[a:b], _DROPPED))
                gaps = np.concatenate([[False], np.diff(solid) > 1])
                path = stripped_path(raw[a:b][solid].tobytes().decode("utf-32-le"), model, omitted, gaps)
                out.extend(a + solid[i - 1] + 1 for i in path)
    return np.array(out, np.int64)


# ---- training and the operator --------------------------------------------------------------------------------------


#: Emissions are counted in this many steps of a half between -BINS / 4 and BINS / 4 where transitions are fitted.
BINS = 48


def _bin(emission: np.ndarray) -> np.ndarray:
    return np.clip((emission * 2 + BINS / 2).astype(np.int64), 0, BINS - 1)


#: What ``labelled_counts`` tells apart: context, distance, tag before, tag.
_CELLS = (*_SHAPE, len(DISTANCES) + 1, 2, 2)


def labelled_counts(texts: list[str], sentences: list[list[str]]) -> np.ndarray:
    """Counts from texts and sentences of each: candidates at a sentence's end are boundaries, those within it are not,
    and its start is one. By context, distance, tag before and tag, from one pass over the texts."""
    out = np.zeros(int(np.prod(_CELLS)))
    usable = [(t, spans) for t, own in zip(texts, sentences) if t and (spans := [(a, a + len(x)) for x in own if x and (a := t.find(x)) >= 0])]
    for i, j in steps([len(t) for t, _ in usable]):
        part = [t for t, _ in usable[i:j]]
        _, _, _, _, p, x = candidates(part)
        starts = np.cumsum([0, *map(len, part)])
        span = np.array([(s + a, s + b) for s, (_, spans) in zip(starts.tolist(), usable[i:j]) for a, b in spans], np.int64)
        low, high = (np.searchsorted(p, span[:, k], "right") for k in (0, 1))
        of = np.repeat(np.arange(len(span)), high - low)
        at = np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[of]
        opens = at == low[of]  # the first candidate of a sentence, after its start
        distance = np.searchsorted(DISTANCES, p[at] - np.where(opens, span[of, 0], p[at - 1]))
        cell = np.ravel_multi_index((*x[at].T, distance, opens.astype(np.int64), (p[at] == span[of, 1]).astype(np.int64)), _CELLS)
        out += np.bincount(cell, minlength=len(out))
    return out.reshape(_CELLS)


def fit_emissions(contexts: np.ndarray) -> np.ndarray:
    """Log-odds of a boundary by context, with the prior."""
    rate = 1 / (1 + np.exp(-prior()))
    return np.log((contexts[..., 1] + rate * PRIOR_CASES) / (contexts[..., 0] + (1 - rate) * PRIOR_CASES))


def fit_moves(counts: np.ndarray) -> np.ndarray:
    """What a distance and the tag before add to a boundary's log-odds beyond its emission: the most likely value given
    the counts and a normal prior, by bisection on the gradient."""
    value = (np.arange(BINS) + 0.5 - BINS / 2) / 2
    low, high = prior_moves() - 8, prior_moves() + 8
    for _ in range(40):
        at = (low + high) / 2
        rate = 1 / (1 + np.exp(-value - at[..., None]))
        slope = (counts[..., 1] - counts.sum(axis=-1) * rate).sum(axis=-1) - PRIOR_CASES * (at - prior_moves())
        low, high = np.where(slope > 0, at, low), np.where(slope > 0, high, at)
    return (low + high) / 2


def fit_both(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first model (emissions, transitions) from ``labelled_counts``."""
    emissions = fit_emissions(counts.sum(axis=(5, 6)))
    binned = np.zeros((BINS, *_CELLS[5:]))
    np.add.at(binned, _bin(emissions).reshape(-1), counts.reshape(-1, *_CELLS[5:]))
    return emissions, fit_moves(np.moveaxis(binned, 0, 2))


def fit(labelled: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The first model (emissions, transitions) of a few (text, one of its sentences)."""
    return fit_both(labelled_counts([t for t, _ in labelled], [[x] for _, x in labelled]))


def _labelled_rows(batches):
    """(doc_id, sentence, text), the sentences of a document before its texts, to (cell, n) of ``labelled_counts``.

    Of one document the sentences are kept while its texts pass, each of which is read once.
    """
    out = np.zeros(_CELLS)
    doc, own = None, []
    for batch in batches:
        texts, labels = [], []
        for rid, sentence, text in zip(*(c.to_pylist() for c in batch.columns)):
            if rid != doc:
                doc, own = rid, []
            if text is None:
                own.append(sentence)
            elif own:
                texts.append(text)
                labels.append(own)
        out += labelled_counts(texts, labels)
    flat = out.reshape(-1)
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at].astype(np.int64))], names=["cell", "n"])


def _stripped_rows(batches):
    """(text) to (kind, key, a, b, c): the counts of ``stripped_counts``."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i, j in steps([len(t) for t in texts], 4 * STEP_CHARS):
            (kind, first, second, yes, n), lengths = stripped_cells(texts[i:j])
            keys = [_context(x, y) for x, y in zip(first.tolist(), second.tolist())]
            few = list(lengths.items())
            kinds = np.concatenate([kind, np.zeros(len(few), np.int64)]).astype(np.int32)
            sums = [np.concatenate([x.astype(float), [v[k] for _, v in few]]) for k, x in enumerate((yes, n, np.zeros(len(keys))))]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys + [x for x, _ in few], pa.string()), *map(pa.array, sums)], names=["kind", "key", "a", "b", "c"])


def train(docs: DataFrame, sentences: DataFrame | None = None) -> tuple[tuple[np.ndarray, np.ndarray], dict]:
    """Both models, from all labelled sentences and all texts in scripts without case.

    They are counted where they are: the driver gets the cells of the first model, and of the second the contexts that
    occur. Sentences and texts meet by sorting within the hash partitions of their document, without a table of both.
    """
    counts = np.zeros(int(np.prod(_CELLS)))
    if sentences is not None:
        known = sentences.filter("text is not null and doc_id is not null").select("doc_id", F.col("text").alias("sentence"), "sentence_id").distinct()
        both = known.select("doc_id", "sentence", F.lit(None).cast("string").alias("text")).union(docs.filter("text is not null and doc_id is not null").select("doc_id", F.lit(None).cast("string").alias("sentence"), "text"))
        rows = both.repartition("doc_id").sortWithinPartitions("doc_id", F.col("text").isNotNull())
        for cell, n in rows.mapInArrow(_labelled_rows, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
            counts[cell] = n
    uncased = docs.filter(F.col("text").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsDevanagari}\p{IsArabic}\p{IsThai}]")).select("text")
    rows = uncased.mapInArrow(_stripped_rows, "kind int, key string, a double, b double, c double").groupBy("kind", "key").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
    contexts = {(k, x): (yes, n) for k, x, yes, n, _ in rows if k}
    lengths = {x: (n, one, two) for k, x, n, one, two in rows if not k}
    return fit_both(counts.reshape(_CELLS)), stripped_model(contexts, lengths)


def unit_table(docs: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """doc_id, start_char, end_char: one row per sentence unit of every text."""
    weights, stripped = model

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in steps([len(t) for t in texts]):
                owner, first, last = units(texts[a:b], weights, stripped)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][owner]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc_id", "start_char", "end_char"])

    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, start_char int, end_char int")
