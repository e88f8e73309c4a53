"""Problem 10: private data in free text, found and replaced by typed placeholders.

Emails, phone numbers, identity numbers and street addresses are found by their formats and the words around them;
numbers count if they are valid for their kind. Persons' names are found by given names (exact, or one typing error off),
surnames that the same text uses with a given name, and by what stands around them: ``train`` counts, over at most
``SAMPLE`` texts, which words stand before, after and within names that a given name shows and which beside other
capitalised words; names that no list has are then told by their surroundings. In scripts without capitals the words
around a name decide. Nothing else of the text changes.

Numbers and dates are replaced by format-preserving Feistel pseudonyms: digits and letters are permuted, under a key,
within the positions they stand in, separators and country codes stay, and check characters that held are made to hold
again. Equal values thus stay linked across documents without being readable. Other kinds get a keyed tag. The key is an
argument and stands nowhere here: who has it can turn pseudonyms back.

Null and empty texts have no findings and stay as they are; repeated rows are treated alike; long texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from bisect import bisect_left
from collections import Counter
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import _NICK as _EVERY_NICK
from .names import plain
from .sentences import LOWER, UNCASED, UPPER, class_table, lower_table

_NICK = {k: v for k, v in _EVERY_NICK.items() if k.isascii()}
#: Bound on the texts whose names the surroundings of names are counted on.
SAMPLE = 2000

# ---- format-preserving pseudonyms -----------------------------------------------------------------------------------

ROUNDS = 10


@lru_cache(256)
def _keyed(key: bytes, tweak: str):
    return hashlib.blake2b(tweak.encode() + b"|", key=key, digest_size=16)


def _prf(key: bytes, tweak: str, turn: int, value: int, modulus: int) -> int:
    h = _keyed(key, tweak).copy()
    h.update(b"%d|%d|%d" % (turn, value, modulus))
    return int.from_bytes(h.digest(), "big") % modulus


def feistel(key: bytes, tweak: str, value: int, left: int, right: int) -> int:
    """A keyed permutation of range(left * right): ten rounds of an unbalanced Feistel network."""
    a, b = divmod(value, right)
    for turn in range(0, ROUNDS, 2):
        a = (a + _prf(key, tweak, turn, b, left)) % left
        b = (b + _prf(key, tweak, turn + 1, a, right)) % right
    return a * right + b


def unfeistel(key: bytes, tweak: str, value: int, left: int, right: int) -> int:
    """The inverse of ``feistel``."""
    a, b = divmod(value, right)
    for turn in range(ROUNDS - 2, -1, -2):
        b = (b - _prf(key, tweak, turn + 1, a, right)) % right
        a = (a - _prf(key, tweak, turn, b, left)) % left
    return a * right + b


def _permute(key: bytes, tweak: str, text: str, places: list[int], inverse: bool = False) -> str:
    """``text`` with the digits and letters at ``places`` permuted; digits stay digits and letters keep their case."""
    base = [10 if text[i].isdigit() else 26 for i in places]
    if len(places) < 2:
        return text
    value = 0
    for i, m in zip(places, base):
        value = value * m + (int(text[i]) if m == 10 else ord(text[i].upper()) - 65)
    left = right = 1
    for m in base[: len(base) // 2]:
        left *= m
    for m in base[len(base) // 2 :]:
        right *= m
    shape = "".join("9" if m == 10 else "A" for m in base)
    value = (unfeistel if inverse else feistel)(key, f"{tweak}|{shape}", value, left, right)
    out = list(text)
    for i, m in zip(reversed(places), reversed(base)):
        value, d = divmod(value, m)
        out[i] = str(d) if m == 10 else chr(65 + d) if text[i].isupper() else chr(97 + d)
    return "".join(out)


_NIE_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _nie_check(s: str) -> str:
    return _NIE_LETTERS[int("XYZ".index(s[0].upper()).__str__() + s[1:8]) % 23]


def _rut_check(digits: str) -> str:
    r = 11 - sum(int(d) * (2 + i % 6) for i, d in enumerate(reversed(digits))) % 11
    return {10: "K", 11: "0"}.get(r, str(r))


def pseudonym_number(key: bytes, value: str, kind: str, inverse: bool = False) -> str:
    """The pseudonym of a phone or identity number, in its own format; ``inverse`` gives the number back.

    The pseudonym depends on the digits and letters only, so values that differ in separators stay linked.
    """
    places = [i for i, c in enumerate(value) if c.isascii() and (c.isdigit() or c.isalpha() and kind == "id_number")]
    compact = "".join(value[i] for i in places)
    if kind == "phone":
        ext = re.search(r"[^\d\W]", value)
        places = [i for i in places if value[i].isdigit() and not (ext and i > ext.start())]
        code = re.match(r"\s*(?:\+|00)(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", value)
        if code:
            places = [i for i in places if i >= code.end()]
        elif value[places[0] :][:1] == "0" if places else False:
            places = places[1:]
        out = _permute(key, "phone", value, places, inverse)
        while places and out[places[0]] == "0" != value[places[0]]:  # a number without a leading 0 gets none
            out = _permute(key, "phone", out, places, inverse)
        return out
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", compact, re.I) and _nie_check(compact) == compact[8].upper():
        out = _permute(key, "nie", value, places[1:8], inverse)
        check = _nie_check("".join(out[i] for i in places))
        return out[: places[8]] + (check if compact[8].isupper() else check.lower()) + out[places[8] + 1 :]
    if re.fullmatch(r"\d{8}[\dK]", compact, re.I) and value.count(".") == 2 and _rut_check(compact[:8]) == compact[8].upper():
        out = _permute(key, "rut", value, places[:8], inverse)
        return out[: places[8]] + _rut_check("".join(out[i] for i in places[:8])) + out[places[8] + 1 :]
    return _permute(key, "id_number", value, places, inverse)


def valid(value: str, kind: str) -> bool:
    """Whether a phone or identity number can be one: as many digits as such numbers have, and not all the same."""
    digits = [c for c in value if c.isdigit()]
    if kind == "phone":
        return 7 <= len(digits) <= 21 and len(set(digits)) > 1
    return kind != "id_number" or 5 <= sum(c.isalnum() for c in value) <= 24 and len(digits) >= 4 and len(set(digits)) > 1


def pseudonym_date(key: bytes, value: datetime.date, first: datetime.date = datetime.date(1800, 1, 1), last: datetime.date = datetime.date(2099, 12, 31), inverse: bool = False) -> datetime.date:
    """A date permuted within a range of dates; dates outside the range stay."""
    n = (last - first).days + 1
    i = (value - first).days
    if not 0 <= i < n:
        return value
    left = 300
    right = -(-n // left)
    while True:  # cycle walking keeps the permutation within the range
        i = (unfeistel if inverse else feistel)(key, "date", i, left, right)
        if i < n:
            return first + datetime.timedelta(days=i)


_MONTHS = "january february march april may june july august september october november december".split()
_DATE = re.compile(r"(?<![\w.])(?:(\d{4})-(\d\d)-(\d\d)|(\d{1,2})([./])(\d{1,2})\5(\d{4})|(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4}))(?![\w])")
#: What announces a date of birth.
_BORN = re.compile(r"(?:\b(?:born(?:\s+on)?|date of birth|birth ?date|d\.?o\.?b\.?|geboren(?:\s+am)?|geburtsdatum|né(?:e)?\s+le|naci(?:ó|do|da)\s+el|fecha de nacimiento)|дата рождения|родил(?:ся|ась)|出生日期|生于)[\s:：,]{0,3}$", re.I)


def read_date(m: re.Match) -> datetime.date | None:
    """The date that a match of the date format writes (day before month), if there is such a day."""
    try:
        if m.group(1):
            return datetime.date(int(m.group(1)), int(m.group(2)), int(m.group(3)))
        if m.group(4):
            return datetime.date(int(m.group(7)), int(m.group(6)), int(m.group(4)))
        return datetime.date(int(m.group(10)), next(i for i, x in enumerate(_MONTHS, 1) if x.startswith(m.group(9).lower())), int(m.group(8)))
    except (ValueError, StopIteration):
        return None


def write_date(m: re.Match, day: datetime.date) -> str:
    """A date in the format of a match."""
    if m.group(1):
        return day.isoformat()
    if m.group(4):
        wide = len(m.group(4)) == 2 and len(m.group(6)) == 2
        return f"{day.day:02d}{m.group(5)}{day.month:02d}{m.group(5)}{day.year}" if wide else f"{day.day}{m.group(5)}{day.month}{m.group(5)}{day.year}"
    name = _MONTHS[day.month - 1] if len(m.group(9)) > 3 else _MONTHS[day.month - 1][:3]
    return f"{day.day} {name.title() if m.group(9)[0].isupper() else name} {day.year}"


def birth_dates(text: str) -> list[tuple[int, int, datetime.date, re.Match]]:
    """(start, end, date, match) of the dates of birth of a text: valid dates that such words announce."""
    out = []
    for m in _DATE.finditer(text):
        if _BORN.search(text, max(0, m.start() - 40), m.start()) and (day := read_date(m)):
            out.append((m.start(), m.end(), day, m))
    return out


def pseudonym(key: bytes, value: str, kind: str) -> str:
    """The pseudonym of a finding: numbers in their own format, other kinds as a keyed tag."""
    if kind in ("phone", "id_number"):
        return pseudonym_number(key, value, kind)
    form = " ".join(sorted(re.findall(r"\w+", plain(value)))) if kind == "name" else re.sub(r"\W+", "", plain(value).replace("[at]", "").replace("(at)", ""))
    return hashlib.blake2b(form.encode(), key=key, digest_size=4).hexdigest()


def placeholder(key: bytes, value: str, kind: str) -> str:
    """The typed placeholder of a finding."""
    return f"[{kind.upper()} {pseudonym(key, value, kind)}]"


# ---- formats --------------------------------------------------------------------------------------------------------

_BRACKETED_AT = re.compile(r"[\[({<]\s*(?:at|AT|At)\s*[\])}>]")
_AT = re.compile(rf"[@＠]|{_BRACKETED_AT.pattern}|(?<=\w)\s+(?:at|AT)\s+(?=[\w-]+\s+(?:dot|DOT)\s)")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+%'’-")


def local_part(text: str, at: int) -> int | None:
    """Where the local part of an address before ``at`` begins, however long it is; None if there is none."""
    end = at
    while end > max(0, at - 2) and text[end - 1].isspace():
        end -= 1
    start = end
    while start and text[start - 1] in _LOCAL:
        start -= 1
    while start < end and not (text[start].isascii() and text[start].isalnum()):
        start += 1
    return start if start < end else None


_DOMAIN = re.compile(r"\s{0,2}[A-Za-z0-9-]+(?:(?:\.|\s{0,2}[\[({]\s*(?:dot|DOT|Dot)\s*[\])}]\s{0,2}|\s+(?:dot|DOT|Dot)\s+)[A-Za-z0-9-]*[A-Za-z0-9])+")
_EXT = r"(?:[\s,;]{0,3}(?:ext\.?|extension|x|poste|доб\.?|Durchwahl|Apparat|int\.|分机|內線|内線|EXT\.?|Ext\.?)\s{0,2}\.?\s{0,2}\d{1,6})?"
_SEP = r"[\s.\-/]{0,2}"
_PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    rf"\+\d{{1,3}}(?:[\s.\-/()]{{0,3}}\d){{6,13}}|"
    rf"00[1-9]\d(?:{_SEP}\d){{7,13}}|"
    r"\(\d{2,5}\)[\s.-]{0,2}\d{3,4}[\s.-]\d{4}|"
    r"[2-9]\d\d([\s.-])[2-9]\d\d\1\d{4}|"
    r"0\d{2,4}[\s/-]{1,3}\d{6,9}|0\d{2,4}[\s/-]{1,3}\d{3,4}[\s-]{1,2}\d{4}|0\d(?:[\s.-]{1,2}\d\d){4}|"
    r"555-01\d\d"
    rf")(?!\d){_EXT}"
)
_ID = re.compile(
    r"(?<![\w.,/-])(?:"
    r"[89]\d\d([\s-])\d\d\1\d{4}|[0-7]\d\d-\d\d-\d{4}|"
    r"[A-Z]{2}\s\d\d\s\d\d\s\d\d\s[A-D]|[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]|"
    r"[XYZ]\d{7}[A-Z]|[A-Z]{2}\d{7}|"
    r"\d{1,2}\.\d{3}\.\d{3}-[\dKk]|\d{10}-[A-Z]|\d{3}-\d{4}-\d{3}-\d{2}|756\.\d{4}\.\d{4}\.\d{2}"
    r")(?![\w-])",
    re.I,
)
_ID_CUE = re.compile(
    r"(?:identity (?:number|card)|id(?:entity)? (?:no\.?|card|number)|passport(?: no\.?| number)?|reader['’]s card|social security(?: number)?|national insurance(?: number)?|ausweisnummer|personalausweis\w*|reisepass\w*|num[ée]ro d['’]identit[ée]|pi[èe]ce d['’]identit[ée]|n[úu]mero de identidad|dni|nie|паспорт\w*|снилс|инн|身份证号?码?|护照号?码?|身分証\w*|マイナンバー|पहचान संख्या|आधार(?: संख्या)?|رقم الهوية|هوية رقم|signed with)"
    r"[\s:：,]{0,3}(?:n[o°º]\.?\s*)?((?=(?:[^\d\n]{0,4}\d){6})[A-Za-z]{0,3}\s?\d[\dA-Za-z]*(?:[\s./-][\dA-Za-z]*\d[\dA-Za-z]*)*(?:[\s-][A-Z](?![\w]))?)",
    re.I,
)
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s+\d+\w?"
# Words for streets, which the address patterns are made of and by which their places are found.
_STREETS = "Street Str. St Road Rd Lane Ln Avenue Ave Terrace Square Sq Drive Court Close Way Place Boulevard Blvd Row Gardens Crescent Hill Mews Parade".split()
_RUES = "rue avenue av. bd. bd boulevard place quai chemin impasse allée cours Rue Avenue".split()
_CALLES = "C/ Calle Avda. Avd. Avenida Plaza Pza. Paseo".split()
_STRASSEN = "straße strasse str. weg gasse platz allee ring ufer damm".split()
_ULITSY = "ул улица пер переулок просп проспект пл наб".split()
_any_of = lambda words: f"(?:{'|'.join(map(re.escape, words))})"
_STREET = _any_of(_STREETS)
_TOWN = r"(?:,\s+(?!Flat|Apt)[A-Z][\w-]+(?:\s[A-Z][\w-]+)?\s+\d{4,5}\b|,\s+\d{4,6}\s+[A-Z][\w-]+(?:\s[A-Z][\w-]+)?)"
_ADDRESS_EN = (
    rf"(?<![\w./-])(?:{_FLAT},\s+)?\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][\w'’-]*\s+){{1,3}}{_STREET}\b(?:\.?,\s+{_FLAT})?{_TOWN}?"
    rf"|\bP\.?\s?O\.?\s?Box\s+\d+(?:,\s+(?:[A-Z][\w'’-]*\s+){{1,3}}{_STREET}\b)?{_TOWN}?"
)
_ADDRESS_OTHER = (
    rf"(?<![\w./-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_any_of(_RUES)}\s+(?:de\s+|du\s+|des\s+|d['’]|la\s+|le\s+|l['’])*[A-Z][\w'’-]+{_TOWN}?"
    rf"|\b{_any_of(_CALLES)}\s*(?:de\s+|del\s+|la\s+)*[A-Z][\w'’-]+,?\s+(?:n\.?\s?[º°o]\s*)?\d{{1,4}}(?:,\s+\d+\.?\s?[ºª]\s*[A-Z]?\b)?{_TOWN}?"
    rf"|\b[A-ZÄÖÜ][\w-]*{_any_of(_STRASSEN)}\s+\d{{1,4}}\s?[a-z]?\b(?:,\s+(?:Whg\.|Wohnung|App\.)\s*\d+)?{_TOWN}?"
    rf"|(?:\b\d{{6}},\s+)?(?:г\.\s*[А-ЯЁ][\w-]+,\s+)?\b{_any_of(_ULITSY)}\.?\s+[А-ЯЁ][а-яё-]+(?:\s[А-ЯЁ][а-яё-]+)?,\s+(?:д\.|дом)\s*\d+\w?(?:,\s+(?:кв|корп|стр)\.\s*\d+)*"
)
_ADDRESS = re.compile(f"{_ADDRESS_EN}|{_ADDRESS_OTHER}")
_ADDRESS_ANY_CASE = re.compile(f"{_ADDRESS_EN}|{_ADDRESS_OTHER}", re.I)
# Beginnings of what announces an identity number, in folded text.
_ID_WORDS = "identity n|identity c|identity|id n|id c|passport|reader's card|reader’s card|social security|national insurance|ausweisnummer|personalausweis|reisepass|numero d'identite|numero d’identite|piece d'identite|piece d’identite|numero de identidad|dni|nie|паспорт|снилс|инн|身份证|护照|身分証|マイナンバー|पहचान|आधार|رقم الهوية|هوية رقم|signed with".split("|")


# By alternative of the address patterns: what it has from its word for a street on, the words before that word among which
# its number stands (0 if that comes after it), and what it has from that number on.
_FROM_CUE = {
    "box": (r"Box\s+\d", 0, ""),
    "street": (rf"\s+{_STREET}\b", 4, rf"\d[A-Za-z]?\s+(?:[A-Z][\w'’-]*\s+){{1,3}}{_STREET}\b"),
    "rue": (rf"\s+{_any_of(_RUES)}\s+(?:de\s+|du\s+|des\s+|d['’]|la\s+|le\s+|l['’])*[A-Z][\w'’-]", 3, rf"\d(?:\s?(?:bis|ter))?,?\s+{_any_of(_RUES)}\s"),
    "calle": (rf"\b{_any_of(_CALLES)}\s*(?:de\s+|del\s+|la\s+)*[A-Z][\w'’-]+,?\s+(?:n\.?\s?[º°o]\s*)?\d", 0, ""),
    "strasse": (rf"{_any_of(_STRASSEN)}\s+\d", 0, ""),
    "ulitsa": (rf"\b{_any_of(_ULITSY)}\.?\s+[А-ЯЁ][а-яё-]+(?:\s[А-ЯЁ][а-яё-]+)?,\s+(?:д\.|дом)\s*\d", 0, ""),
}
_FROM_CUE = {kind: (re.compile(cue, re.I), words, re.compile(number, re.I)) for kind, (cue, words, number) in _FROM_CUE.items()}


def address_words() -> dict[str, list[str]]:
    """What every address holds one of, by alternative: the words of the patterns, with the space or stop that must stand
    beside them."""
    words = {"box": ["box "], "street": [f" {w}" for w in _STREETS], "rue": [f" {w} " for w in _RUES], "calle": _CALLES, "strasse": [f"{w} " for w in _STRASSEN], "ulitsa": [w + end for w in _ULITSY for end in (" ", ".")]}
    return {kind: sorted({fold(w) for w in forms}) for kind, forms in words.items()}


@cache
def _cues() -> ahocorasick.Automaton:
    """Beginnings of what may hold an address or announce an identity number, in folded text with plain spaces."""
    forms: dict[str, set[str]] = {}
    for kind, words in (*address_words().items(), ("id_number", _ID_WORDS)):
        for w in words:
            for form in (w, w.replace(" ", "  ")):
                forms.setdefault(form, set()).add(kind)
    automaton = ahocorasick.Automaton()
    for form, kinds in forms.items():
        automaton.add_word(form, (tuple(sorted(kinds)), len(form)))
    automaton.make_automaton()
    return automaton


def address_stands(text: str, flat: str, place: int, kind: str) -> bool:
    """Whether an address of this alternative can have its word for a street at a cue: what follows is there, and a number
    before it where one must be. Capitals are not asked for."""
    cue, words, number = _FROM_CUE[kind]
    m = cue.match(text, place)
    if not m or not words:
        return bool(m)
    a = place
    while a > 0 and flat[a - 1] == " ":
        a -= 1
    for _ in range(words):
        a = flat.rfind(" ", 0, a)
        while a > 0 and flat[a - 1] == " ":
            a -= 1
        if a <= 0:
            break
    return bool(number.search(text, max(0, a), m.end() + 1))  # one more, which tells whether the word ends


#: Words that an address can reach before and after one of its cue words; words may be of any length.
WORDS_BEFORE, WORDS_AFTER = 12, 16


def _windows(flat: str, places: list[int]) -> list[tuple[int, int]]:
    """Places widened to windows by words, overlapping ones joined; ``flat`` has a plain space for all white space."""
    out: list[tuple[int, int]] = []
    for p in places:
        a = p
        for _ in range(WORDS_BEFORE):
            a = flat.rfind(" ", 0, a)
            while a > 0 and flat[a - 1] == " ":
                a -= 1
            if a <= 0:
                break
        b, n = p, len(flat)
        for _ in range(WORDS_AFTER):
            b = flat.find(" ", b)
            if b < 0:
                b = n
                break
            while b < n and flat[b] == " ":
                b += 1
        a = max(0, a)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---- classes of characters ------------------------------------------------------------------------------------------

#: Classes by bit, each the set of one character that the patterns ask for.
DIGIT, CAPITAL, WORD, JOINED, BLANK, STOP, ZERO, LEAD = 1, 2, 4, 8, 16, 32, 64, 128
_CLASSES = {DIGIT: r"\d", CAPITAL: "[A-ZÀ-Þ]", WORD: r"\w", JOINED: r"[\w.'’&-]", BLANK: r"[^\S ]", STOP: r"[.\s]", ZERO: "0", LEAD: "[+(]"}


@cache
def _mark_table() -> np.ndarray:
    """The classes of every code point, as the patterns' own sets tell them."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for bit, pattern in _CLASSES.items():
        for m in re.finditer(f"{pattern}+", every):
            out[m.start() : m.end()] |= bit
    return out


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def marks(text: str) -> np.ndarray:
    """The classes of the characters of a text, with four of none behind them and one before."""
    out = np.zeros(len(text) + 5, np.uint8)
    out[1:-4] = _mark_table()[points(text)]
    return out


def matches_at(pattern: re.Pattern, text: str, places: list[int]):
    """What ``finditer`` gives of a pattern whose matches all begin at one of these places, in order."""
    last = 0
    for p in places:
        if p >= last and (m := pattern.match(text, p)):
            yield m
            last = m.end()


def digit_runs(classes: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of digits begin that an identity number can have first, and those that a phone number can have first: by
    their length and what stands beside them, which for runs of up to three is one mark or space and a digit behind it,
    unless a phone number begins with 0, + or a bracket."""
    digit = classes & DIGIT
    edges = np.flatnonzero(digit[1:] != digit[:-1])
    starts = edges[::2]
    ends = edges[1::2]
    sizes = ends - starts
    parted = classes[ends + 2] & DIGIT > 0
    ids = (sizes <= 3) & parted | (sizes == 6) | (sizes == 7) | (sizes == 10)
    phones = (sizes == 3) & parted | ((classes[starts + 1] & ZERO | classes[starts] & LEAD) > 0)
    return starts[ids].tolist(), starts[phones].tolist()


_ADDRESS_HAN = re.compile(r"(?:[一-龥]{2,3}省)?(?:[一-龥]{2,4}[市县])?(?:[一-龥]{2,3}区)?[一-龥]{2,5}(?:路|街|大道|巷)(?:\d+弄)?\d+号(?:\d+[室栋楼]|\d+单元)*|(?:[一-龥]{2,3}[都道府県])?(?:[一-龥]{1,3}[市区郡])?[一-龥]{1,3}[町村]\d+(?:丁目\d+番地?(?:\d+号)?|-\d+(?:-\d+)?)")
_HAN_NUMBER = re.compile(r"[路街道巷町村]\d")  # what every match of it holds
_HAN_LEAD = re.compile(r"^.*?(?:住在|位于|地址[是为：:]?|住所は|在(?=..市|..区)|の)")

# ---- names by what stands around them --------------------------------------------------------------------------------

_CAPITAL = r"[a-zß-ÿ'’]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?"
_CANDIDATE = re.compile(rf"([A-ZÀ-Þ](?<![\w@.'’&-].){_CAPITAL})((?:\s[A-ZÀ-Þ]\.?(?=\s)){{0,2}})\s([A-ZÀ-Þ]{_CAPITAL})(?![\w@'’&-])")
# Words with a capital that a name may follow but does not begin with.
_NOT_FIRST = frozenset("Dear Contact Call Ask Miss Sir Herr Frau Madame Monsieur Colleague".split())


def candidates(text: str, classes: np.ndarray):
    """Matches of two words with a capital, with initials between them, that may be a name."""
    match, last = _CANDIDATE.match, 0
    places = np.flatnonzero(classes[1:] & CAPITAL)
    for p in places[classes[places] & JOINED == 0].tolist():
        if p >= last and (m := match(text, p)):
            if m.group(1) in _NOT_FIRST:
                last = m.end(1)
                continue
            yield m
            last = m.end()


_WORD_AFTER = re.compile(r"\s*([^\W\d_]+|\S)")
#: Log-odds above which surroundings make capitalised words a name, the most that one of them counts, and cases its prior counts for.
SURE, MOST, DOUBT = 1.3, 4.0, 4.0
# Words that stand before and after names whatever the texts; each counts for as many cases as the prior.
_BEFORE_NAMES = "dr. prof. mr. mrs. ms. miss sir herr frau madame monsieur sr. sra. m. mme by dear contact ask call asked colleague".split()
_AFTER_NAMES = "said says wrote writes told asked called married replied signed lives works studied joined".split()


def surroundings(text: str, m: re.Match) -> list[str]:
    """The features of a candidate: the words before and after it (^ and $ beside a mark or nothing), and its own two."""
    before = text[max(0, m.start() - 40) : m.start()].rsplit(None, 1)
    after = _WORD_AFTER.match(text, m.end())
    b = before[-1].lower() if before else "^"
    if b[-1] in ".!?:;\"”»)" and b not in _TITLES_DOTTED:
        b = "^"
    return ["<" + b.lstrip("(\"“«„"), ">" + (after.group(1).lower() if after else "$"), "=" + _fold_word(m.group(1)), "=" + _fold_word(m.group(3))]


_TITLES_DOTTED = {w for w in _BEFORE_NAMES if w.endswith(".")}


def known_names(text: str, folded: str, classes: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[re.Match, bool | None]]]:
    """The names that lists and formats show, and the candidates: whether such a name covers them, None if in part."""
    classes = marks(text) if classes is None else classes
    spans = latin_names(text, folded, classes)
    marked = sorted(spans)
    out, k = [], 0
    for m in candidates(text, classes):
        while k < len(marked) and marked[k][1] <= m.start():
            k += 1
        first, last = m.span()
        if k < len(marked) and marked[k][0] < last:
            out.append((m, True if any(a <= first and b >= last for a, b in marked[k : k + 3]) else None))
        else:
            out.append((m, False))
    return spans, out


def _surrounding_rows(batches):
    """(text) to (feature, yes, no): how often each stands with names that lists show, and with other candidates."""
    for batch in batches:
        yes, no = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            for m, named in known_names(text, fold(text))[1]:
                if named is not None:
                    (yes if named else no).update(surroundings(text, m))
        keys = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([yes[k] for k in keys], pa.int64()), pa.array([no[k] for k in keys], pa.int64())], names=["feature", "yes", "no"])


def fit_surroundings(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-likelihood ratios of features, and the log-odds of a name among candidates (the empty feature).

    Words within names count against a candidate only: those of names do not recur, those of places and bodies do.
    """
    counts = dict(counts)
    for sign, words in (("<", _BEFORE_NAMES), (">", _AFTER_NAMES)):
        for w in words:
            yes, no = counts.get(sign + w, (0, 0))
            counts[sign + w] = yes + 20 * DOUBT, no
    total = {sign: [sum(v[i] for k, v in counts.items() if k[0] == sign) + 1 for i in (0, 1)] for sign in "<>="}
    out = {}
    for k, (yes, no) in counts.items():
        rate = total[k[0]][0] / sum(total[k[0]])
        x = float(np.log((yes + DOUBT * rate) / (no + DOUBT * (1 - rate)) * total[k[0]][1] / total[k[0]][0]))
        x = max(-MOST, min(MOST, x))
        if abs(x) > 0.5 and (k[0] != "=" or x < 0):
            out[k] = x
    return out


@cache
def _unfitted() -> dict[str, float]:
    return fit_surroundings({})


def train(docs: DataFrame) -> dict[str, float]:
    """The surroundings of names, counted on the ``SAMPLE`` texts of least hash where they are."""
    rows = docs.filter("text is not null").select("text", F.xxhash64("doc_id").alias("h"))
    last = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return fit_surroundings({})
    counts = rows.filter(F.col("h") <= F.lit(last)).select("text").mapInArrow(_surrounding_rows, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes"), F.sum("no")).filter("sum(yes) + sum(no) > 2")
    return fit_surroundings({k: (yes, no) for k, yes, no in counts.collect()})


def weaker(x: float) -> float:
    """What the weaker side counts: as it is if it speaks for a name, a third if it speaks against one, since any name may
    begin a sentence or stand before any word."""
    return x if x > 0 else x / 3


_LINE_BEFORE, _LINE_AFTER = re.compile(r"(?:^|\n)\s*$"), re.compile(r"[^\S\n]*(?:\n|$)")
_RUN_AFTER, _RUN_BEFORE = re.compile(r"\s[A-ZÀ-Þ][\w'’-]*"), re.compile(r"(?<!\S)(?!(?:Dr|Prof|Mrs?|Ms|Sra?|M|Mme|Miss|Sir|Herr|Frau|Madame|Monsieur|Dear|Contact|Call|Ask)\b)[A-ZÀ-Þ][\w'’-]*\s$")


def surrounded_names(text: str, found: list[tuple[re.Match, bool | None]], model: dict[str, float]) -> list[tuple[int, int]]:
    """The candidates that no list shows but whose surroundings do."""
    out = []
    for m, named in found:
        if named or _RUN_AFTER.match(text, m.end()):
            continue  # told already, or one of a run of capitals such as a title
        before, after, *own = (model.get(f, 0.0) for f in surroundings(text, m))
        if max(before, after) + weaker(min(before, after)) + sum(own) < SURE or m.group(1).lower() in _NEVER or m.group(3).lower() in _NEVER:
            continue
        if _ORG_AFTER.match(text, m.end(1)) or _ORG_AFTER.match(text, m.end()):
            continue  # a body's name
        if _RUN_BEFORE.search(text, max(0, m.start() - 40), m.start()) or _ORG_BEFORE.search(text, max(0, m.start() - 24), m.start()):
            continue
        if not (_LINE_BEFORE.search(text, max(0, m.start() - 2), m.start()) and _LINE_AFTER.match(text, m.end())):  # a line of its own is a heading
            out.append((m.start(), m.end()))
    return out


# ---- names ----------------------------------------------------------------------------------------------------------

# Given names; those that are also words count only with a capital.
_GIVEN = """abigail alan albert alice amelia andre andrea andrew angela anna anne anthony astrid barbara beatrice benjamin bernard bjorn bruno carla carlos caroline charles charlotte chloe christina christopher claire clara
claudia cynthia daniel david deborah diana dieter dorothy edith edward eleanor elena elias elizabeth emil emily emma eric erik ernst eugene eva felix florence frances francois francoise frederick gabriel george gerald gita
gregory hannah harold hedwig heinrich helen helena henry hugo ilse ines ingrid irene isabel jacqueline james jane johann john jonathan joseph josephine juan julia jurgen karim karl katherine kenneth klara laura lawrence
leila leonard louis louise lucia lucy luis magnus marek margaret maria marie martin mary matthew michael miguel monika nadia nathan nicholas nikolai noor oliver olga oskar otto pablo patricia paul pedro penelope peter
philip pierre quentin rachel raymond rebecca rene richard robert rosa ruth samuel sarah sergei simon sofia sophia soren stefan stephen susan tariq theodore theresa thomas timothy tobias ursula valerie victor victoria vincent virginia walter wanda william xenia
yasmin yusuf yvonne zachary zoe""".split()
_WORDS_TOO = set("art dick don drew frank gab gail gus hal jack jem jo joe kat kit mark max may mick nick pat pen penny pete pip ray rich rob ron rosa sam sandy sue ted tim toby tom tori val will bill bob dot dolly dan gene al ed ken len leo matt meg mike mitch ned nell nora phil ray stan steve terry vic walt wendy ben bert beth liz lisa kate fred dora grace rose hope charlie teddy jamie".split())
_ORG_AFTER = re.compile(r"\s+(?:Institute|Instit|Inst|University|Univ|Museum|Mus|Laboratory|Lab|Academy|Acad|Society|Soc|Association|Assn|Assoc|Brothers|Bros|Company|Co|Corporation|Corp|Limited|Ltd|Street|St|Road|Rd|Lane|Avenue|Ave|Terrace|Square|Bay|Railway|Glass|Paper|Printing|Shipping|Telegraph|Timber|Textile|Brewing|Mining|Salt|Clock|College|Hospital|Library|Foundation)\b", re.I)
_ORG_BEFORE = re.compile(r"(?:\b(?:University|Univ\.?|Uni|Institute|Association|Assn\.|Assoc\.|Museum|Academy|Society|Bay)\s+of|\b(?:Saint|St\.|Port|Pt\.|Fort|Ft\.|Lake|Mount|Mt\.|Upper|Upr\.|Lower|North|South|East|West|New|Cape))[\s-]+$", re.I)
_SURNAME = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)?"
_AFTER = re.compile(rf"((?:\s+[^\W\d_]\.?(?=\s)){{0,2}}|\s+[^\W\d_]\.[^\W\d_]\.)\s+({_SURNAME})")
_BEFORE_COMMA = re.compile(rf"({_SURNAME}),\s+$")
_BEFORE = re.compile(rf"({_SURNAME})\s+$")
_MIDDLE = re.compile(r"\s+[^\W\d_](?:\.|(?=[\s,;.)]))(?!\s?[^\W\d_]\.)")
_INITIALS = re.compile(r"(?<![\w.'’&-])([A-ZÀ-Þ])(?:\.\s?|\s)(?:([A-ZÀ-Þ])(?:\.\s?|\s))?([A-ZÀ-Þ][a-zß-ÿ]{4,}(?:-[A-Z][a-z]+)?)(?![\w@])")
_SURNAME_INITIALS = re.compile(r"(?<![\w'’-])([A-ZÀ-Þ][a-zß-ÿ]{4,}|[A-ZÀ-Þ]{5,}), ([A-ZÀ-Þ])\.(?:\s?[A-ZÀ-Þ]\.)?(?!\w)")
_COMMA_INITIAL = re.compile(r", [A-ZÀ-Þ]\.")
_PLACE_PREPOSITION = re.compile(r"\b(?:in|of|at|near|from|to|reach|made|de|à|en|von|bei|nach|cerca de|près de|between)\s+$", re.I)
_PLACES = re.compile(r"\b(?:Lake|Port|Pt\.|Fort|Ft\.|Mount|Mt\.|Saint|St\.|Upper|Upr\.|North|Bay of|University of|Univ\. of|Uni of|Association of|Assn\. of|Assoc\. of)[\s-]+([A-ZÀ-Þ][\w-]+)|\b([A-ZÀ-Þ][\w-]+)(?=(?:-|\s+)(?:Bay\b|bay\b|Institute|Instit|Inst\.|Museum|Mus\.|Lab|Academy|Acad|Society|Soc\.|Brothers|Bros|[A-Z]\w+ (?:Company|Comp\.|Co\b|Corp|Limited|Ltd)))")
_NEVER = set("the a an in on at by to of for from with and or but as is was were dr prof mr mrs ms st sir jr sr according visitors only then when while between after before until under dear call ask questions no not fig vol version inventory records critics flood why how what who was did which yet still later elsewhere moreover eventually however meanwhile nevertheless consequently afterwards nobody perhaps écrire le la les de du en el los am um im an der die das nr sagte dit dijo said told asked that both tel phone and holder".split())
# Surnames and given names of other scripts, and the words that stand beside names.
_HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤佘仝邬柒璩莘臧逄郗冼缪祁诸葛欧阳司马上官"
_NAME_HAN = re.compile(rf"(?:(?<=[，。“”：、；！？\s由与和人是对向给])|^|(?<=年)|(?<=》))((?:欧阳|诸葛|司马|上官|[{_HAN_SURNAMES}])[一-龥]{{1,2}})(?=说|写了|管理|住在|在[一-龥]|，电话|、|的|签|$|，“|。)", re.M)
_HAN_PLACE_END = set("镇乡市区县岭渡埠墩崖汀路街村桥塔湾")
_NAME_KANA = re.compile(r"[ァ-ヴー]{2,}・(?:[一-龥]{2}|[ァ-ヴー]{2,})|(?<![一-龥])[一-龥]{1,3}・[一-龥]{1,3}")
_DEVANAGARI_GIVEN = "नभ इरावन अरुणेश तरल सुरम्या कावेरी मेघना वेदिक राम सीता मोहन राधा कृष्ण गीता अमित सुनीता राजेश अनीता विजय प्रिया संजय नेहा अर्जुन पूजा रवि किरण".split()
_ARABIC_GIVEN = "مازن تميم رؤى سراب ضياء جمانة وسام لبنى محمد أحمد علي حسن فاطمة مريم يوسف عمر خالد زينب سارة ليلى نور هدى سعيد كريم طارق سامي رامي".split()
_CYRILLIC_GIVEN = "Марк Остап Лев Глеб Зоя Алла Вера Тимур Инга Рита Анна Иван Мария Пётр Ольга Сергей Елена Дмитрий Наталья Алексей Ирина Андрей Татьяна Михаил Николай Юрий Павел Борис Виктор Олег Игорь Максим Антон Роман Нина Юлия Дарья Софья Артём Егор Фёдор Лидия Галина".split()
_NAME_DEVANAGARI = re.compile(rf"(?<![ऀ-ॿ])(?:{'|'.join(_DEVANAGARI_GIVEN)})\s+[ऀ-ॿ]+(?![ऀ-ॿ])|(?:(?<=डॉ\. )|(?<=संपर्क: ))[ऀ-ॿ]+\s+[ऀ-ॿ]+(?=\s+ने|,)")
_NAME_ARABIC = re.compile(rf"(?<![؀-ۿ])(?:{'|'.join(_ARABIC_GIVEN)})\s+[ء-ي]{{3,}}(?![؀-ۿ])|(?:(?<=للتواصل مع )|(?<=د\. ))[ء-ي]+\s+[ء-ي]+(?=،|:|\s\d)")
_NAME_CYRILLIC = re.compile(rf"(?<!\w)(?i:(?:{'|'.join(_CYRILLIC_GIVEN)})\s+(?:[А-ЯЁ]\.\s*){{0,2}}[А-ЯЁ][а-яё-]{{3,}})(?!\w)|(?<!\w)[А-ЯЁ][а-яё]{{2,}}\s+[А-ЯЁ][а-яё]{{2,}}(?:ов|ова|ев|ева|ин|ина|ский|ская|цкий|цкая|ко|ук|юк|ич|ян)(?!\w)")


@cache
def _givens() -> tuple[set[str], set[str], ahocorasick.Automaton]:
    """Given names without accents: those known, those one typing error off, and an automaton of the known ones."""
    known = {x for x in (*_GIVEN, *_NICK, *(y for v in _NICK.values() for y in v)) if len(x) > 1}
    letters = "abcdefghijklmnopqrstuvwxyz"
    typed: set[str] = set()
    for w in _GIVEN:
        if len(w) == 4:
            typed.update(x for i in range(5) for c in letters if (x := w[:i] + c + w[i:]) not in _LINK_WORDS)
            typed.update(w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(3))
        if len(w) < 5:
            continue
        for i in range(len(w) + 1):
            typed.update(w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                typed.add(w[:i] + w[i + 1 :])
                typed.update(w[:i] + c + w[i + 1 :] for c in letters)
            if i + 1 < len(w):
                typed.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
    typed -= known | _NEVER
    automaton = ahocorasick.Automaton()
    for w in known:
        automaton.add_word(w, (w, True))
    automaton.make_automaton()
    return known, typed, automaton


_CAPITAL_WORD = re.compile(r"[A-ZÀ-ÞĀ-Ɏ][^\W\d_]{2,}")


def given_names(text: str, folded: str) -> list[tuple[int, tuple[str, bool]]]:
    """(last place, (name, whether it is known)) of the given names of a text: known ones in any case, and words with a
    capital that are one typing error off."""
    known, typed, automaton = _givens()
    slips = []
    if any(_is_slip(w) for w in set(_CAPITAL_WORD.findall(text)) if len(w) <= _LONGEST_SLIP):
        slips = [(m.end() - 1, (w, False)) for m in _CAPITAL_WORD.finditer(text) if (w := folded[m.start() : m.end()]) in typed]
    found = list(automaton.iter_long(folded))
    return sorted([*found, *slips], key=lambda x: x[0]) if slips else found


@cache
def _fold_table() -> np.ndarray:
    out = lower_table().copy()
    for c in range(0xC0, 0x250):
        x = plain(chr(c))
        if len(x) == 1:
            out[c] = ord(x)
    return out


def fold(text: str) -> str:
    """Lower case without accents on Latin letters, character by character."""
    if text.isascii():
        return text.lower()
    return _fold_table()[points(text)].tobytes().decode("utf-32-le", "surrogatepass")


_fold_word = lru_cache(1 << 14)(fold)


_LONGEST_SLIP = max(map(len, _GIVEN)) + 1


@lru_cache(1 << 15)
def _is_slip(word: str) -> bool:
    return fold(word) in _givens()[1]


def _same_case(a: str, b: str) -> bool:
    """Whether a surname is written like the given name beside it: capital, or all small."""
    return b[0].isupper() if a[0].isupper() else b.islower()


def _initial_places(classes: np.ndarray) -> list[int]:
    """Where ``_INITIALS`` can begin: at a capital on its own, with another one behind a stop, a space or both."""
    capital = classes & CAPITAL > 0
    places = np.flatnonzero(capital[1:-3] & (classes[2:-2] & STOP > 0))
    return places[(classes[places] & JOINED == 0) & (capital[places + 3] | capital[places + 4])].tolist()


def _surnames_with_initials(text: str):
    """The matches of ``_SURNAME_INITIALS``, looked for from the space before each comma with an initial behind it."""
    last = 0
    for c in _COMMA_INITIAL.finditer(text):
        m = _SURNAME_INITIALS.search(text, max(last, text.rfind(" ", last, c.start()) + 1), c.start() + 8)
        if m:
            yield m
            last = m.end()


def latin_names(text: str, folded: str, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans of persons' names in Latin script; ``folded`` is the text in lower case without accents, of equal length,
    ``classes`` its ``marks``."""
    classes = marks(text) if classes is None else classes
    spans: list[tuple[int, int]] = []
    surnames: set[str] = set()
    n = len(text)
    taken = -1
    doubtful: list[tuple[int, int]] = []
    last = -1
    for end, (given, sure) in given_names(text, folded):
        a, b = end - len(given) + 1, end + 1
        if a < taken or a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@_+'’") or b < n and (text[b].isalnum() or text[b] in "@_+"):
            continue
        if a > 1 and text[a - 1] == "." and not (text[a].isupper() and text[a - 2].islower()):
            continue
        word = text[a:b]
        capital = word[0].isupper()
        if not capital and (not sure or given in _WORDS_TOO or given in _NICK):
            continue
        m = _AFTER.match(text, b)
        if m:
            s = m.group(2)
            good = len(s) > 3 and _same_case(word, s) and s.lower() not in _NEVER and (not word.isupper() or len(word) < 2 or s.isupper() or not text[a - 12 : a].isupper())
            if good and not capital:
                good = len(s) > 5 and not s.endswith(("ing", "ed", "tion", "ment"))
            if good and (_ORG_AFTER.match(text, m.end()) or _ORG_BEFORE.search(text, max(0, a - 24), a)):
                continue
            if good and sure:
                # a reversed name before a capitalised word that only begins a sentence cannot be told; the order given-surname is taken
                spans.append((a, m.end()))
                surnames.add(s.lower())
                taken = m.end()
                continue
            if good:
                doubtful.append((a, m.end()))
                spans.append((a, m.end()))
                surnames.add(s.lower())
                taken = m.end()
                continue
        low = max(0, a - 40)
        stop = low + len(text[low:a].rstrip())
        if stop == low or stop == a:
            continue
        low = max(low, text.rfind(" ", low, stop) + 1)
        m = None
        if comma := text[stop - 1] == ",":
            m = _BEFORE_COMMA.search(text, low, a)
        elif sure and capital:
            m = _BEFORE.search(text, low, a)
        if m and m.start() > last and len(m.group(1)) > 3 and m.group(1)[0].isupper() and m.group(1).lower() not in _NEVER and (sure or comma):
            s = m.group(1)
            if not comma and (_ORG_BEFORE.search(text, max(0, m.start() - 24), m.start()) or s.lower() in _LINK_WORDS):
                continue
            e = _MIDDLE.match(text, b)
            stop = e.end() if e else b
            spans.append((m.start(), stop))
            surnames.add(s.lower())
            taken = last = stop
    places: set[str] | None = None
    for p, found in ((_INITIALS, matches_at(_INITIALS, text, _initial_places(classes))), (_SURNAME_INITIALS, _surnames_with_initials(text))):
        for m in found:
            s = m.group(3 if p is _INITIALS else 1)
            low = s.lower()
            if low in _NEVER or fold(low) in _givens()[0] or m.group().lower().endswith(("e.g.", "i.e.", "p.m.", "a.m.")) or _ORG_AFTER.match(text, m.end()):
                continue
            if low not in surnames:
                if places is None:
                    words = classes & WORD
                    edges = np.flatnonzero((classes[1:] & CAPITAL > 0) & (words[1:] != words[:-1]))
                    places = {x.lower() for y in matches_at(_PLACES, text, edges.tolist()) for x in y.groups() if x}
                lead = _PERSON_LEAD.search(text, max(0, m.start() - 16), m.start())
                if low in places or not (p is _INITIALS and m.group(2)) and _PLACE_PREPOSITION.search(text, max(0, m.start() - 14), m.start()):
                    continue
                if p is _INITIALS and not lead and (m.group(1) in "LNSEW" and not m.group(2) or m.group(1) in "AI" and text[m.start() + 1] == " "):
                    continue
            spans.append((m.start(), m.end()))
    return spans


_LINK_WORDS = set("called named holder contact donor surveyor saint museum institute limited company corporation and sunday monday january february march april may june july august september october november december street road lane dear lady lord king queen father mother doctor professor captain".split())
_PERSON_LEAD = re.compile(r"(?:\b(?:by|under|credit|and|Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Sr\.|among them|dit|dijo|sagte|para|holder|donor|to|engineer|married|épousa|con|bei|that)|[\"”»“],?)\s+$")


_OTHER_SCRIPTS = re.compile("[一-龥ァ-ヴऀ-ॿ؀-ۿА-я]")


def _occurrences(words: set[str], text: str) -> list[tuple[int, int]]:
    """Where these words stand, from left to right without overlaps, the longest first."""
    every = []
    for w in words:
        a = text.find(w)
        while a >= 0:
            every.append((a, -len(w)))
            a = text.find(w, a + 1)
    out, last = [], 0
    for a, size in sorted(every):
        if a >= last:
            last = a - size
            out.append((a, last))
    return out


def _non_latin_names(text: str) -> list[tuple[int, int]]:
    spans = []
    if not _OTHER_SCRIPTS.search(text):
        return spans
    scripts = {_script_of(c) for c in set(text)}
    if "han" in scripts:
        found = {m.group(1) for m in _NAME_HAN.finditer(text) if m.group(1)[-1] not in _HAN_PLACE_END and len(m.group(1)) > 1}
        firm = {x for x in found if len(x) == 3}
        firm |= {x for x in found if len(x) == 2 and not any(y.startswith(x) for y in firm)}
        if firm:
            spans += _occurrences(firm, text)
    if "kana" in scripts:
        spans += [(m.start(), m.end()) for m in _NAME_KANA.finditer(text)]
    if "devanagari" in scripts:
        spans += [(m.start(), m.end()) for m in _NAME_DEVANAGARI.finditer(text)]
    if "arabic" in scripts:
        spans += [(m.start(), m.end()) for m in _NAME_ARABIC.finditer(text)]
    if "cyrillic" in scripts:
        spans += [(m.start(), m.end()) for m in _NAME_CYRILLIC.finditer(text)]
    return spans


def _script_of(c: str) -> str | None:
    return "han" if "一" <= c <= "龥" else "kana" if "ァ" <= c <= "ヴ" else "devanagari" if "ऀ" <= c <= "ॿ" else "arabic" if "؀" <= c <= "ۿ" else "cyrillic" if "А" <= c <= "я" else None


#: Characters around a place by which its capitals are judged, and the steps in which they move on.
AROUND, STEP = 4000, 1000


def useless_capitals(text: str, step: int) -> bool:
    """Whether hardly any or most letters around a step of a text are capitals, so that they tell nothing."""
    start = max(0, min(step * STEP - (AROUND - STEP) // 2, len(text) - AROUND))
    kinds = class_table()[points(text[start : start + AROUND])]
    letters, upper = int(((kinds >= LOWER) & (kinds <= UNCASED)).sum()), int((kinds == UPPER).sum())
    return upper * 100 < letters or upper * 2 > letters


def find(text: str, model: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the private data of a text, in order, without overlaps; ``model`` is what ``train`` gives."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if a < b and free(a, b):
            out.append((a, b, kind))

    folded, classes = fold(text), marks(text)
    if "@" in text or "＠" in text or "dot" in folded or _BRACKETED_AT.search(text):
        for m in _AT.finditer(text):
            left, right = local_part(text, m.start()), _DOMAIN.match(text, m.end())
            if left is not None and right and (m.group()[0] not in "@＠" or not text[m.start() - 1].isspace() and not right.group()[:1].isspace()):
                add(left, right.end(), "email")
    if (classes & DIGIT).any():
        flat = folded
        for c in {text[p] for p in np.flatnonzero(classes[1:] & BLANK).tolist()}:
            flat = flat.replace(c, " ")
        announced, spots = [], []
        for end, (kinds, size) in _cues().iter(flat):
            for kind in kinds:
                (announced if kind == "id_number" else spots).append((end - size + 1, kind))
        for p, _ in sorted(announced):
            m = _ID_CUE.match(text, p)
            if m and not _PHONE.fullmatch(m.group(1).strip()) and valid(m.group(1), "id_number"):
                add(m.start(1), m.end(1), "id_number")
        ids, phones = digit_runs(classes)
        for kind, a, b in (*numbers(text, ids, _ID, "id_number", 3, _ID_LEAD), *numbers(text, phones, _PHONE, "phone", 1, _PHONE_LEAD)):
            if valid(text[a:b], kind):
                add(a, b, kind)
        if stands := sorted({p for p, kind in spots if address_stands(text, flat, p, kind)}):
            spots = sorted(p for p, _ in spots)
            any_case = {k: useless_capitals(text, k) for k in {p // STEP for p in spots}}
            for pattern, told in ((_ADDRESS, False), (_ADDRESS_ANY_CASE, True)):
                for a, b in _windows(flat, [p for p in spots if any_case[p // STEP] == told]):
                    k = bisect_left(stands, a)
                    if k < len(stands) and stands[k] < b:
                        for m in pattern.finditer(text, a, b):
                            add(m.start(), m.end(), "address")
        if _HAN_NUMBER.search(text):
            for m in _ADDRESS_HAN.finditer(text):
                lead = _HAN_LEAD.match(m.group())
                add(m.start() + (lead.end() if lead else 0), m.end(), "address")
    out.sort()
    blocked = out[:]
    names: list[tuple[int, int, str]] = []
    told, others = known_names(text, folded, classes)
    more = surrounded_names(text, others, _unfitted() if model is None else model)
    if more:  # a part of a name that its initial shows gives way to the whole
        told = [(a, b) for a, b in told if not any(a < y and b > x for x, y in more)]
    spans = sorted(told + more + ([] if text.isascii() else _non_latin_names(text)))
    k, reach = 0, -1
    for a, b in spans:
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        if a >= reach and (k >= len(blocked) or blocked[k][0] >= b):
            names.append((a, b, "name"))
            reach = b
    return sorted(out + names)


def numbers(text: str, runs: list[int], pattern: re.Pattern, kind: str, most: int, lead: frozenset[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of a pattern that begin at one of these runs of digits or up to ``most`` characters
    before it, at one of ``lead``, from left to right; that is where all matches of the number patterns begin."""
    out = []
    match, last = pattern.match, 0
    for p in runs:
        if p < last:
            continue
        m = None
        if p and text[p - 1] in lead or most > 1 and text[p - 1] == " ":
            for a in range(max(last, p - most), p):
                if text[a] in lead and (m := match(text, a)):
                    break
        if m or (m := match(text, p)):
            out.append((kind, m.start(), m.end()))
            last = m.end()
    return out


_ID_LEAD, _PHONE_LEAD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("+(")
_DIGIT = re.compile(r"\d")


def redact(text: str, key: bytes, model: dict[str, float] | None = None) -> str:
    """The text with every finding replaced by its placeholder."""
    parts, at = [], 0
    for a, b, kind in find(text, model):
        parts += [text[at:a], placeholder(key, text[a:b], kind)]
        at = b
    return "".join([*parts, text[at:]])


# ---- the operators --------------------------------------------------------------------------------------------------


def session_key(spark) -> str:
    """The key of ``spark.lodestrand.pseudonym.key``; without one, a random key that lasts as long as the session."""
    name = "spark.lodestrand.pseudonym.key"
    key = spark.conf.get(name, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(name, key)
    return key


def _secret(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def findings(docs: DataFrame, key: str, model: dict[str, float] | None = None, tags: bool = True, dates: bool = False) -> DataFrame:
    """doc_id, start_char, end_char, kind, pseudonym of all private data; with ``dates``, dates of birth as kind ``date`` too.

    Numbers are validated and permuted within their format; the keyed tags of other kinds are made only with ``tags``.
    """
    secret = _secret(key)
    model = fit_surroundings({}) if model is None else model

    def run(batches):
        @lru_cache(1 << 16)
        def other(value: str, kind: str) -> str | None:
            return pseudonym(secret, value, kind) if tags or kind in ("phone", "id_number") else None

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, a, b, kind, other(text[a:b], kind)) for a, b, kind in find(text, model)]
                if dates:
                    rows += [(doc, a, b, "date", write_date(m, pseudonym_date(secret, day))) for a, b, day, m in birth_dates(text)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "start_char", "end_char", "kind", "pseudonym"])

    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, start_char int, end_char int, kind string, pseudonym string")


def redacted(docs: DataFrame, key: str, model: dict[str, float] | None = None) -> DataFrame:
    """doc_id, text with private data replaced; null texts stay null."""
    secret = _secret(key)
    model = fit_surroundings({}) if model is None else model

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, secret, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
