"""Patterns are tried only where they can match, and give there what a search of the whole text gives."""

import re

import pytest

from lodestrand.llm import privacy
from lodestrand.sources.tables import table

ODD = [
    "", "A", " A. B", "12", "Flat 3, 12 Old  Bridge\r\nStreet, Bath 24035; P.O. Box 7", "+44 20 7946 0508 (417) 555-0125 00 555-0126 030/23125418 417-555-0125",
    "X1744619Z AB 12 34 56 D ab123456c 986-40-4111 12.345.678-K 1234567890-A 756.1234.5678.90 123-4567-890-12 1903 12.5 7 403655581",
    "Basitojebask, I. S. and SMITHERS, J. or Mac-Donald, A.B; Abcde, X. Y.Z Abcdef, A. Bcdefg, B.", "J. K. Basitojebask met A Basitojebask, R. Zumaki-Wigurt and S.\nOrmerodson",
    "Lake Bamepo, North-Bamepo, Bamepo Bay, Zumaki Paper Company, xLake Foo, Saint Institute", "王小明说，王小明和王小在，王小说。", "It cost 85 Gulden \nStr.Ost, 7 bis, rue du Lac, 12 Old Str. and 3 Quai Rd", "×Abcde, X. É. Île Ünder ٣٣٣-٣٣ K. Àbcdef",
]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").filter("text is not null").orderBy("doc_id").limit(400).collect()]


def test_years_and_street_words_alone_are_not_tried(monkeypatch):
    """Neither the address patterns nor those of numbers run over years and street words that no number belongs to."""
    tried = []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, *args):
            tried.append(args[1:])
            return self.pattern.finditer(*args)

    for name in ("_ADDRESS", "_ADDRESS_ANY_CASE"):
        monkeypatch.setattr(privacy, name, Counting(getattr(privacy, name)))
    runs, numbers = [], privacy.numbers
    monkeypatch.setattr(privacy, "numbers", lambda text, places, *rest: runs.extend(places) or numbers(text, places, *rest))
    plain = "The road to the mill took the place of the old way, a row of stones by the hill and the court, in about 1903. " * 20
    for text in (plain, plain.upper()):
        assert privacy.find(text) == [] and not tried and not runs
    assert [k for *_, k in privacy.find(plain + "Write to 12 Old Bridge Street or 417-555-0125.")] == ["address", "phone"] and tried and runs


def test_places_lose_no_match(texts):
    """What begins at the places looked up is what the patterns find in the whole text."""
    spans = lambda found: [m.span() for m in found]
    total = 0
    for text in texts:
        classes = privacy.marks(text)
        assert spans(privacy.matches_at(privacy._INITIALS, text, privacy._initial_places(classes))) == spans(privacy._INITIALS.finditer(text))
        assert spans(privacy._surnames_with_initials(text)) == spans(privacy._SURNAME_INITIALS.finditer(text))
        assert [m.span() for m in privacy.candidates(text, classes) if m] == spans(_searched(text))
        every = [m.start() for m in re.finditer(r"\d+", text)]
        ids, phones = privacy.digit_runs(classes)
        for few, *rest in ((ids, privacy._ID, "id_number", 3, privacy._ID_LEAD), (phones, privacy._PHONE, "phone", 1, privacy._PHONE_LEAD)):
            found = privacy.numbers(text, every, *rest)
            assert privacy.numbers(text, few, *rest) == found
            total += len(found)
        assert bool(privacy._HAN_NUMBER.search(text)) >= bool(privacy._ADDRESS_HAN.search(text))
        words = {"王小明", "王小", "the", "then", "hen"}
        assert privacy._occurrences(words, text) == spans(re.finditer("王小明|then|the|hen|王小", text))
    assert total > 20


def _searched(text):
    at = 0
    while m := privacy._CANDIDATE.search(text, at):
        named = m.group(1) not in privacy._NOT_FIRST
        at = m.end() if named else m.end(1)
        if named:
            yield m


def test_every_address_has_a_cue(texts):
    """Each match of the address patterns holds a cue at which its alternative is told to stand."""
    total = 0
    for text in texts:
        flat = re.sub(r"\s", " ", privacy.fold(text))
        stands = {end - size + 1 for end, (kinds, size) in privacy._cues().iter(flat) for k in kinds if k != "id_number" and privacy.address_stands(text, flat, end - size + 1, k)}
        for pattern in (privacy._ADDRESS, privacy._ADDRESS_ANY_CASE):
            for m in pattern.finditer(text):
                total += 1
                assert any(m.start() <= p < m.end() for p in stands), m.group()
    assert total > 20
