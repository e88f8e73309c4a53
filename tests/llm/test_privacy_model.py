"""Names that no list has, dates of birth, values of any length, keys."""

import random
import re

import pytest

from lodestrand.llm import privacy
from lodestrand.sources.tables import table


@pytest.fixture(scope="module")
def model(spark):
    return privacy.train(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize("name", ["Priyanka Deshmukh", "Oluwaseun Adeyemi", "Kwame Nkrumah", "Siobhan Murphy"])
def test_names_outside_any_list(model, name):
    assert privacy.plain(name.split()[0]) not in privacy._givens()[0] | privacy._givens()[1]
    for m in (model, None):
        for text in (f"The mill was built by {name} in 1903.", f"We met Dr. {name} and left.", f"{name} joined the museum in 1903.", f"Please contact {name} at the office.", f"„Wir gehen“, sagte {name}." if m else f"Mr. {name} left."):
            assert name in [text[a:b] for a, b, k in privacy.find(text, m) if k == "name"], text
    for text in ("In New York the Grand Hotel was closed.", "The Great Wall was flooded by Rising Waters of the Bay.", "Steinerne Brücke Torfabbau"):
        assert not privacy.find(text, model)


def test_recall_on_invented_given_names(spark, model):
    """With every given name replaced by an invented one, eight names in ten are found by what stands around them."""
    r = random.Random(4)
    hits = total = 0
    for row in table(spark, "/root/testdata/sf0.01", "documents").filter("lang in ('en', 'fr', 'es') and text is not null").orderBy("doc_id").limit(300).collect():
        text = row.text
        if privacy.useless_capitals(text, 0):
            continue
        names = []
        for a, b in privacy.latin_names(text, privacy.fold(text)):
            m = re.fullmatch(r"([A-Z][a-z]+)( [A-Z]\.)? ([A-Z][a-z]{4,})", text[a:b])
            if m and len(names) < 6:
                names.append((a, m.group(1), text[a:b]))
        for a, given, whole in sorted(names, reverse=True):
            other = "".join(r.choice("vzkqw") + r.choice("aou") for _ in range(3)).capitalize()
            text = text[:a] + other + text[a + len(given) :]
        found = {text[a:b] for a, b, k in privacy.find(text, model) if k == "name"}
        shift = 0
        for a, given, whole in sorted(names):
            here = text[a + shift : a + shift + 6 + len(whole) - len(given)]
            shift += 6 - len(given)
            total += 1
            hits += here in found
    assert total > 200 and hits >= 0.8 * total, (hits, total)


def test_long_values():
    """No window cuts a match: long local parts, domains, street names, numbers far from their words."""
    local, street = "a" * 200 + ".b", "S" + "o" * 150
    assert [privacy.find(f"Write to {local}@{'x' * 100}.example.org now.")[0][2]] == ["email"]
    text = f"Write to {local}@{'x' * 100}.example.org now."
    a, b, _ = privacy.find(text)[0]
    assert text[a:b] == f"{local}@{'x' * 100}.example.org"
    for text in (f"Send it to 12 {street} Street today.", f"Send it to 12 Old {' ' * 200} Bridge Street today.", f"Send it to 12 Old Bridge Street, {street} 24035 today."):
        assert [k for *_, k in privacy.find(text)] == ["address"]
    number = "X1" + "-23" * 11
    text = f"Her passport number: {number} is old."
    assert [text[a:b] for a, b, _ in privacy.find(text)] == [number]


def test_valid_values():
    assert privacy.valid("+44 20 7946 0508", "phone") and not privacy.valid("0000000", "phone") and not privacy.valid("123", "phone")
    assert privacy.valid("X1234567L", "id_number") and not privacy.valid("000-00-0000", "id_number")
    assert not privacy.find("Her identity number 000-00-0000 is void.")


@pytest.mark.parametrize("text, day", [("Ada was born on 12 May 1990 in Bath.", "12 May 1990"), ("geboren am 03.11.1984", "03.11.1984"), ("Date of birth: 1970-01-31;", "1970-01-31"), ("né le 1/2/1999", "1/2/1999"), ("дата рождения: 05.06.1977", "05.06.1977")])
def test_birth_dates(text, day):
    (a, b, value, m), = privacy.birth_dates(text)
    other = privacy.pseudonym_date(b"key", value)
    assert text[a:b] == day and privacy.write_date(m, value) == day and privacy.write_date(m, other) != day
    assert re.sub(r"[A-Za-z]+", "M", re.sub(r"\d", "9", privacy.write_date(m, other))).replace("99", "9") == re.sub(r"[A-Za-z]+", "M", re.sub(r"\d", "9", day)).replace("99", "9")
    assert not privacy.birth_dates("It was sold on 12 May 1990.") and not privacy.birth_dates("born on 31.02.1990")


def test_linked(spark):
    """Equal values have equal pseudonyms in every document, under one key only; there is no key to fall back on."""
    docs = spark.createDataFrame([(1, "Call +44 20 7946 0508; born on 12 May 1990."), (2, "Tel. +44 20 79460508, geboren 12.05.1990, +44 20 7946 0509"), (3, None), (4, "")], "doc_id long, text string")
    rows = lambda key: {(r.doc_id, r.start_char): (r.kind, r.pseudonym) for r in privacy.findings(docs, key, dates=True).collect()}
    got = rows("k")
    digits = lambda i: [re.sub(r"\D", "", p) for (d, _), (k, p) in sorted(got.items()) if d == i and k == "phone"]
    assert digits(1)[0] == digits(2)[0] != digits(2)[1] and digits(1)[0].startswith("44") and got != rows("other") and got == rows("k")
    days = [p for (d, _), (k, p) in sorted(got.items()) if k == "date"]
    assert len(days) == 2 and days[0] != "12 May 1990"
    with pytest.raises(TypeError):
        privacy.findings(docs)
    assert privacy.session_key(spark) == privacy.session_key(spark)
