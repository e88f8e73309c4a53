"""Answer pairs, names, mixtures, private data."""

import datetime
import random

import pytest

from lodestrand.llm import mixing, names, pairs, privacy
from lodestrand.sources.tables import table

KEY = b"test key"


def test_single_checks():
    assert all(map(pairs.is_empty, (None, "", " 　", "N/A", "Answer:", "[]", "—", "null")))
    assert not any(map(pairs.is_empty, ("no", "None of them", "0", "wool")))
    q = "Which is older, Fort Ab or Lake Cd?"
    assert pairs.is_copy(q, q) and pairs.is_copy(q, "Answer: " + q.lower()[:-1]) and pairs.is_copy(q, f"{q} {q}")
    assert not any(pairs.is_copy(q, a) for a in ("Fort Ab", q[:-1] + ": Fort Ab", "Lake Cd is older", ""))
    assert pairs.is_other_language("Who sold the bridge?", "La fragua fue vendida en el año por los dueños.") and pairs.is_other_language("Wer hat die Brücke verkauft?", "第3号桥很宽而且很长。")
    assert not any(pairs.is_other_language(*x) for x in (("Wer hat die Brücke verkauft?", "International Printing Association of Ab"), ("石桥是谁出售的？", "Ada Lee"), ("Who sold it?", "The bridge was sold by them.")))
    assert pairs.against_other("Ada Byr", "Ada Byron") and pairs.against_other("She went to the old bridge and", "She went to the old bridge and fell.")
    assert not pairs.against_other("Ada Byron", "Ada Byron.") and not pairs.against_other("no", "no, only one of them") and not pairs.against_other("One is. ", "One is. Two is.")


def test_defects(spark):
    done = [(100 + i, f"Why was the bridge of Ab{i} sold in {1700 + i}?", f"The old bridge of Ab{i} was sold in {1700 + i} by the weavers.", f"The old bridge of Ab{i} was sold in {1700 + i} by the weavers") for i in range(30)]
    rows = done + [
        (1, "Who sold it?", "Ada", None), (2, "Who sold the bridge of Xy?", "Ada", "Who sold the bridge of Xy?"), (3, "Who sold it?", "Ada", "I cannot answer this question."),
        (4, "Why was it sold?", "It rained.", "The old bridge of Ab7 was sold in 17"), (5, "Why was it sold?", "It was.", "The old bridge of Ab3 was sold in 1703 by the"), (6, "Who sold it?", "Adalbert", "Adalb"),
        (7, "Why?", "Dora cannot enter the bridge because the weaver holds it.", "no"), (8, None, None, None),
    ]
    got = {(r.example_id, r.field): r.defect for r in pairs.defects(spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "example_id long, question string, gold_answer string, predicted_answer string")).collect()}
    assert got == {(1, "predicted_answer"): "empty", (2, "predicted_answer"): "copies_question", (3, "predicted_answer"): "refusal", (4, "predicted_answer"): "truncated", (5, "predicted_answer"): "truncated", (6, "predicted_answer"): "truncated", (8, "predicted_answer"): "empty", (8, "gold_answer"): "empty"}


def test_common_fragments(spark):
    """A word that breaks off is found however often its fragment is a word elsewhere, and in copies of one answer."""
    made = [(100 + i, f"Whom did Ada{i} marry?", f"Ada{i} Soxenov married Otto{i} Lee.", f"Ada{i} Soxenov married Otto{i} Lee.") for i in range(30)]
    seas = [(200 + i, f"Wie sah Eva{i} das mar?", f"Eva{i} sah das mar {i} gern.", "no") for i in range(20)]
    copies = [(300 + i, "Whom did Dora marry?", "Otto Lee", "Dora Soxenov marri") for i in range(6)]
    rows = made + seas + copies + [(1, "Whom did Ines marry?", "Otto Lee", "Ines Soxenov mar"), (2, "What did Eva see?", "das mar", "Tom")]
    got = {(r.example_id, r.field): r.defect for r in pairs.defects(spark.createDataFrame(rows, "example_id long, question string, gold_answer string, predicted_answer string")).collect()}
    assert got == {(1, "predicted_answer"): "truncated"} | {(300 + i, "predicted_answer"): "truncated" for i in range(6)}


def linked(spark, spellings):
    rows = [([s], None) for s in spellings] + [(None, [(spellings[0], "r", spellings[0], None, None)]), ([""], [])]
    df = spark.createDataFrame(rows, "entities array<string>, triples array<struct<head:string,relation:string,tail:string,confidence:double,extractor:string>>")
    return {(r.name_a, r.name_b) for r in names.pairs(df).collect()}


def groups_of(found, spellings):
    return {frozenset(x for x in spellings if x == s or (min(x, s), max(x, s)) in found) for s in spellings}


@pytest.mark.parametrize(
    "want",
    [
        [{"Margaret S. Lee-Morane", "Peggy Lee-Morane", "LEE-MORANE, Margaret", "margaret lee morane", "M. Lee-Morane" }],
        [{"Rebecca Parumez", "Becky Parumez", "Parumez, Rebecca", "Parumez Rebecca", "Dr. Rebecca Parumez", "Rebeca Parumez"}, {"Ann Parumez"}],
        [{"R. Virerivagon"}, {"Robert Virerivagon"}, {"Richard Virerivagon", "Rick Virerivagon"}],
        [{"Eleanor B. Soxenov", "E. B. Soxenov"}, {"Eleanor C. Soxenov"}, {"Eleanor Soxenov"}],
        [{"Intl. Salt Assn. of Vopaps", "International Salt Association of Vopaps", "The International Salt Association of Vopaps"}, {"University of Vopaps", "Univ. Vopaps", "Uni of Vopaps", "Vopaps, University of"}],
        [{"Xalobo Institute of Botany", "Xalobo Botany Institute", "Institute of Botany, Xalobo", "XALOBO INSTITUTE OF BOTANY", "Xalobo Inst. of Botany", "Xlaobo Institute of Botany"}, {"Xalobo Laboratory of Botany"}],
        [{"Zuvo Brothers Salt Limited", "Zuvo Bros Salt Ltd.", "Zuvo Brothers Salt"}],
        [{"Saint Wonapa", "St. Wonapa", "Wonapa, Saint", "Saint-Wonapa"}, {"Port Wonapa", "Pt. Wonapa"}, {"Fort Wonapa"}, {"Wonapa"}],
        [{"Bay of Bosum", "Bosum Bay", "Bosum bay"}, {"Upper Lagizu", "Upr. Lagizu"}],
    ],
)
def test_spellings(spark, want):
    every = sorted(x for g in want for x in g)
    assert groups_of(linked(spark, every), every) == {frozenset(g) for g in want}


def test_common_misspellings(spark):
    """A spelling variant links however often it occurs; two names that merely look alike do not."""
    places = [a + b + "nor" for a in ("Bada", "Kuse", "Mipo", "Revu", "Zola") for b in ("fi", "gu", "to", "xe")]
    variants = [f"{g} {s}" for s in places[:8] for g in ("Ivonne", "Yvonne")] + [f"Yvonne {s}" for s in places[8:]]
    apart = [f"Andre {s}" for s in places[:10]] + [f"Andrew {s}" for s in places[9:]]
    found = linked(spark, variants + apart)
    assert found == {(f"Ivonne {s}", f"Yvonne {s}") for s in places[:8]}


def test_near():
    assert names.near("abcd", "abd") and names.near("abcd", "abxcd") and names.near("abcd", "abdc") and names.near("abcd", "axcd")
    assert not names.near("abcd", "ab") and not names.near("abcd", "badc")


def test_mixture(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, s, "word " * rng.randint(1, 60)) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["tiny"] * 20)] + [(9000, None, "x"), (9001, "big", None), (9002, "big", "")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.4, 2), ("m", "tiny", 0.1, 3), ("gap", "big", 0.5, 1), ("gap", "none", 0.5, 1), (None, "big", 1.0, 1)], "mixture_id string, source string, target_share double, max_repeats int")
    got = {(r.mixture_id, r.source): r for r in mixing.shares(docs, targets).collect()}
    assert all(abs(got["m", s].reached_share - x) < 0.02 for s, x in (("big", 0.5), ("mid", 0.4), ("tiny", 0.1))) and got["m", "tiny"].most_repeats == 3
    assert got["gap", "none"].reached_tokens == 0 and got["gap", "big"].reached_share == 1
    chosen, plan = mixing.select(docs, targets)
    for r in plan.collect():
        mine = [x for x in chosen.collect() if (x.mixture_id, x.source) == (r.mixture_id, r.source)]
        assert sum(x.tokens * x.times for x in mine) <= r.budget and all(x.times <= r.max_repeats for x in mine)


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    counted = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "id % 7 + 1 as tokens")
    rows = sorted(mixing.running_totals(counted).collect(), key=lambda r: (r.source, r.key, r.tokens))
    for s in "ab":
        at = 0
        for r in (x for x in rows if x.source == s):
            assert r.before == at
            at += r.tokens


def test_feistel():
    for left, right in ((1, 10), (10, 10), (100, 26), (7, 300)):
        seen = {privacy.feistel(KEY, "t", v, left, right) for v in range(left * right)}
        assert seen == set(range(left * right))
        assert all(privacy.unfeistel(KEY, "t", privacy.feistel(KEY, "t", v, left, right), left, right) == v for v in range(0, left * right, 7))


@pytest.mark.parametrize("kind, value", [("phone", "+44 20 7946 0508"), ("phone", "(417) 555-0125"), ("phone", "555-0179 ext. 83"), ("phone", "0017135550103"), ("id_number", "QQ 81 27 11 C"), ("id_number", "936-37-3184"), ("id_number", "12.345.678-5"), ("id_number", "X1234567L"), ("id_number", "8861886124-A")])
def test_pseudonyms(kind, value):
    out = privacy.pseudonym_number(KEY, value, kind)
    shape = lambda s: "".join("9" if c.isdigit() else "A" if c.isalpha() and kind == "id_number" else c for c in s)
    assert out != value and shape(out) == shape(value) and privacy.pseudonym_number(KEY, out, kind, inverse=True) == value
    if value.startswith("+44"):
        assert out.startswith("+44 ")
    if value == "X1234567L":
        assert privacy._nie_check(out) == out[-1]
    assert privacy.pseudonym_number(b"other", value, kind) != out


def test_dates():
    day = datetime.date(1990, 5, 17)
    out = privacy.pseudonym_date(KEY, day)
    assert out != day and privacy.pseudonym_date(KEY, out, inverse=True) == day and 1800 <= out.year <= 2099
    small = [datetime.date(2000, 1, 1) + datetime.timedelta(days=i) for i in range(31)]
    assert sorted(privacy.pseudonym_date(KEY, x, small[0], small[-1]) for x in small) == small


CASES = [
    ("Dr. Ingrid S. Basitojebask can be reached at mo.meme@mail.example.net.", ["Ingrid S. Basitojebask", "mo.meme@mail.example.net"]),
    ("Call +33 1 99 00 75 76 or (417) 555-0125 ext. 12 and ask for Basitojebask, Ingrid.", ["+33 1 99 00 75 76", "(417) 555-0125 ext. 12", "Basitojebask, Ingrid"]),
    ("Write to eva+ciste (at) archive dot example; the tag @ledger and 525:141, vol. 3.", ["eva+ciste (at) archive dot example"]),
    ("Questions go to Susan Zumakiwigurt, Flat 41, 395 Zapagunusox Road, or by phone.", ["Susan Zumakiwigurt", "Flat 41, 395 Zapagunusox Road"]),
    ("The shelf mark 872-719-761 and Inventory 403655581, version 56.34.831, stand apart.", []),
    ("Her identity number X1744619Z; Reader's card: 986-40-4111.", ["X1744619Z", "986-40-4111"]),
    ("University of Victoria and Saint Abigail Bay sold wool to Charles Brothers Limited.", []),
    ("Écrire à Chloé Zetesejuvon, 41 bis, avenue de Bamepohobur, 24035 Fapenagovux, tél. 030/23125418.", ["Chloé Zetesejuvon", "41 bis, avenue de Bamepohobur, 24035 Fapenagovux", "030/23125418"]),
    ("Телефон 020 7946 0647, адрес: ул. Ореховая, д. 44, кв. 813, контакт — Зоя Мававореов.", ["020 7946 0647", "ул. Ореховая, д. 44, кв. 813", "Зоя Мававореов"]),
    ("莘芮芮住在芦汀市青崖路205号，身份证号X5297366Z。", ["莘芮芮", "芦汀市青崖路205号", "X5297366Z"]),
    ("セグペ・冬馬の住所は葦浜市霞渡町32丁目336番地である。", ["セグペ・冬馬", "葦浜市霞渡町32丁目336番地"]),
    ("", []), ("x" * 50_000, []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_findings(text, want):
    assert [text[a:b] for a, b, _ in privacy.find(text)] == want


def test_every_alternative_passes_its_gate():
    """What the patterns accept is found in a text that holds nothing else."""
    addresses = [f"12 Old Bridge{space}{w}" for w in privacy._STREETS for space in (" ", "\u2009", "\r\n")]
    addresses += [f"41 bis, {w} de Bamepohobur" for w in privacy._RUES] + [f"{w} Mayor, 12" for w in privacy._CALLES] + ["CalleMayor 12", "PO Box 12"]
    addresses += [f"Alt{w} 12" for w in privacy._STRASSEN] + [f"{w}{stop} Садовый, д. 5" for w in privacy._ULITSY for stop in ("", ".")]
    accepted = [a for a in addresses if privacy._ADDRESS.search(a)]
    assert len(accepted) > 0.9 * len(addresses)
    for a in accepted:
        assert any(k == "address" for *_, k in privacy.find(a)), a
    for at in ("@", "＠", " (at) ", " [at] ", " { at } ", " <at> ", " ( at ) ", " < AT > "):
        assert [k for *_, k in privacy.find(f"Write to eva{at}archive.org")] == ["email"], at


def test_capitals_are_judged_where_the_address_is():
    """An address without capitals is found behind a head with them, and one before a tail with them."""
    proper, small = "The Old Weaver Sold It To Ada. " * 200, "the weaver sold it to them again. " * 200
    for text in (proper + small + "write to 12 old bridge street now. " + small, small + "write to 12 old bridge street now. " + small + proper * 3):
        assert [text[a:b] for a, b, k in privacy.find(text) if k == "address"] == ["12 old bridge street"]
    assert not [k for *_, k in privacy.find(small + proper + "12 old bridge street. " + proper) if k == "address"]


def test_redaction(spark):
    text = "Call Ada Lovelace at +44 20 7946 0508. Ada is 42."
    other = "Lovelace, Ada: +44 20 79460508"
    docs = spark.createDataFrame([(1, text), (2, other), (3, None), (4, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in privacy.redacted(docs, "k").collect()}
    assert got[3] is None and got[4] == "plain" and "7946" not in got[1] and got[1].endswith(". Ada is 42.") and got[1].startswith("Call ")
    assert privacy.redact(text, privacy._secret("k")) == got[1]


def test_precision_and_recall(spark, data):
    """Names that extraction gave, where they are people, are found with their exact span in the documents."""
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect() if r.text}
    hits = total = 0
    for r in table(spark, data, "extract_sentence").collect():
        for e in r.entities or []:
            p = names.parse(e) if e else None
            if p and not p["org"] and " " in p["base"] and e in docs.get(r.doc_id, "") and privacy.plain(e.split()[0]) in privacy._givens()[0]:
                total += 1
                hits += any(docs[r.doc_id][a:b] == e for a, b, k in privacy.find(docs[r.doc_id]) if k == "name")
    assert total > 20 and hits >= 0.95 * total


@pytest.mark.parametrize("many", [3, 40])
def test_initials_beside_strays(spark, many):
    """A form links to the entity that holds most of its mentions, however many others have it now and then."""
    full, stray = "Ottilie Brunhold", "Oswald Brunhold"
    rows = [([full], None)] * (20 * many) + [([stray], None)] * many + [(["O. Brunhold"], None)]
    rows += [(["Anna Lee"], None)] * many + [(["Arno Lee"], None)] * many + [(["A. Lee"], None)]
    df = spark.createDataFrame(rows, "entities array<string>, triples array<struct<head:string,relation:string,tail:string,confidence:double,extractor:string>>")
    assert {(r.name_a, r.name_b) for r in names.pairs(df).collect()} == {("O. Brunhold", full)}


@pytest.mark.parametrize(
    "want",
    [
        [{"ООО Рассвет", "Рассвет, ООО", "рассвет"}, {"Саша Зимин", "Александр Зимин", "Зимин Александр", "А. Зимин"}, {"Пётр Зимин", "Петя Зимин"}],
        [{"北京印刷有限公司", "北京印刷"}, {"有限会社山田", "山田"}, {"李明", "李明先生"}],
    ],
)
def test_other_scripts(spark, want):
    every = sorted(x for g in want for x in g)
    got = groups_of(linked(spark, every), every)
    assert got == {frozenset(g) for g in want}
