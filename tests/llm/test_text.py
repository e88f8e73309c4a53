"""Sentences, pieces, leaks."""

import random

import numpy as np
import pytest

from lodestrand.llm import leakage, pieces, sentences
from lodestrand.llm.chars import bare
from lodestrand.sources.tables import table

W = sentences.fit([])


def units(text, model=None, weights=W):
    _, a, b = sentences.units([text], weights, model)
    return [text[x:y] for x, y in zip(a, b)]


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Ada B. Lee paid 3.60 crowns, i.e. less.", "She left at 10 p.m.", "Then it rained.", "Perhaps... nobody knows."],
        ['"We stay. The bridge stays," Ada said.', 'He asked, "Who came?" and left.', "(See vol. 2, p. 3.)", "What a day?!", "It ended."],
        ["Am 12. November 1777 wurde Ada geboren.", "Es kostete 2,5 Mio. Kronen, d. h. viel.", "„Wir gehen. Sie bleibt“, sagte er."],
        ["В 1653 г. тихая карта была продана.", "Цена выросла, т. е. до 5 руб. за день!", "«Мы тут. Это дом», — сказал он."],
        ["“我们走。你留下，”他说。", "第3号桥长2.71米；很宽。", "真的吗？"],
        ["「ここを残そう。古い橋だ」と彼は言った。", "雨が降った！"],
        ["डॉ. नभ ने लिखा।", "भार 2.5 कि.ग्रा. था।", "क्या सच में?"],
        ["قال وسام: «نبقى. هذا بيت».", "كتب د. وسام كتابا.", "هل باع أحد؟"],
    ],
)
def test_units(want):
    gap = "" if any("一" <= c <= "龥" or "ぁ" <= c <= "ヿ" for c in want[0]) else " "
    assert units(gap.join(want)) == want


def test_lines():
    text = "A heading\n\nOne sentence goes\nover two lines. Next one.\n\n- first item. still\n• second 2\n\nName: Ada B.\nTown: Bath. Old\n\n  End.No space.　"
    assert units(text) == ["A heading", "One sentence goes\nover two lines.", "Next one.", "- first item. still", "• second 2", "Name: Ada B.", "Town: Bath. Old", "End.", "No space."]
    assert units("") == units(" \n\t\n ") == []
    assert units("no mark at all") == ["no mark at all"] and len(units("x" * 100_000)) == 1
    assert units('An "open quote. Next one. And more.') == ['An "open quote.', "Next one.", "And more."]


def test_units_cover(spark, data):
    texts = [r.text for r in table(spark, data, "documents").collect() if r.text]
    owner, a, b = sentences.units(texts, W)
    for i, t in enumerate(texts):
        at = 0
        for x, y in zip(a[owner == i], b[owner == i]):
            assert t[at:x].strip() == "" and t[x:y] == t[x:y].strip() and y > x
            at = y
        assert t[at:].strip() == ""


def test_held_out_sentences(spark, data):
    docs, known = table(spark, data, "documents"), table(spark, data, "extract_sentence")
    pairs = [(r.d, r.s) for r in known.join(docs, "doc_id").select(docs.text.alias("d"), known.text.alias("s")).collect() if r.d and r.s and r.s in r.d]
    pairs.sort()
    weights = sentences.fit(pairs[::2])
    held = pairs[1::2]
    assert sum(s in units(d, None, weights) for d, s in held) >= 0.95 * len(held) > 20


def test_unpunctuated_run_before_a_mark():
    """One mark at the end of a block, or after its first sentence, does not keep the run beside it whole."""
    parts = ["桥在河上" + "很宽" * 4 + "了", "人在城里" + "很忙" * 4 + "了", "船在海上" + "很慢" * 4 + "了"]
    model = sentences.strip_counts(["。".join(parts) + "。"] * 30)
    run = "".join(parts) * 6
    cut = lambda t: [(int(a), int(b)) for _, a, b in zip(*sentences.units([t], sentences.prior(), model))]
    plain = cut(run)
    assert len(plain) == 18
    assert cut(run + "。") == [*plain[:-1], (plain[-1][0], len(run) + 1)]
    first = parts[0] + "。"
    assert cut(first + run) == [(0, len(first)), *((a + len(first), b + len(first)) for a, b in plain)]


@pytest.mark.parametrize("many", [2, 3, 14])
@pytest.mark.parametrize("lang", ["zh", "ja", "hi"])
def test_unpunctuated(spark, lang, many):
    """Texts whose marks are taken out, of two sentences or of many: nine boundaries in ten are found again (Hindi: eight)."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.1", "documents").filter(f"lang = '{lang}' and text is not null").orderBy("doc_id").limit(300).collect()]
    texts = [t for t in texts if sum(sentences.class_table()[ord(c)] == sentences.UNCASED for c in t) * 2 > len(t)]  # some are in another language than they say
    model = sentences.strip_counts(texts[: len(texts) // 2])
    marks = (sentences.STOP, sentences.EXCLAIM, sentences.DOT)
    good = total = found = 0
    for t in texts[len(texts) // 2 :]:
        parts = ["".join(c for c in s if sentences.class_table()[ord(c)] not in marks).strip() for s in units(t.replace("\n", " "))]
        parts = [p for p in parts if len(p) > 1][:many]
        if len(parts) == many:
            gap = " " if lang == "hi" else ""
            real = set(np.cumsum([len(p) + len(gap) for p in parts])[:-1].tolist())
            _, a, _ = sentences.units([gap.join(parts)], W, model)
            got = set(a[1:].tolist())
            good, total, found = good + len(real & got), total + len(real), found + len(got)
    assert total >= 10 and good >= (0.9 if lang != "hi" else 0.8) * total and good >= (0.9 if lang != "hi" else 0.5) * found


def test_one_mark_and_a_long_run():
    """A run without marks is cut whatever its length, and whatever mark stands elsewhere; a punctuated text is left alone."""
    rng = random.Random(5)
    clause = lambda: "".join(rng.choice("山水田石木火土金") for _ in range(rng.randint(8, 14))) + rng.choice("了的呢")
    model = sentences.strip_counts(["。".join(clause() for _ in range(30)) + "。" for _ in range(40)])
    parts = [clause() for _ in range(40)]
    for n in (10, 20, 40):
        run = "".join(parts[:n])
        assert len(units(run, model)) >= 0.8 * n and len(units(run + "。", model)) >= 0.8 * n and len(units("".join(parts[: n // 2]) + "。" + "".join(parts[n // 2 : n]), model)) >= 0.8 * n
    assert units("。".join(parts) + "。", model) == [p + "。" for p in parts]
    assert len(units("字" * 400, None)) == 1


def test_models_count_all_rows(spark):
    """Both models are those of all labelled sentences and of all texts in scripts without case, however many."""
    rng = random.Random(7)
    clause = lambda: "".join(rng.choice("山水田石木火土金") for _ in range(rng.randint(3, 9))) + rng.choice("了的呢")
    uncased = ["。".join(clause() for _ in range(rng.randint(2, 5))) + "。" for _ in range(2500)]
    spaced = [[f"{rng.choice(('Ada', 'He', 'Dr. Lee'))} came {rng.choice(('to no. 3', 'at 10 p.m', 'in 1912', 'late', '...'))}." for _ in range(3)] for _ in range(2000)]
    texts = uncased + [" ".join(x) for x in spaced]
    labels = [(len(uncased) + i, x) for i, own in enumerate(spaced) for x in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(str(i), d, x) for i, (d, x) in enumerate(labels)], "sentence_id string, doc_id long, text string")
    (emissions, moves), stripped = sentences.train(docs, known)
    whole = sentences.fit([(texts[d], x) for d, x in labels])
    assert np.allclose(emissions, whole[0]) and np.allclose(moves, whole[1])
    want = sentences.strip_counts(uncased)
    assert stripped.keys() == want.keys() and all(np.allclose(stripped[k], v) for k, v in want.items())


def test_viterbi():
    score, p = np.array([5.0, 4.5, -1.0, 2.0]), np.array([10, 12, 30, 33])
    assert sentences.decode(score, p).tolist() == [True, True, False, True]
    assert sentences.decode(np.array([3.0, 2.0]), np.array([10, 12])).tolist() == [True, False]


def check_pieces(text, rows):
    assert rows[0][0] == 0 and rows[-1][1] == len(text) and all(0 < b - a <= 4000 for a, b in rows)
    for (_, e), (s, _) in zip(rows, rows[1:]):
        assert 0 <= e - s <= 200 and (e - s >= 100)


def test_pieces(spark):
    rng = random.Random(2)
    long = lambda n, size: " ".join("W" + "o" * rng.randint(1, size) + "rd." if rng.random() < 0.1 else "w" * rng.randint(1, size) for _ in range(n))
    texts = {1: long(1500, 8), 2: long(40_000, 9), 3: "x" * 9000, 4: "short.", 5: "word " * 1700, 6: "。".join("字" * 50 for _ in range(300)), 7: "A" + "b" * 3998 + ". " + "C" + "d" * 3998 + ".", 8: None, 9: "y" * 4000}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(1, texts[1])], "doc_id long, text string")
    got = {}
    for r in pieces.pieces(docs, (W, None)).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert set(got) == {1, 2, 3, 5, 6, 7}
    for k, rows in got.items():
        check_pieces(texts[k], rows)
    assert {r.doc_id: r.cut for r in pieces.cuts(docs, (W, None)).collect()} == {k: "forced" if max(map(len, units(texts[k]))) > 4000 else "boundary" for k in got} and {3, 5} <= {k for k in got if max(map(len, units(texts[k]))) > 4000} and max(map(len, units(texts[7]))) == 4000


def brute_leaks(docs, samples):
    out = set()
    for sid, q, texts in samples:
        n = 24 if any("一" <= c <= "鿿" for c in q) else 75
        windows = {b[i : i + n] for t in (q, *texts) for b in (bare(t),) for i in range(len(b) - n + 1)}
        out |= {(i, sid) for i, t in docs for b in (bare(t),) if any(b[j : j + n] in windows for j in range(len(b) - n + 1))}
    return out


def test_leaks(spark):
    rng = random.Random(3)
    names = ["Zitokitopund", "Makobanenar", "Chloé", "Kolerurojas", "International", "Association"]
    sentence = lambda: f"How many barrels of hemp did {rng.choice(names)} {rng.choice(names)} send to {rng.choice(names)} for {rng.randint(1, 9999)} metres in {rng.randint(1500, 2000)}?"
    samples = [(f"s{i}", sentence(), [sentence() + " " + sentence()], "test") for i in range(30)] + [("zh", "白隼岭的木制的账本在1995年由谁修复，而且为什么写了165页关于泥炭的笔记？", ["竹埠的石桥真的是1834年出售的吗？"], "dev"), ("train", sentence(), [], "train")]
    docs = []
    for i in range(200):
        s = rng.choice(samples)
        t = rng.choice([s[1], *s[2]])
        a = rng.randrange(len(t))
        docs.append((i, "Lead in. " + t[a : a + rng.randint(20, 200)].upper().replace(" ", rng.choice([" ", "", "\n"])) + " and out " + sentence()[:40]))
    docs.append((999, samples[0][1].replace("hemp", "hemp").replace("barrels", "barrels")))
    d = spark.createDataFrame(docs + [(1000, None), (1001, "")], "doc_id long, text string")
    s = spark.createDataFrame([(a, b, [("0", "t", x, True) for x in c], e) for a, b, c, e in samples] + [("null", None, None, "test")], "sample_id string, question string, documents array<struct<idx:string,title:string,text:string,is_supporting:boolean>>, split string")
    got = {tuple(r) for r in leakage.found(d, s).collect()}
    assert got == brute_leaks(docs, [x[:3] for x in samples if x[3] != "train"]) and len(got) > 40


def test_reparameterised(spark):
    q = "How many barrels of hemp did Zitokitopund send to Makobanenar for the northern dockyard in 1808?"
    other = "How many barrels of hemp did Makobanenar send to Zitokitopund for the northern dockyard in 1911?"
    d = spark.createDataFrame([(1, "x " + other), (2, "x " + q), (3, other.replace("northern", "southern"))], "doc_id long, text string")
    s = spark.createDataFrame([("s", q, None, "test")], "sample_id string, question string, documents array<struct<idx:string,title:string,text:string,is_supporting:boolean>>, split string")
    assert {(r.doc_id, r.exact) for r in leakage.leaks(d, s).collect()} == {(1, False), (2, True)}


SAMPLE = "sample_id string, question string, documents array<struct<idx:string,title:string,text:string,is_supporting:boolean>>, split string"


@pytest.mark.parametrize(
    "question, again, other",
    [
        ("In which year did Anna leave the mill for the northern dockyard with 40 barrels?", "In which year did Greta leave the mill for the northern dockyard with 12 barrels?", "In which year did Greta leave the mill for the southern dockyard with 12 barrels?"),
        ("Who sold the bell of Zitok to Anna Lee before Anna Lee left?", "Who sold the bell of Mabo to Tom Ash before Tom Ash left?", "Who sold the bell of Mabo to Tom Ash before Eve Ash left?"),
        ("Which weaver walked 5 miles to the fair of the town?", "Which weaver walked 12 furlongs to the fair of the town?", "Which weaver walked to the fair of the town?"),
        ("Who broke the old loom in the attic?", "Who broke the old loom in the attic?", "Who broke the new loom in the attic?"),
        ("石桥在1834年由谁出售给村里的人？", "石桥在1901年由谁出售给村里的人？", "木桥在1901年由谁出售给村里的人？"),
    ],
)
def test_questions_with_other_values(spark, question, again, other):
    """Values that no held-out text has are slots too, a short question word for word is found, other words are not."""
    d = spark.createDataFrame([(1, f"He asked me. {again} Nobody knew."), (2, f"He asked me. {other} Nobody knew.")], "doc_id long, text string")
    s = spark.createDataFrame([("s", question, None, "test")], SAMPLE)
    assert leakage.found(d, s).count() == 0
    assert {tuple(r) for r in leakage.leaks(d, s).collect()} == {(1, "s", False)}


def test_passages_with_other_numbers(spark):
    passage = "The dockyard that was founded in 1808 and sold by 1911 was kept by the weavers until 1911 came in."
    again = passage.replace("1808", "1709").replace("1911", "1856")
    mixed = passage.replace("1808", "1709").replace("by 1911", "by 1856")
    d = spark.createDataFrame([(1, again), (2, passage.upper()), (3, mixed), (4, "The dockyard of the town.")], "doc_id long, text string")
    s = spark.createDataFrame([(x, "What?", [("0", "t", passage, True)], "dev") for x in ("a", "b")], SAMPLE)
    assert {tuple(r) for r in leakage.leaks(d, s).collect()} == {(1, "a", False), (1, "b", False), (2, "a", True), (2, "b", True)}


def test_full_bit_table(spark, data, monkeypatch):
    """A table of bits that passes everything changes nothing but the rows that meet."""
    docs, samples = table(spark, data, "documents"), table(spark, data, "samples")
    whole = {tuple(r) for r in leakage.leaks(docs, samples).collect()}
    monkeypatch.setattr(leakage, "bit_table", lambda h: np.full(1 << leakage.BITS - 3, 255, np.uint8))
    assert {tuple(r) for r in leakage.leaks(docs, samples).collect()} == whole
