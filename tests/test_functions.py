"""Worked examples of the text and score functions."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import reader as R
from lodestrand.functions import scores as S
from lodestrand.functions import text as X
from lodestrand.plans.pipeline import heuristic_parts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_node_ids(spark):
    assert value(spark, X.node_id("chunk", F.lit("doc_1"), F.lit(0))) == "chunk:doc_1_0"
    assert value(spark, X.node_id("chunk", F.lit("Été à Paris"), F.lit("0"))) == "chunk:t_paris_0"
    assert value(spark, X.node_id("entity", F.lit("北京"))) == "entity:node"
    assert len(value(spark, X.node_id("chunk", F.lit("x" * 300)))) == len("chunk:") + 120


@pytest.mark.parametrize("n, size, over, spans", [(10, 4, 1, [(0, 4), (3, 7), (6, 10)]), (11, 4, 1, [(0, 4), (3, 7), (6, 10), (9, 11)]), (600, 256, 64, [(0, 256), (192, 448), (384, 600)]), (3, 4, 1, [(0, 3)]), (0, 4, 1, [])])
def test_windows(spark, n, size, over, spans):
    got = value(spark, X.windows(F.lit(" ".join(map(str, range(n)))), size, over))
    assert got == [" ".join(map(str, range(a, b))) for a, b in spans]


def test_sentences(spark):
    text = 'Ada Byron lived in London. She met Bob Lee in Paris. "Why?" asked Carl Sagan! then he left. 3 days passed.'
    assert value(spark, X.sentences(F.lit(text))) == ["Ada Byron lived in London.", "She met Bob Lee in Paris.", '"Why?" asked Carl Sagan! then he left.', "3 days passed."]


def test_entities(spark):
    assert value(spark, X.regex_entities(F.lit("The Ada Byron of London met him in Paris, He said 3D."))) == ["Ada Byron", "London", "Paris"]
    assert value(spark, X.clean_entity(F.lit("which the Old Bridge of"))) == "Old Bridge"
    assert value(spark, X.clean_entity(F.lit(None).cast("string"))) == ""
    assert value(spark, X.entity_key(F.lit("The Bank of a River"))) == "bank of river"
    assert [value(spark, X.is_named(F.lit(x))) for x in ("3D", "war", "United States", "u s", "old Bridge", "")] == [True, False, False, False, True, False]


def test_triples(spark):
    got = value(spark, X.regex_triples(F.array(*map(F.lit, "ABCDE"))))
    assert [(t.head, t.tail) for t in got] == [("A", "B"), ("B", "C"), ("C", "D")]
    assert value(spark, X.regex_triples(F.array(F.lit("A")))) == []


def test_answers(spark):
    assert value(spark, X.token_f1(F.lit("a b b c"), F.lit("b c"))) == pytest.approx(0.8)
    assert value(spark, X.token_f1(F.lit("The"), F.lit(""))) == 1.0
    assert value(spark, X.normal_answer(F.lit("The  Old, Bridge!"))) == "old bridge"
    assert value(spark, X.parsed_answer(F.lit('Thought: x\nAnswer: "Ada".\nmore'))) in ("Ada", 'Ada"')
    assert value(spark, X.parsed_answer(F.lit("one\ntwo."))) == "two"


def test_excerpt(spark):
    text = "Nothing here at all. The old bridge was sold. It rained. The bridge fell down again today."
    got = value(spark, X.excerpt(F.lit(text), F.lit("When was the old bridge sold?"), F.lit(8)))
    assert got.startswith("The old bridge was sold.") and len(got.split()) <= 8
    assert value(spark, X.excerpt(F.lit("short text"), F.lit("q"), F.lit(8))) == "short text"


@pytest.mark.parametrize("shares, units", [((0.6, 0.3, 0.1), (12, 6, 2)), ((0.4, 0.4, 0.2), (8, 8, 4)), ((0.1, 0.2, 0.7), (4, 6, 10)), ((1 / 3, 1 / 3, 1 / 3), (7, 7, 6))])
def test_quota(shares, units):
    assert S.quota(shares, 20, (12, 20, 10)) == units


def test_profiles(spark):
    conf = lambda *a: value(spark, S.entropy_confidence(S.alpha(*map(F.lit, a))))
    assert [round(conf(*a), 6) for a in ((0.6, 0.3, 0.1), (0.4, 0.4, 0.2), (0.1, 0.2, 0.7))] == [0.182655, 0.03977, 0.270153]
    assert conf(1.0, 1.0, 1.0) == pytest.approx(0)
    limit = lambda c: value(spark, S.passage_limit(S.alpha(F.lit(1 - c), F.lit(0.0), F.lit(c)), F.lit(0.5)))
    assert [limit(c) for c in (0.1, 0.2, 0.7)] == [108, 123, 198]
    assert value(spark, S.alpha(F.lit(0.2), F.lit(0.0), F.lit(0.6), F.lit(0.2))).fact == pytest.approx(0.4)
    got = value(spark, S.parsed_alpha(F.lit('x {"alpha_F": 2, "alpha_S": 1, "alpha_C": 1} y')))
    assert got.alpha.fact == 0.5 and not got.failed
    assert value(spark, S.parsed_alpha(F.lit("0.2 0.2 0.6"))).alpha.chunk == pytest.approx(0.6)
    assert value(spark, S.parsed_alpha(F.lit("no"))).failed


def test_l1(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 0.0), (1, "c", -1.0), (1, "d", 1.0), (2, "e", None)], "q int, id string, score double")
    assert {r.id: r.score for r in S.l1_normalised(rows, ["q"]).collect()} == {"a": 0.75, "d": 0.25}


def test_reader(spark):
    of = lambda q: value(spark, R.choices(F.lit(q)))
    assert of("Which is older, Fort Ab or Lake Cd?") == ["Fort Ab", "Lake Cd"]
    assert of("Did Ada study music?") == ["yes", "no"] and of("Who sold it?") == []
    two = F.array(F.lit("Fort Ab"), F.lit("Lake Cd"))
    assert value(spark, R.settled(F.lit('"It is Lake Cd."'), two)) == "Lake Cd"
    assert value(spark, R.settled(F.lit("Yes, both."), F.array(F.lit("yes"), F.lit("no")))) == "yes"
    assert value(spark, R.settled(F.lit("Ada because she said so."), F.array().cast("array<string>"))) == "Ada"
    assert "Choices: Fort Ab | Lake Cd" in value(spark, R.prompt(F.lit("q?"), F.lit("p"), two))
    assert value(spark, R.reader(lambda p: [x.upper() for x in p])(F.lit("a"))) == "A"
    assert value(spark, X.formatted_passage(F.lit(1), F.lit("T"), F.lit("body"))) == "Passage 1 [T]:\nbody"


def test_decompose(spark):
    assert value(spark, heuristic_parts(F.lit("Who built the old bridge and then sold it to Ada?"))) == ["Who built the old bridge?", "sold it to Ada?"]
    assert value(spark, heuristic_parts(F.lit("Name it?"))) == ["Name it?"]
