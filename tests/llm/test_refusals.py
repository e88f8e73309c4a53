"""Refusals: templates of any wording and length, found by their recurrence over unrelated questions."""

import random
from collections import defaultdict

import pyarrow as pa

from lodestrand.llm import pairs

SCHEMA = "example_id long, question string, gold_answer string, predicted_answer string"


def word(r):
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)).capitalize()


def judged(spark, rows):
    return {(r.example_id, r.field): r.defect for r in pairs.defects(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_wording_outside_any_list(spark):
    """One sentence under 48 unrelated questions is a refusal, whatever it says; true answers that recur are none."""
    r = random.Random(1)
    odd = "Der Zettel bleibt zu dieser Sache leider stumm und leer."
    assert not pairs._REFUSALS.search(odd)
    rows = [(i, f"Wer hat die Brücke von {word(r)} im Jahr {1600 + 7 * i} für die Stadt gebaut?", f"{word(r)} {word(r)}", odd) for i in range(48)]
    rows += [(100 + i, f"Of what is the bell of {word(r)} made?", "copper", "It is copper.") for i in range(30)]
    rows += [(200 + i, f"Did both {word(r)} and {word(r)} leave?", "no", "None of them") for i in range(30)]
    got = judged(spark, rows)
    assert {k for k, v in got.items() if v == "refusal"} == {(i, "predicted_answer") for i in range(48)}


def test_long_refusals(spark):
    """Length excuses nothing, for wording that is known and for templates."""
    r = random.Random(2)
    tail = " The passages speak of other towns and of other years, and whatever they tell of bridges, mills and looms belongs to places far from the one that is meant here." * 2
    rows = [(i, f"Who built the mill of {word(r)}?", word(r), f"I am sorry, but I cannot answer this question.{tail}") for i in range(16)]
    odd = f"The folder has a gap at this spot.{tail}"
    rows += [(100 + i, f"Who wove the flag of {word(r)}?", word(r), odd) for i in range(16)]
    story = "She left the harbour in the evening and walked home along the river, past the mill and the church. " * 6 + "The guard did not say who had come."
    rows += [(200, "Why did she leave?", "It rained.", story)]
    got = judged(spark, rows)
    assert all(got.get((i, "predicted_answer")) == "refusal" for i in (*range(16), *range(100, 116))) and (200, "predicted_answer") not in got


def test_pair_recall(spark):
    """Of all pairs of openings at ``ALIKE`` or above, brute force, at least 0.9 end in one component."""
    r = random.Random(3)
    words = [word(r).lower() for _ in range(30)]
    base = [" ".join(r.choices(words, k=5)) for _ in range(40)]
    openings = sorted({(b[:k] + r.choice("abcdef") + b[k + 1 :])[: pairs.OPENING] for b in base for k in r.sample(range(28), 8)})
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for t in openings]
    alike = [(a, b) for a in range(len(openings)) for b in range(a) if len(grams[a] & grams[b]) >= pairs.ALIKE * len(grams[a] | grams[b])]
    edges = pairs.alike_openings(spark.createDataFrame([(t,) for t in openings], "opening string"))
    label = {x.node: x.component for x in pairs.connected_components(edges).collect()}
    assert sum(openings[a] in label and label[openings[a]] == label.get(openings[b]) for a, b in alike) >= 0.9 * len(alike) > 300


def test_hot_bucket(spark):
    """A bucket of many openings: all that are alike end together, however many leaders that takes."""
    openings = [f"the {chr(97 + i % 26) * 3}{i} shared stretch of words" for i in range(300)]
    edges = pairs.alike_openings(spark.createDataFrame([(t,) for t in openings], "opening string"))
    assert len({x.component for x in pairs.connected_components(edges).collect()}) == 1


def test_followers_of_different_leaders(spark):
    """All alike openings of a large bucket end in one component, brute force, also where each follows a leader of its own."""
    r = random.Random(8)
    names = [word(r).lower() for _ in range(40)]
    openings = sorted({f"{lead} bought the {r.choice(names)[:k]} {r.choice(names)}"[: pairs.OPENING] for lead in ("n", "n of n", "n or n") for k in (4, 6, 8) for _ in range(150)})
    grams = {t: {t[i : i + 4] for i in range(len(t) - 3)} for t in openings}
    buckets = defaultdict(list)
    for batch in pairs._opening_bands([pa.record_batch([pa.array(openings)], names=["opening"])]):
        for bucket, t in zip(*(c.to_pylist() for c in batch.columns)):
            buckets[bucket].append(t)
    alike = {(a, b) for group in buckets.values() for a in group for b in group if a < b and len(grams[a] & grams[b]) >= pairs.ALIKE * len(grams[a] | grams[b])}
    edges = pairs.alike_openings(spark.createDataFrame([(t,) for t in openings], "opening string"))
    label = {x.node: x.component for x in pairs.connected_components(edges).collect()}
    assert max(map(len, buckets.values())) > 100 and len(alike) > 2000
    assert not [(a, b) for a, b in alike if a not in label or label[a] != label.get(b)]


def test_apart(spark):
    """Every two openings of a bucket in different components meet once, however many blocks that takes."""
    rows = [(1, f"a{i}", "a") for i in range(pairs.BLOCK + 40)] + [(1, f"b{i}", "b") for i in range(30)] + [(1, f"c{i}", "c") for i in range(20)] + [(2, f"d{i}", "d") for i in range(50)]
    got = [(x.a, x.b) for x in pairs.apart(spark.createDataFrame(rows, "bucket long, opening string, component string")).collect()]
    want = {(a, b) for _, a, c in rows for _, b, d in rows if a < b and c != d and "d" not in (c, d)}
    assert len(got) == len(want) and set(got) == want


def test_language_of_quotes_in_long_answers():
    assert not pairs.is_other_language("Who said it to the people of the town?", "He said to them: „" + "das ist nicht der Weg und die Stadt war für uns. " * 60 + "“ and it was in the town")
