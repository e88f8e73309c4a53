"""Exact and near duplicates against brute force and known similarities."""

import itertools
import random

import numpy as np
import pytest

from lodestrand.llm import exact_dups, near_dups
from lodestrand.llm.chars import bare
from lodestrand.sources.tables import table

SCHEMA = "doc_id long, title string, text string"


def test_copies(spark):
    rows = [
        (5, "A Title", "Some text, here."), (3, "a title", "some  TEXT here"), (9, None, "Some text here"), (4, "", "SOME TEXT\nHERE!"),
        (6, "t", "Name: Ada\nTown: Bath"), (2, "T", "Town: Bath\nName: Ada"), (8, "t", "Name Ada Town Bath"), (10, "t", None), (11, "t", "..."), (12, "t", "?!"), (13, "u", "only one"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in exact_dups.copies(docs).collect()} == {(3, 5), (4, 9), (2, 6), (2, 8)}
    assert {r.keep: r.copies for r in exact_dups.groups(docs).collect()} == {3: 2, 4: 2, 2: 3, 13: 1}


def test_prose_is_not_sorted(spark):
    docs = spark.createDataFrame([(1, "", "First line\nSecond line"), (2, "", "Second line\nFirst line")], SCHEMA)
    assert exact_dups.copies(docs).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'T' as title", "case when id % 3 = 0 then 'the same  text' else concat('text ', id) end as text")
    assert exact_dups.copies(docs).count() == 999


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 5)):
        i = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out.insert(i, rng.choice(words))
            case 1:
                del out[i]
            case 2:
                out[i] = out[i][::-1]
    return " ".join(out)


def brute(rows, at=0.6):
    sets = {i: {b[j : j + 8] for j in range(len(b) - 7)} for i, _, t in rows if t for b in (bare(t),)}
    return {(min(a, b), max(a, b)): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= at * len(sets[a] | sets[b])}


def test_pairs(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 9))) for _ in range(400)]
    rows = []
    for k in range(40):
        words = rng.choices(vocabulary, k=60)
        for v in range(4):
            rows.append((k * 10 + v, f"title {v}", edited(rng, words)))
    rows += [(900, "x", "abcabcabc" * 400), (901, "y", "abcabcabc" * 390), (902, "x", "short"), (903, "x", "short"), (904, None, None), (905, "", ""), (906, "z", rows[0][2].upper())]
    docs = spark.createDataFrame(rows, SCHEMA)
    same = {tuple(sorted(r)) for r in exact_dups.copies(docs).collect()}
    got = [tuple(r) for r in near_dups.pairs(docs).collect()]
    want = set(brute(rows)) - same
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want) and (900, 901) in got and (0, 906) in got
    groups = {r.doc_id: (r.group_id, r.links) for r in near_dups.groups(docs).collect()}
    assert all(groups[a][0] == groups[b][0] for a, b in got) and groups[902 if 902 in groups else 900]


def test_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    for a_weights, b_weights in ((np.ones(300), np.ones(300)), (rng.uniform(0.2, 5, 300), rng.uniform(0.2, 5, 300))):
        a, b = np.arange(300), np.arange(100, 400)
        wa, wb = np.zeros(400), np.zeros(400)
        wa[a], wb[b] = a_weights, b_weights
        real = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        sig = near_dups.signatures(np.concatenate([h[a], h[b]]), np.repeat([0, 1], 300), 2, 2048, np.concatenate([wa[a], wb[b]]))
        assert (sig[0] == sig[1]).mean() == pytest.approx(real, abs=0.04)


def test_weights_of_one_change_nothing():
    h = np.arange(1, 200, dtype=np.uint64)
    owner = np.zeros(len(h), np.int64)
    assert (near_dups.signatures(h, owner, 1, 64) == near_dups.signatures(np.concatenate([h, h]), np.zeros(2 * len(h), np.int64), 1, 64)).mean() > 0.9


def test_tables(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r.doc_id, r.title, r.text) for r in docs.collect()]
    same = {tuple(sorted(r)) for r in exact_dups.copies(docs).collect()}
    keep = {r.copy_doc_id: r.keep_doc_id for r in exact_dups.copies(docs).collect()}
    want = {p for p in brute(rows) if keep.get(p[0], p[0]) != keep.get(p[1], p[1])} - same
    assert {tuple(r) for r in near_dups.pairs(docs).collect()} == want


@pytest.mark.parametrize("common, own", [(4, 1), (8, 2), (15, 4), (79, 21), (240, 60)])
def test_recall_of_short_texts(common, own):
    """Pairs at a similarity of 0.65 or so share a band almost always, down to five stretches a text."""
    rng = np.random.default_rng(common)
    n = 400
    sets = rng.integers(0, 2**63, (n, common + 2 * own), dtype=np.uint64)
    share = common / (common + 2 * own)
    elements = np.concatenate([sets[:, : common + own].reshape(-1), np.concatenate([sets[:, :common], sets[:, common + own :]], 1).reshape(-1)])
    owner = np.repeat(np.arange(2 * n), common + own)
    sig = near_dups.signatures(elements, owner, 2 * n, near_dups.BAND * near_dups.BANDS)
    same = (sig[:n] == sig[n:]).reshape(n, -1)
    assert abs(same.mean() - share) < 0.05
    bands = same.reshape(n, near_dups.BANDS, near_dups.BAND).all(axis=2)
    assert bands.any(axis=1).mean() >= 0.99


def test_large_buckets(spark):
    """A bucket of many blocks gives every pair of its codes once."""
    rows = [("the quick brown fox jumps over the lazy dog and sleeps under the old oak tree until the morning light " * 3 + f"x{i}", i) for i in range(700)]
    docs = spark.createDataFrame([(i, None, t) for t, i in rows], "doc_id long, title string, text string")
    got = near_dups.candidate_pairs(docs)
    assert got.count() == got.distinct().count() == 700 * 699 // 2
