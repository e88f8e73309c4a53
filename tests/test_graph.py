"""Invariants of the graph, retrieval and packing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.config import Config
from lodestrand.operators import evidence, graph, retrieval
from lodestrand.operators.components import connected_components
from lodestrand.sources.tables import table


def test_merges(spark):
    parts = spark.createDataFrame([("q", 0, "x", 0.9), ("q", 1, "x", 0.4), ("q", 0, "y", 0.4)], "query_id string, part int, id string, score double")
    assert {r.id: r.score for r in retrieval.entity_channel(parts).collect()} == {"x": 0.5, "y": 0.5}
    assert {r.id: round(r.score, 6) for r in retrieval.max_channel(parts).collect()} == {"x": round(0.9 / 1.3, 6), "y": round(0.4 / 1.3, 6)}


def test_similarity(spark):
    a = np.array([1.0, 0.0]), np.array([0.9, np.sqrt(1 - 0.81)]), np.array([0.0, -1.0])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "id long, vec array<float>")
    hits = graph.similarity_edges(v, 0.8)
    assert {(r.src, r.dst): round(r.weight, 4) for r in graph.similarity_weights(hits).collect()} == {(0, 1): 1.8, (1, 0): 1.8}


def test_build_links_similar_entities(spark):
    docs = spark.createDataFrame([(1, "c", 0, "T", "Ada Mary Byron sold it."), (2, "c", 1, "U", "Mary Ada Byron came."), (3, "d", 0, "V", "Byron Mary Ada left.")], "doc_id long, corpus_id string, document_index int, title string, text string")

    def kinds(config, encode):
        edges = graph.build(docs, config, encode)["edges"].filter("array_contains(edge_kinds, 'entity_similarity')")
        return {(r.corpus_id, r.src, r.dst): round(r.weight, 4) for r in edges.collect()}

    encode = retrieval.hashed_encoder()
    assert kinds(Config(), encode) == {("c", "entity:ada_mary_byron", "entity:mary_ada_byron"): 2.0, ("c", "entity:mary_ada_byron", "entity:ada_mary_byron"): 2.0}
    assert kinds(Config(enable_entity_similarity_edges=False), encode) == kinds(Config(), None) == {}


def _toy(spark):
    q = spark.createDataFrame([(1, "c", (0.4, 0.4, 0.2))], "query_id long, corpus_id string, alpha struct<fact:double,sentence:double,chunk:double>")
    nodes = spark.createDataFrame([("c", n, n.split(":")[0]) for n in ("entity:a", "entity:b", "sentence:s", "chunk:k", "chunk:alone")], "corpus_id string, node_id string, node_type string")
    edges = spark.createDataFrame([("c", "entity:a", "sentence:s", 1.0, ["entity_sentence"]), ("c", "sentence:s", "chunk:k", 2.0, ["sentence_chunk"]), ("c", "entity:a", "entity:b", 1.0, ["entity_relation"]), ("c", "entity:b", "entity:b", 1.0, ["entity_relation"])], "corpus_id string, src string, dst string, weight double, edge_kinds array<string>")
    seeds = spark.createDataFrame([(1, "entity:a", 1.0)], "query_id long, node_id string, score double")
    return q, nodes, edges, seeds


def test_degree_counts_loops_twice(spark):
    _, _, edges, _ = _toy(spark)
    assert {r.node_id: r.degree for r in graph.degrees(edges).collect()}["entity:b"] == 3


def moves_of(nodes, edges, shares, config=Config()):
    """The transition matrix by the definition, node by node."""
    names = sorted(nodes)
    degree = {n: sum((e[0] == n) + (e[1] == n) for e in edges) for n in names}
    share = dict(zip(("entity", "sentence", "chunk"), shares))
    w = np.zeros((len(names), len(names)))
    for src, dst, weight, kinds in edges:
        x = weight * max(config.edge_type_weights.get(k, 1.0) for k in kinds) / (1 + config.hub_penalty * np.log(1 + degree[dst])) * (1 + config.transition_lambda * share[dst.split(":")[0]])
        i, j = names.index(src), names.index(dst)
        w[i, j], w[j, i] = max(w[i, j], x), max(w[j, i], x)
    total = w.sum(axis=1, keepdims=True)
    return names, np.divide(w, total, out=np.zeros_like(w), where=total > 0)


@pytest.mark.parametrize("seeded", [True, False])
def test_pagerank(spark, seeded):
    q, nodes, edges, seeds = _toy(spark)
    seeds = seeds if seeded else seeds.limit(0)
    got = graph.pagerank(graph.walk(edges, nodes), q, seeds).collect()
    s = {r.node_id: r.score for r in got}
    assert sum(s.values()) == pytest.approx(1) and all(v > 0 for v in s.values()) and all(r.converged for r in got)
    assert not seeded or max(s, key=s.get) == "entity:a"
    names, m = moves_of([r.node_id for r in nodes.collect()], [(r.src, r.dst, r.weight, r.edge_kinds) for r in edges.collect()], (0.4, 0.4, 0.2))
    assert names == sorted(s)
    r = np.array([Config().seed_floor + (seeded and n == "entity:a") for n in names])
    r = r / r.sum()
    x = np.full(len(names), 1 / len(names))
    for turn in range(1, 101):
        before, x = x, 0.5 * (x @ m + x[m.sum(1) == 0].sum() * r) + 0.5 * r
        if np.abs(x - before).sum() < len(names) * Config().pagerank_tolerance:
            break
    assert turn == got[0].iterations < 100 and np.allclose(x, [s[n] for n in names], atol=1e-12)


def test_questions_settle_apart(spark, data):
    """Questions that settle at different steps give what each gives alone."""
    index = graph.materialised(graph.build(table(spark, data, "documents")), "edges", "nodes", "entities")
    walked = graph.walk(index["edges"], index["nodes"])
    corpora = [r[0] for r in index["nodes"].groupBy("corpus_id").count().orderBy("count", "corpus_id").select("corpus_id").collect()]
    chosen = [corpora[0], corpora[-1]]
    q = spark.createDataFrame([(i, c, a) for i, c in enumerate(chosen) for a in ((0.6, 0.3, 0.1),)], "query_id long, corpus_id string, alpha struct<fact:double,sentence:double,chunk:double>")
    first = {r.corpus_id: r.node_id for r in index["nodes"].groupBy("corpus_id").agg(F.min("node_id").alias("node_id")).collect()}
    seeds = spark.createDataFrame([(0, first[chosen[0]], 1.0)], "query_id long, node_id string, score double")
    run = lambda some: {(r.query_id, r.node_id): (round(r.score, 12), r.iterations, r.converged) for r in graph.pagerank(walked, some, seeds).collect()}
    both = run(q)
    assert both == {**run(q.filter("query_id = 0")), **run(q.filter("query_id = 1"))} and all(v[2] for v in both.values())


def test_most_steps(spark):
    q, nodes, edges, seeds = _toy(spark)
    got = graph.pagerank(graph.walk(edges, nodes), q, seeds, Config(pagerank_max_iter=2)).collect()
    assert len(got) == 5 and all(r.iterations == 2 and not r.converged for r in got)


def test_term_scores(spark):
    q = spark.createDataFrame([("c", 1, ["old", "bridge"]), ("c", 2, []), ("d", 3, ["old"])], "corpus_id string, query_id long, query_terms array<string>")
    items = spark.createDataFrame([("c", "x", ["old", "mill"]), ("c", "y", ["bridge", "old"]), ("d", "x", ["new"]), ("c", "z", None)], "corpus_id string, id string, terms array<string>")
    assert {(r.query_id, r.id): r.score for r in retrieval.term_scores(q, items).collect()} == {(1, "x"): 0.5, (1, "y"): 1.0}


def test_dense_beyond_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, "c", rng.normal(size=8).tolist(), i) for i in range(60)], "id long, corpus_id string, vec array<double>, ord long")
    q = v.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "corpus_id", F.col("vec").alias("query_vec"))
    rows = lambda keys: {(r.query_id, r.id, r["rank"]) for r in retrieval.dense(q if keys else q.drop("corpus_id"), v if keys else v.drop("corpus_id"), 5, keys).collect()}
    want = rows([]), rows(["corpus_id"])
    monkeypatch.setattr(retrieval, "BROADCAST_LIMIT", 64)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert (rows([]), rows(["corpus_id"])) == want and len(want[0]) == 30 and want[0] == want[1]


def test_diverse(spark):
    rows = spark.createDataFrame([(1, f"n{i:02d}", "Same" if i < 60 else f"T{i}", 1 - i / 100) for i in range(64)] + [(1, "x", None, 0.5), (1, "y", " ", 0.45)], "query_id long, node_id string, title string, score double")
    assert [r.node_id for r in retrieval.diverse(rows, 4).orderBy("rank").collect()] == ["n00", "x", "y", "n60"]


def test_packing(spark):
    rows = [(1, "old bridge", ["old bridge"], (0.4, 0.4, 0.2), k, f"{k}{i}", f"Title {i % 3}", f"The old bridge number {i} of {k} was sold to somebody else {i * 7}", "Evidence", 1 / (i + 1), i) for k in ("fact", "sentence", "chunk") for i in range(30)]
    rows.append((1, "old bridge", ["old bridge"], (0.4, 0.4, 0.2), "fact", "empty", "", "", "Evidence", 9.0, 99))
    made = evidence.candidates(spark.createDataFrame(rows, "query_id long, query string, sub_questions array<string>, alpha struct<fact:double,sentence:double,chunk:double>, kind string, node_id string, title string, text string, label string, score double, ord int"))
    got = evidence.pack(made).orderBy("place").collect()
    kinds = [r.kind for r in got]
    assert kinds == sorted(kinds, key=("fact", "sentence", "chunk").index) and kinds.count("fact") <= 8 and kinds.count("chunk") <= 4
    assert all(sum(r.title == t and r.kind == k for r in got) <= 3 for t in {r.title for r in got} for k in set(kinds))
    terms = [evidence._terms(r.line) for r in got]
    assert all(len(a & b) / len(a | b) < 0.85 for i, a in enumerate(terms) for b in terms[:i])
    budget = evidence.pack(made, Config(evidence_packing_mode="tokens", evidence_soft_token_budget=150)).agg(F.sum("tokens")).first()[0]
    assert budget <= 150


def _made(spark):
    rows = [(1, (0.3, 0.5, 0.2), k, f"{k}{i}", f"Title {i}", f"{k} line {i * 31} about {'abcdefghijkl'[i % 12] * 4} things", 1 / (i + 1), i) for k in ("fact", "sentence", "chunk") for i in range(15)]
    return spark.createDataFrame(rows, "query_id long, alpha struct<fact:double,sentence:double,chunk:double>, kind string, node_id string, title string, line string, pack_score double, ord int")


def test_packing_without_sentences(spark):
    kinds = lambda **o: [r.kind for r in evidence.pack_without_sentences(_made(spark), **o).collect()]
    loose, strict = kinds(), kinds(strict=True)
    assert set(loose) == set(strict) == {"fact", "chunk"} and strict.count("fact") == 6 and strict.count("chunk") == 4 and len(loose) > len(strict)


def test_groups(spark):
    rows = [(1, f"s{i}", f"T{i % 4}", 1 / (i + 1), (i % 5) / 5, src, part) for src, part in (("fact", None), ("context", None), ("part", 0), ("part", 1), ("ranked", None)) for i in range(10)]
    df = spark.createDataFrame(rows, "query_id long, node_id string, title string, score double, coverage double, source string, part int")
    for quotas in (evidence.MULTI_HOP, evidence.FACT_FIRST):
        got = evidence.grouped(df, quotas=quotas).orderBy("rank").collect()
        assert len(got) <= 14 and len({r.node_id for r in got}) == len(got) and got[0].node_id == "s0" and got[0].label == "Filtered fact source"
    taken = evidence.grouped(df, most=3).join(df.select("node_id", "title").distinct(), "node_id")
    fair = evidence.fair_context(taken, df.filter("source = 'ranked'")).orderBy("rank").collect()
    assert [r.node_id for r in fair[:3]] == [r.node_id for r in taken.orderBy("rank").collect()] and 3 < len(fair) <= 9


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[102] == 100
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_fact_filter(spark):
    rows = spark.createDataFrame([(1, "q", f"f{i}", "t", i + 1, 1.0) for i in range(8)], "query_id long, query string, id string, text string, rank int, score double")
    kept = [r.id for r in retrieval.filter_facts(rows).orderBy("id").collect()]
    assert kept == ["f0", "f1", "f2", "f3", "f4"]

    def chooser(query, pairs):
        return ["f7", "nope", "f1"]

    assert {r.id for r in retrieval.filter_facts(rows, chooser).collect()} == {"f7", "f1"}


@pytest.mark.parametrize("steps", [3, None])
def test_pagerank_in_tasks_and_by_joins(spark, data, monkeypatch, steps):
    """Arrays of a corpus in one task give what joins give: all scores, the highest, sentences, sums of passages."""
    index = graph.materialised(graph.build(table(spark, data, "documents")), "edges", "nodes")
    c = index["nodes"].groupBy("corpus_id").count().orderBy("count", "corpus_id").first()[0]
    q = spark.createDataFrame([(1, c, (0.6, 0.3, 0.1)), (2, c, (0.1, 0.2, 0.7))], "query_id long, corpus_id string, alpha struct<fact:double,sentence:double,chunk:double>")
    seeds = index["nodes"].filter((F.col("corpus_id") == c) & (F.col("node_type") == "entity")).limit(2).select(F.lit(1).cast("long").alias("query_id"), "node_id", F.lit(1.0).alias("score"))
    seeds = spark.createDataFrame(seeds.collect(), seeds.schema)
    walked = graph.walk(index["edges"], index["nodes"])

    def run(emit, top=0):
        return {tuple(r)[:2]: [round(float(x), 9) for x in tuple(r)[2:]] for r in graph.pagerank(walked, q, seeds, Config(), steps, emit, top).collect()}

    tasks = {e: run(e) for e in ("all", "sentence", "passages")}
    best = run("top", 3)
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    assert tasks == {e: run(e) for e in tasks} and len(tasks["all"]) > len(tasks["sentence"]) > 0 < len(tasks["passages"])
    for n in (1, 2):
        scores = sorted((v[0] for k, v in tasks["all"].items() if k[0] == n), reverse=True)
        assert sorted((v[0] for k, v in best.items() if k[0] == n), reverse=True)[:3] == scores[:3] and all(tasks["all"][k] == v for k, v in best.items())


def test_counts_without_edges(spark):
    """Chunks and degrees of entities from mentions are those from edges, also where chunks share a sentence id."""
    rows = [(1, "c", 0, "T", "0 0 Ada Byron"), (2, "c", 1, "T 0", "0 Ada Byron"), (3, "c", 2, "U", "Ada Byron met Otto Lee. Otto Lee met Ada Byron in Bath."), (4, "d", 3, "U", "Otto Lee came.")]
    index = graph.build(spark.createDataFrame(rows, "doc_id long, corpus_id string, document_index int, title string, text string"))
    assert index["sentences"].filter("ord < 3").select("sentence_id").distinct().count() == 1
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(graph.entity_chunks(index["sentences"], index["mentions"])) == found(graph.chunk_counts(index["edges"], index["nodes"]))
    assert found(graph.entity_degrees(index["mentions"], index["facts"])) == found(graph.degrees(index["edges"]).filter("node_id like 'entity:%'"))


def test_contenders(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.5, 0.5, 0.25, 0.25, 0.25, 0.0))] + [(2, 9, 0.0)], "query_id long, id int, score double")
    kept = lambda k: {(r.query_id, r.id) for r in retrieval.contenders(rows, ["query_id"], k).collect()}
    assert kept(2) == {(1, 0), (1, 1), (2, 9)} and kept(3) == kept(5) == {(1, i) for i in range(5)} | {(2, 9)} and len(kept(6)) == 7
