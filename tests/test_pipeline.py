"""The pipeline's branches, model hooks, and evaluation runs."""

import pytest
from pyspark.sql import functions as F

from lodestrand.config import Config
from lodestrand.operators import corpus, evaluation, graph, retrieval
from lodestrand.plans import evaluate, pipeline

TEXTS = [
    ("Ada", "Ada Byron married Otto Lee in Bath. Ada Byron wrote the Blue Ledger. Otto Lee sold the Old Mill. The Old Mill burned in Bath."),
    ("Bath", "Bath is a town on the Avon River. The Old Mill of Bath was built by Eva Stone. Eva Stone joined the Salt Company."),
    ("Eva", "Eva Stone was born in Dover. Her father Tom Stone sold the Blue Ledger to Ada Byron."),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("c", i, i, t, x) for i, (t, x) in enumerate(TEXTS)], "corpus_id string, doc_id long, document_index int, title string, text string")
    return graph.materialised(graph.build(docs, Config(), retrieval.hashed_encoder()))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "c", "Whose father sold the Blue Ledger to Ada Byron?")], "query_id long, corpus_id string, query string")


@pytest.mark.parametrize(
    "options, facts, labels",
    [
        ({}, 12, {"Fact", "Fact source evidence", "Sentence evidence", "Passage"}),
        ({"enable_granularity_awareness": False}, 12, {"Fact", "Uniform fact source evidence", "Uniform sentence evidence", "Passage"}),
        ({"evidence_use_alpha_weights": False, "task_profile": "single_hop"}, 10, {"Fact", "Fact source sentences"}),
        ({"evidence_use_alpha_weights": False, "task_profile": "long_context"}, 5, {"Fact", "High-signal sentences", "Passage"}),
        ({"evidence_use_alpha_weights": False, "task_profile": "multi_hop"}, 8, {"Fact", "Filtered fact source", "Sub-question evidence", "Evidence", "Passage"}),
        ({"evidence_use_alpha_weights": False, "task_profile": "multi_hop", "enable_fact_source_first_evidence": True, "enable_fair_sentence_context": True}, 8, {"Fact", "Filtered fact source", "Local sentence context", "Sub-question evidence", "Ranked sentence context", "Evidence", "Passage"}),
    ],
)
def test_dispatch(index, asked, options, facts, labels):
    got = pipeline.answer(index, asked, config=Config(**options), propagate=False)
    rows = got["candidates"].collect()
    assert {r.label for r in rows} <= labels and sum(r.kind == "fact" for r in rows) <= facts
    assert len({(r.kind, r.node_id) for r in rows}) == len(rows) and got["packed"].count() > 0
    if options.get("task_profile") == "single_hop":
        assert not any(r.kind == "chunk" for r in rows) and sum(r.kind == "sentence" for r in rows) <= 6
    if options.get("task_profile") == "multi_hop":
        assert sum(r.kind == "sentence" for r in rows) <= 18 and sum(r.kind == "chunk" for r in rows) <= 2


def test_models(spark, index, asked):
    """Hooks are called, and what they say counts; replies that say nothing fall back."""
    seen = []
    models = pipeline.Models(
        route=lambda q: F.lit('{"alpha_F": 0.1, "alpha_S": 0.1, "alpha_C": 0.8}'), decompose=lambda q: F.array(F.lit("Who sold it?"), F.lit("Who bought it?")),
        filter_facts=lambda q, pairs: [pairs[-1][0]], read=evaluate.reader_model(lambda prompts: [f"Thought: so.\nAnswer: Tom Stone ({len(p.split())})" for p in prompts]).read,
    )
    got = pipeline.answer(index, asked, models=models, propagate=False)
    r = got["routed"].first()
    assert r.profile == "long_context" and not r.parse_failed and got["fact"].count() == 1
    assert got["answers"].first().predicted_answer.startswith("Tom Stone")
    bad = pipeline.routed(asked, Config(), pipeline.Models(route=lambda q: F.lit("no idea"))).first()
    assert bad.parse_failed and abs(bad.alpha.fact - 1 / 3) < 1e-9
    parts = pipeline.routed(asked, Config(task_profile="multi_hop"), models).first().sub_questions
    assert parts == ["Who sold it?", "Who bought it?"] and pipeline.routed(asked, Config(task_profile="multi_hop", enable_query_decomposition=False), models).first().sub_questions == ["Whose father sold the Blue Ledger to Ada Byron?"]
    shown = pipeline.views(got, 3, 2)
    assert shown["ranked_nodes"].count() == 3 and shown["sentence_channel"].count() <= 2 and not seen


def test_without_sentences(index, asked):
    bare = graph.without_sentences(index)
    config = Config(enable_sentence_layer=False)
    for strict in (False, True):
        got = pipeline.answer(bare, asked, config=config, iterations=1, strict=strict)
        assert {r.kind for r in got["packed"].collect()} == {"fact", "chunk"} and got["passages"].count() > 0
    assert got["facts"].filter("sentence_id <> ''").count() == 0


QUICK = Config(pagerank_max_iter=1)
SAMPLES = "sample_id string, question string, answer string, answer_aliases array<string>, source_dataset string, documents array<struct<idx:string,title:string,text:string,is_supporting:boolean>>"


@pytest.fixture(scope="module")
def samples(spark):
    docs = [(str(i), t, x, i == 2) for i, (t, x) in enumerate(TEXTS)]
    return spark.createDataFrame([("s1", "Whose father sold the Blue Ledger?", "Tom Stone", ["T. Stone"], "naturalquestions", docs), ("s2", "Who built the Old Mill?", "Eva Stone", None, None, docs[:2]), ("s3", " ", "x", None, None, docs), ("s4", "No corpus?", "x", None, None, [])], SAMPLES)


def test_evaluation(spark, samples, tmp_path):
    index = graph.materialised(graph.build(evaluate.samples_to_documents(samples)))
    models = evaluate.reader_model(lambda prompts: ["Answer: Tom Stone"] * len(prompts))
    asked = samples.withColumn("corpus_id", F.col("sample_id"))
    rows = evaluate.evaluate(index, asked, QUICK, None, models, by_source=True)
    told = evaluate.write_run(rows, str(tmp_path / "run"), variant="base").first().asDict()
    got = {r.query_id: r for r in rows.collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].em == 1 and got["s2"].em == 0 and got["s1"].edge_types["entity_relation"] > 0
    assert told["num_queries"] == 2 and told["EM"] == 0.5 and told["variant"] == "base" and told["edge_sentence_chunk"] > 0 and told["parse_fail_rate"] == 0
    names = {p.name for p in (tmp_path / "run").iterdir()}
    assert {"per_example", "metrics_json", "metrics_csv", "summary_overall", "summary_by_source", "summary_alpha", "summary_tokens", "config.json", "corpus_manifest.json"} <= names
    assert spark.read.csv(str(tmp_path / "run" / "metrics_csv"), header=True).columns[:3] == ["variant", "scale", "num_queries"]
    assert evaluate.of_source(Config(), "narrativeqa").chunk_size_words == 1024 and evaluate.of_source(Config(), "x").qa_passage_top_k == 4
    assert evaluate.with_profile_defaults(Config(task_profile="single_hop")).qa_passage_top_k == 0 and evaluate.with_profile_defaults(Config(task_profile="single_hop"), frozenset(["qa_passage_top_k"])).qa_passage_top_k == 4


def test_global_scaling(spark, samples):
    others = spark.createDataFrame([(i, None, f"Other {i}", f"Nothing of note happened in Town {i}.") for i in range(6)], "doc_id long, corpus_id string, title string, text string")
    models = evaluate.reader_model(lambda prompts: ["Answer: Eva Stone"] * len(prompts))
    good = samples.filter("sample_id in ('s1', 's2')")
    got = evaluate.global_scaling(others, good, [1, 5, 99], QUICK, None, models, repeats=2)
    assert {(r.variant, r.scale) for r in got.collect()} == {("repeat_0", 5), ("repeat_1", 5)} and all(r.EM == 0.5 for r in got.collect())
    summary = evaluation.repeat_summary(got, "scale", ["F1", "EM"]).first()
    assert summary.runs == 2 and summary.EM_mean == 0.5 and summary.EM_std == 0
    assert corpus.plan_scales(9, 3, (1, 5, 99)) == [(1, "below the required documents"), (5, ""), (99, "above the corpus")]


def test_modes_agree(spark, samples):
    index = graph.materialised(graph.build(evaluate.samples_to_documents(samples)))
    r = evaluate.compare_modes(index, samples.filter("sample_id in ('s1', 's2')").withColumn("corpus_id", F.col("sample_id")), QUICK).first()
    assert (r.queries, r.paired, r.same_predicted_answer, r.same_f1) == (2, 2, 2, 2)


def test_answer_match_and_keys(spark):
    row = spark.createDataFrame([(["The Old Mill", "Bath", None, ""], "He saw an old mill!", "The Old-Mill of a Bath", "  Fort  Ab: No. 3 ")], "c array<string>, t string, e string, s string")
    from lodestrand.functions import text as X

    got = row.select(evaluation.answer_match(F.col("c"), F.col("t")).alias("m"), X.entity_key(F.col("e")).alias("k"), X.slug(F.col("s")).alias("s")).first()
    assert got.m == ["The Old Mill"] and got.k == "old mill of bath" and got.s == "fort-ab-no-3"
