"""The queries of the core operators, each over its whole tables; questions of searches that SQL checks are those whose id ends in
00, ``packed_evidence`` and ``direct_evidence`` answer every question."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import reader
from ..functions import text as X
from ..functions.scores import entropy_confidence, heuristic_alpha, l1_normalised, profile_of, quota_of
from ..functions.scores import alpha as normal_alpha
from ..operators import corpus, evaluation, evidence, graph, nested, retrieval
from ..runtime import small_side, stored
from ..sources import payloads
from ..sources.tables import table
from . import evaluate, oracle, pipeline

CONFIG = Config()
JSON_COLUMNS = ["ranked_evidence", "channel_scores", "retrieval_meta"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- index ----------------------------------------------------------------------------------------------------------


def _sentences(spark, d) -> DataFrame:
    return graph.sentences(graph.chunks(table(spark, d, "documents")))


@query
def chunk_windows(spark, d):
    """Windows of 256 words that overlap by 64."""
    rows = graph.chunks(table(spark, d, "documents"), Config(use_paragraph_as_chunk=False))
    return rows.select(F.col("ord").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), X.word_count(F.col("body")).cast("long").alias("n_words"), F.md5("body").alias("digest"))


@query
def sentence_split(spark, d):
    return _sentences(spark, d).select(F.col("ord").alias("doc_id"), F.col("sentence_index").cast("long").alias("sentence_index"), F.col("text").alias("sentence"))


@query
def sentence_sequence_edges(spark, d):
    order = Window.partitionBy("corpus_id", "ord", "chunk_id").orderBy("sentence_index")
    rows = _sentences(spark, d).withColumn("src", F.lag("sentence_id").over(order)).filter("src is not null")
    return rows.select("corpus_id", F.col("ord").alias("doc_id"), F.col("sentence_index").cast("long").alias("sentence_index"), "src", F.col("sentence_id").alias("dst"))


@query
def node_ids(spark, d):
    return graph.chunks(table(spark, d, "documents")).select(F.col("ord").alias("doc_id"), "chunk_id")


@query
def entity_mentions(spark, d):
    rows = graph.mentions(_sentences(spark, d))
    return rows.select(F.col("ord").alias("doc_id"), F.col("sentence_index").cast("long").alias("sentence_index"), F.col("place").cast("long").alias("place"), "entity")


@query
def entity_nodes(spark, d):
    return graph.entities(graph.mentions(_sentences(spark, d)))


@query
def facts_regex(spark, d):
    rows = graph.facts(_sentences(spark, d))
    return rows.select(F.col("ord").alias("doc_id"), F.col("sentence_index").cast("long").alias("sentence_index"), F.col("fact_index").cast("long").alias("fact_index"), "head", "relation", "tail", "confidence")


def _index(spark, d, encode=None):
    return graph.build(table(spark, d, "documents"), CONFIG, encode)


@query
def edges_merged(spark, d):
    return _index(spark, d)["edges"].select("corpus_id", "src", "dst", "weight", "edge_type", F.array_join("edge_kinds", ",").alias("edge_kinds"), F.array_join("relations", ",").alias("relations"))


@query
def edge_kind_counts(spark, d):
    return _index(spark, d)["edges"].select("corpus_id", F.explode("edge_kinds").alias("edge_kind")).groupBy("corpus_id", "edge_kind").agg(F.count("*").alias("edges"))


@query
def layer_counts(spark, d):
    """Nodes per layer; facts count with repeats."""
    index = _index(spark, d)
    layers = index["nodes"].groupBy("corpus_id", F.col("node_type").alias("layer")).agg(F.count("*").alias("n"))
    return layers.union(index["facts"].groupBy("corpus_id").agg(F.count("*").alias("n")).select("corpus_id", F.lit("fact"), "n"))


@query
def entity_degree(spark, d):
    return graph.degrees(_index(spark, d)["edges"]).filter(F.col("node_id").startswith("entity:"))


@query
def entity_chunk_count(spark, d):
    split = stored(_sentences(spark, d).select("corpus_id", "ord", "chunk_id", "sentence_id", "sentence_index", "entities"))
    return graph.entity_chunks(split, graph.mentions(split))


@query
def strip_sentence_layer(spark, d):
    """Edges by type once the sentence layer is out and fact ends are linked to chunks."""
    edges = graph.without_sentences(_index(spark, d))["edges"]
    return edges.groupBy("corpus_id", "edge_type").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


# ---- vectors and scores ---------------------------------------------------------------------------------------------


@query
def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ord"))
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return retrieval.dense(q, v, CONFIG.entity_top_k, []).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def similarity_edges(spark, d):
    """Both directions of every pair at 0.3 or above (the default threshold finds none in this table)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return graph.similarity_weights(graph.similarity_edges(v, 0.3)).select("src", "dst", F.round("weight", 6).alias("weight"))


def _examples(spark, d):
    return table(spark, d, "per_example")


@query
def score_normalise(spark, d):
    rows = _examples(spark, d).select("example_id", "corpus_id", F.coalesce("f1", F.lit(0.0)).alias("score"))
    return l1_normalised(rows, ["corpus_id"]).withColumn("score", F.round("score", 9))


@query
def lexical_overlap(spark, d):
    return _examples(spark, d).select("example_id", F.round(X.lexical_overlap(F.col("question"), F.col("gold_answer")), 6).alias("overlap"))


@query
def content_coverage(spark, d):
    return _examples(spark, d).select("example_id", F.round(X.coverage(F.col("question"), F.col("predicted_answer")), 6).alias("coverage"))


def _parts(spark, d):
    rows = _examples(spark, d).filter("query_id is not null and execution_mode is not null")
    return rows.select("query_id", F.col("execution_mode").alias("id"), F.col("example_id").alias("part"), F.coalesce("retrieval_latency", F.lit(0.0)).alias("score"))


@query
def max_merge(spark, d):
    return retrieval.max_channel(_parts(spark, d)).withColumn("score", F.round("score", 9))


@query
def last_wins_merge(spark, d):
    return retrieval.entity_channel(_parts(spark, d)).withColumn("score", F.round("score", 9))


@query
def heuristic_alpha_routing(spark, d):
    a = F.col("a")
    rows = _examples(spark, d).select("example_id", heuristic_alpha(F.col("question")).alias("a"))
    return rows.select("example_id", a["fact"].alias("fact"), a["sentence"].alias("sentence"), a["chunk"].alias("chunk"), profile_of(a).alias("profile"), F.round(entropy_confidence(a), 6).alias("confidence"))


@query
def alpha_quota(spark, d):
    """Units per kind of every example's profile."""
    rows = _examples(spark, d).filter("alpha_f is not null and alpha_s is not null and alpha_c is not null").select("example_id", normal_alpha(F.col("alpha_f"), F.col("alpha_s"), F.col("alpha_c")).alias("a"))
    return rows.withColumn("q", quota_of(F.col("a"), CONFIG)).select("example_id", "q.fact", "q.sentence", "q.chunk")


@query
def heuristic_decompose(spark, d):
    rows = _examples(spark, d).filter("question is not null").select("example_id", pipeline.heuristic_parts(F.col("question")).alias("parts"))
    return rows.select("example_id", F.posexplode("parts").alias("part", "sub_question"))


# ---- questions against the graph ------------------------------------------------------------------------------------


def _lean(spark, d, *names) -> dict[str, DataFrame]:
    return graph.materialised(graph.lean(table(spark, d, "documents"), CONFIG), *(names or ("",)))


def _all_questions(spark, d) -> DataFrame:
    return _examples(spark, d).filter("example_id is not null and question is not null").select(F.col("example_id").alias("query_id"), "corpus_id", F.col("question").alias("query"))


def _questions(spark, d) -> DataFrame:
    rows = _all_questions(spark, d).filter("query_id % 100 = 0")
    return stored(rows.withColumn("alpha", heuristic_alpha(F.col("query"))).withColumn("query_terms", X.overlap_terms(F.col("query"))))


def _fact_texts(facts) -> DataFrame:
    return facts.groupBy("corpus_id", F.col("fact_id").alias("id")).agg(F.max_by("text", F.struct("ord", "sentence_index", "fact_index")).alias("text"))


def _lexical_facts(index, q) -> DataFrame:
    """Facts of each question's corpus by lexical overlap, reranked: the plan of the fact channel without an encoder."""
    texts = _fact_texts(index["facts"])
    scored = retrieval.term_scores(q, texts.select("corpus_id", "id", X.overlap_terms(F.col("text")).alias("terms")))
    best = retrieval.top_k(scored, ["query_id"], CONFIG.fact_rerank_top_k, ["id"]).drop("rank")
    named = best.join(small_side(q.select("query_id", "query")), "query_id").join(texts, ["corpus_id", "id"]).withColumn("ord", F.col("id"))
    return retrieval.rerank_facts(named.select("query_id", "query", "id", "text", "ord", "score"), CONFIG).drop("ord")


def _lexical_chunks(index, q) -> DataFrame:
    bodies = index["chunks"].groupBy("corpus_id", F.col("chunk_id").alias("id")).agg(F.max_by("body", "ord").alias("body"))
    scored = retrieval.term_scores(q, bodies.select("corpus_id", "id", X.overlap_terms(F.col("body")).alias("terms"))).drop("corpus_id")
    return l1_normalised(retrieval.top_k(scored, ["query_id"], CONFIG.chunk_top_k, ["id"]), ["query_id"])


def _seeds(index, q) -> DataFrame:
    """Entities that the question names and the corpus has, one each."""
    named = q.select("query_id", "corpus_id", F.explode(X.regex_entities(F.col("query"))).alias("e")).withColumn("entity_id", X.node_id("entity", F.col("e")))
    return index["entities"].join(small_side(stored(named)), ["corpus_id", "entity_id"]).select("query_id", F.col("entity_id").alias("node_id"), F.lit(1.0).alias("score")).distinct()


def _ranks(index, q, steps: int | None = oracle.STEPS, seeds=None, emit="all", top=0) -> DataFrame:
    seeds = _seeds(index, q) if seeds is None else seeds
    return graph.pagerank(graph.walked(index, CONFIG), q, seeds, CONFIG, steps, emit, top)


def _channels(index, q) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reranked facts, chunks, and the restart seeds that they give."""
    facts, chunks = stored(_lexical_facts(index, q)), stored(_lexical_chunks(index, q))
    counts, degree = graph.entity_chunks(index["sentences"], index["mentions"]), graph.entity_degrees(index["mentions"], index["facts"])
    return facts, chunks, retrieval.seed_scores(facts, index["facts"], chunks, q, counts, degree, None, CONFIG)


@query
def fact_rerank(spark, d):
    facts = stored(graph.facts(_sentences(spark, d)).select("corpus_id", "fact_id", "text", "ord", "sentence_index", "fact_index"))
    return _lexical_facts({"facts": facts}, _questions(spark, d)).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def seed_scores(spark, d):
    """Restart seeds from reranked facts and chunks, damped at hubs."""
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    return _channels(index, q)[2].select("query_id", "node_id", F.round("score", 6).alias("score"))


@query
def ppr_fixed_iters(spark, d):
    """The thirty highest nodes of every question after a fixed number of steps."""
    index, q = _lean(spark, d), _questions(spark, d)
    rounded = _ranks(index, q, emit="top", top=30).select("query_id", "node_id", F.round("score", 9).alias("score"))
    return retrieval.top_k(rounded, ["query_id"], 30, ["node_id"]).drop("rank")


@query
def passage_rank(spark, d):
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    facts = stored(pipeline.ranked_facts(index["facts"], _lexical_facts(index, q), q))
    ranked = retrieval.rank_passages(_ranks(index, q, emit="passages"), index, _lexical_chunks(index, q), facts, q, CONFIG)
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def passage_rank_converged(spark, d):
    """Passages as the whole pipeline ranks them: restarts at the seeds of facts and chunks, steps until they settle."""
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    reranked, chunks, seeds = _channels(index, q)
    facts = stored(pipeline.ranked_facts(index["facts"], reranked, q))
    ranked = retrieval.rank_passages(_ranks(index, q, None, seeds, "passages"), index, chunks, facts, q, CONFIG)
    return ranked.select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query
def sentence_blend(spark, d):
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    facts = stored(pipeline.ranked_facts(index["facts"], _lexical_facts(index, q), q))
    none = _lexical_chunks(index, q).limit(0)
    return retrieval.sentence_scores(_ranks(index, q, emit="sentence"), none, facts, CONFIG).withColumn("score", F.round("score", 9))


@query
def sentence_blend_dense(spark, d):
    """The same with a channel of sentences (by lexical overlap) in it."""
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    facts = stored(pipeline.ranked_facts(index["facts"], _lexical_facts(index, q), q))
    texts = index["sentences"].groupBy("corpus_id", F.col("sentence_id").alias("id")).agg(F.max_by("text", F.struct("ord", "sentence_index")).alias("text"))
    scored = retrieval.term_scores(q, texts.select("corpus_id", "id", X.overlap_terms(F.col("text")).alias("terms"))).drop("corpus_id")
    channel = l1_normalised(retrieval.top_k(scored, ["query_id"], CONFIG.sentence_top_k, ["id"]), ["query_id"])
    return retrieval.sentence_scores(_ranks(index, q, emit="sentence"), channel, facts, CONFIG).withColumn("score", F.round("score", 9))


@query
def neighbour_sentences(spark, d):
    sentences = graph.sentences(graph.chunks(table(spark, d, "documents")))
    index, q = {"sentences": stored(sentences), "facts": None}, _questions(spark, d)
    index["facts"] = stored(graph.facts(index["sentences"]))
    facts = pipeline.ranked_facts(index["facts"], _lexical_facts(index, q), q).select("query_id", "corpus_id", "chunk_id", "sentence_index", "score")
    return retrieval.neighbours(facts, index["sentences"]).withColumn("score", F.round("score", 6))


@query
def title_diverse_topk(spark, d):
    """The best passages of each question, one a title: all passages of its corpus are ranked."""
    q = _questions(spark, d)
    bodies = graph.chunks(table(spark, d, "documents")).groupBy("corpus_id", F.col("chunk_id").alias("node_id")).agg(F.max_by(F.struct("title", "body"), "ord").alias("c"))
    termed = stored(bodies.select("corpus_id", "node_id", "c.title", X.overlap_terms(F.col("c.body")).alias("terms")))
    scored = termed.join(small_side(q), "corpus_id").select("query_id", "node_id", "title", X.term_share(F.col("query_terms"), F.col("terms")).alias("score"))
    return retrieval.diverse(scored, CONFIG.qa_passage_top_k).withColumn("rank", F.col("rank").cast("long"))


def _answered(spark, d, **options):
    encode = retrieval.hashed_encoder()
    return pipeline.answer(graph.materialised(_index(spark, d, encode)), stored(_all_questions(spark, d)), encode, config=CONFIG, **options)


@query
def packed_evidence(spark, d):
    """The whole pipeline with the hashed encoder: packed evidence of every question."""
    return _answered(spark, d)["packed"]


@query
def direct_evidence(spark, d):
    """The pipeline without propagation."""
    return _answered(spark, d, propagate=False)["packed"]


@query
def fact_evidence_scores(spark, d):
    """Facts as they are scored without a sentence layer: with the ranks of their ends and chunks."""
    index, q = _lean(spark, d, "facts"), _questions(spark, d)
    facts = stored(pipeline.ranked_facts(index["facts"], _lexical_facts(index, q), q))
    scored = evidence.fact_evidence(facts, stored(evidence.asked_ranks(facts, _ranks(index, q))), CONFIG)
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


@query
def passages_without_sentences(spark, d):
    """Passages of the index whose sentence layer is taken out, by the fixed steps and seeds."""
    config = replace(CONFIG, enable_sentence_layer=False)
    whole, q = graph.materialised(_index(spark, d), "edges", "nodes", "entities", "facts"), _questions(spark, d)
    index = graph.materialised(graph.without_sentences(whole), "edges", "nodes", "facts")
    facts = stored(pipeline.ranked_facts(index["facts"], _lexical_facts(whole, q), q))
    ranks = graph.pagerank(graph.walk(index["edges"], index["nodes"], config), q, _seeds(whole, q), config, oracle.STEPS, "passages")
    ranked = retrieval.rank_passages(ranks, index, _lexical_chunks(whole, q), facts, q, config)
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def index_summary(spark, d):
    """What is known of each corpus's index."""
    return evaluate.index_records(graph.materialised(_index(spark, d), "edges", "nodes")).select("corpus_id", "nodes", "entity_nodes", "sentence_nodes", "chunk_nodes", "fact_nodes", "edges")


@query
def edge_type_averages(spark, d):
    """Mean edges of each type over the corpora that have it."""
    return evaluation.edge_type_averages(evaluate.index_records(graph.materialised(_index(spark, d), "edges", "nodes"))).withColumn("edges", F.round("edges", 6))


# ---- given extractions, evaluation, corpora -------------------------------------------------------------------------


@query
def given_facts(spark, d):
    rows = table(spark, d, "extract_sentence").select("sentence_id", F.explode("triples").alias("t")).select("sentence_id", X.clean_relation(F.col("t.relation")).alias("relation"))
    return rows.groupBy("relation").agg(F.count("*").alias("facts"), F.countDistinct("sentence_id").alias("sentences"))


@query
def truncate_words(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(X.truncated(F.col("text"), 50)).alias("digest"))


@query
def token_f1(spark, d):
    p, g = F.col("predicted_answer"), F.col("gold_answer")
    return _examples(spark, d).select("example_id", F.round(X.token_f1(p, g), 6).alias("f1"), X.exact_match(p, g).alias("em"))


@query
def or_choices(spark, d):
    """The choices that questions offer, and the answers settled on them."""
    rows = _examples(spark, d).filter("question is not null").withColumn("offered", reader.choices(F.col("question")))
    return rows.select("example_id", F.array_join("offered", " | ").alias("offered"), reader.settled(X.parsed_answer(F.col("predicted_answer")), F.col("offered")).alias("settled"))


@query
def reader_passages(spark, d):
    """Documents of the questions' corpora as a reader gets them: an excerpt under a numbered heading."""
    q = _questions(spark, d)
    bodies = graph.chunks(table(spark, d, "documents")).select("corpus_id", "ord", F.col("chunk_id").alias("node_id"), "title", F.md5("body").alias("digest"), "body")
    termed = bodies.select("corpus_id", "ord", "node_id", "title", "digest", X.overlap_terms(F.col("body")).alias("terms"))
    scored = termed.join(small_side(q), "corpus_id").select("query_id", "corpus_id", "node_id", "title", "ord", "digest", X.term_share(F.col("query_terms"), F.col("terms")).alias("score"))
    near = retrieval.contenders(scored, ["query_id"], CONFIG.qa_passage_top_k)
    best = stored(retrieval.top_k(near, ["query_id"], CONFIG.qa_passage_top_k, ["node_id", "title", "ord", "digest"]))
    key = ["corpus_id", "ord", "node_id", "title", "digest"]
    texts = bodies.join(small_side(best.select(*key).distinct()), key, "left_semi").dropDuplicates(key)
    best = best.join(texts, key).join(small_side(q.select("query_id", "query")), "query_id")
    return best.select("query_id", "rank", X.formatted_passage(F.col("rank"), F.col("title"), reader.reader_excerpt(F.col("body"), F.col("query"), 120)).alias("passage"))


@query
def best_em_f1(spark, d):
    """Best scores of each sample's own answer forms against its gold set."""
    rows = table(spark, d, "samples").withColumn("golds", evaluation.gold_set(F.col("answer"), F.col("answer_aliases")))
    em, f1 = evaluation.best(F.lower("answer"), F.col("golds"))
    return rows.select("sample_id", F.size("golds").alias("golds"), em.alias("em"), F.round(f1, 6).alias("f1"))


@query
def source_summary(spark, d):
    rows = evaluation.by_source(_examples(spark, d))
    return rows.select("source", "examples", *[F.round(f"avg_{m}", 9).alias(f"avg_{m}") for m in evaluation.METRICS])


@query
def alpha_std_by_source(spark, d):
    rows = evaluation.alpha_spread(_examples(spark, d))
    return rows.select("source", "examples", *[F.round(c, 9).alias(c) for c in rows.columns[2:]])


@query
def repeat_summary(spark, d):
    """Means and deviations of each source over its evaluated questions, as over repeated runs."""
    rows = evaluation.repeat_summary(_examples(spark, d).withColumn("source", F.coalesce("source_dataset", F.lit("unknown"))), "source", ["f1", "em", "retrieval_latency"])
    return rows.select("source", "runs", *[F.round(c, 9).alias(c) for c in rows.columns[2:]])


@query
def gold_in_answer(spark, d):
    """Examples whose gold answer occurs in the predicted one."""
    matched = evaluation.answer_match(F.array("gold_answer"), F.col("predicted_answer"))
    return _examples(spark, d).filter("gold_answer is not null").select("example_id", (F.size(matched) > 0).alias("matched"))


@query
def title_slugs(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", X.slug(F.col("title")).alias("slug"))


@query
def held_out_samples(spark, d):
    """Samples of the development split, whichever name it has."""
    return payloads.of_split(table(spark, d, "samples"), "dev").select("sample_id", F.size("documents").alias("documents"))


@query
def required_in_corpus(spark, d):
    """Required documents that the corpus holds already."""
    return corpus.already_in(table(spark, d, "documents"), corpus.required(table(spark, d, "samples")))


@query
def mode_consistency(spark, d):
    return evaluation.mode_consistency(_examples(spark, d))


@query
def doc_dedup(spark, d):
    return corpus.keyed(table(spark, d, "documents")).select("key", "doc_id")


@query
def required_docs(spark, d):
    rows = corpus.required(table(spark, d, "samples"))
    return rows.select("key", F.lit(True).alias("has"), F.size("sample_ids").cast("long").alias("samples"))


@query
def distractors(spark, d):
    return corpus.distractors(table(spark, d, "documents"), corpus.required(table(spark, d, "samples"))).select("key", "doc_id")


@query
def scaled_corpus(spark, d):
    """All required documents and half of the distractors, in seeded order."""
    docs, needed = table(spark, d, "documents"), corpus.required(table(spark, d, "samples"))
    return corpus.scaled(docs, needed, share=0.5).select("key", "required")


# ---- nested records (problem 7) -------------------------------------------------------------------------------------


def _nodes(spark, d, *kinds):
    return nested.nodes(table(spark, d, "last_query_result"), "result_id", JSON_COLUMNS, ("element", *kinds))


@query
def p7_found(spark, d):
    """Objects that are elements of arrays, with the path of the one around them."""
    return nested.object_table(_nodes(spark, d)).select(F.col("record_id").alias("result_id"), "parent_path", "path").distinct()


@query
def p7_objects(spark, d):
    """The table of element objects with their interval labels."""
    return nested.object_table(_nodes(spark, d)).withColumnRenamed("record_id", "result_id")


@query
def p7_values(spark, d):
    """The table of values with the element object they belong to."""
    return nested.value_table(_nodes(spark, d, "value")).withColumnRenamed("record_id", "result_id")


@query
def p7_arrays(spark, d):
    """The table of arrays with the element object they belong to."""
    return nested.array_table(_nodes(spark, d, "array")).withColumnRenamed("record_id", "result_id")


SQL = {("heuristic_alpha_routing" if k == "heuristic_alpha" else k): v for k, v in oracle.SQL.items()}
