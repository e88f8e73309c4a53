"""Settings of the retrieval engine, with the defaults that results must match."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """One immutable set of settings; every operator takes what it needs from it as literals."""

    # Defaults of the retrieval pipeline.
    chunk_size_words: int = 256
    chunk_overlap_words: int = 64
    use_paragraph_as_chunk: bool = True
    task_profile: str = "auto"
    enable_intent_routing: bool = True
    enable_query_decomposition: bool = True
    enable_entity_similarity_edges: bool = True
    entity_similarity_threshold: float = 0.8
    entity_similarity_top_k: int = 2047
    enable_granularity_awareness: bool = True
    enable_sentence_layer: bool = True
    entity_top_k: int = 12
    fact_top_k: int = 12
    sentence_top_k: int = 20
    chunk_top_k: int = 12
    passage_output_top_k: int = 10
    qa_passage_top_k: int = 4
    qa_max_input_tokens: int = 7000
    pagerank_alpha: float = 0.5
    pagerank_max_iter: int = 100
    pagerank_tolerance: float = 1e-6
    transition_lambda: float = 1.2
    enable_granularity_pagerank_bias: bool = True
    hub_penalty: float = 0.08
    seed_floor: float = 1e-06
    fact_rerank_top_k: int = 24
    fact_rerank_keep_k: int = 12
    enable_fact_source_first_evidence: bool = False
    enable_fact_chunk_boost: bool = False
    fact_chunk_boost: float = 0.35
    enable_fair_sentence_context: bool = False
    evidence_extra_ranked_sentence_k: int = 6
    evidence_max_sentences: int = 18
    evidence_title_limit: int = 3
    evidence_passage_context_k: int = 2
    evidence_passage_excerpt_tokens: int = 150
    evidence_chunk_max_tokens: int = 256
    evidence_packing_mode: str = "alpha_count"
    evidence_alpha_total_units: int = 20
    evidence_alpha_uniform_mix: float = 0.0
    evidence_soft_token_budget: int = 0
    evidence_min_score: float = 0.0
    evidence_redundancy_threshold: float = 0.85
    evidence_use_alpha_weights: bool = True
    enable_no_fact_fallback: bool = True
    entity_hub_suppression: float = 1.0
    edge_type_weights: dict = field(default_factory=lambda: {"entity_relation": 1.0, "entity_similarity": 0.9, "entity_sentence": 1.0, "entity_chunk": 0.9, "sentence_chunk": 1.0, "sentence_sequence": 0.6})
    profile_alpha_priors: dict = field(default_factory=lambda: {"single_hop": (0.6, 0.3, 0.1), "multi_hop": (0.4, 0.4, 0.2), "long_context": (0.1, 0.2, 0.7)})
