"""The typed graph of a corpus: chunks, sentences, entities, facts, edges, and personalised propagation over it.

All tables are keyed by ``corpus_id``, so that many corpora are built and queried as one job. ``ord`` carries the order
in which documents arrive (their doc_id) and decides every tie: attributes of nodes that share an id are those of the
last (chunks, sentences) or the first (entities).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..functions.scores import hub_scale
from ..runtime import numbered, small_side, stored


#: Vectors in a block of a similarity join: two blocks and their product stay within a task's memory.
BLOCK = 4096


def prepared(docs: DataFrame) -> DataFrame:
    """corpus_id, ord, document_index, title, body of the documents that have a text; no title gives ``doc_<index>``."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    title = F.when(strip(F.col("title")) == "", F.concat(F.lit("doc_"), F.coalesce(F.col("document_index").cast("string"), F.lit("0")))).otherwise(strip(F.col("title")))
    rows = docs.select("corpus_id", F.col("doc_id").alias("ord"), "document_index", title.alias("title"), strip(F.col("text")).alias("body"))
    return rows.filter(F.col("corpus_id").isNotNull() & (F.col("body") != ""))


def chunks(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per chunk: a whole document, or windows of its words."""
    rows = prepared(docs)
    if config.use_paragraph_as_chunk:
        cut = rows.withColumn("chunk_index", F.lit(0))
    else:
        cut = rows.select("corpus_id", "ord", "document_index", "title", F.posexplode(X.windows(F.col("body"), config.chunk_size_words, config.chunk_overlap_words)).alias("chunk_index", "body"))
    return cut.select("corpus_id", "ord", "document_index", "title", "chunk_index", X.node_id("chunk", F.col("title"), F.col("chunk_index")).alias("chunk_id"), "body", F.concat("title", F.lit("\n"), "body").alias("text"))


def sentences(chunked: DataFrame) -> DataFrame:
    """One row per sentence of a chunk, with its entities and facts."""
    split = chunked.select("corpus_id", "ord", "document_index", "title", "chunk_index", "chunk_id", F.posexplode(X.sentences(F.col("body"))).alias("sentence_index", "text"))
    with_id = split.withColumn("sentence_id", X.node_id("sentence", F.col("title"), F.col("chunk_index"), F.col("sentence_index"), F.substring("text", 1, 80)))
    found = with_id.withColumn("entities", X.regex_entities(F.col("text")))
    return found.withColumn("triples", X.regex_triples(F.col("entities")))


def mentions(split: DataFrame) -> DataFrame:
    """One row per entity mention of a sentence, with the entity's id."""
    rows = split.select("corpus_id", "ord", "chunk_id", "sentence_id", "sentence_index", F.posexplode("entities").alias("place", "entity"))
    return rows.withColumn("entity_id", X.node_id("entity", F.col("entity")))


def entities(mentioned: DataFrame) -> DataFrame:
    """entity_id with the text of its first mention and the number of mentions."""
    order = F.struct("ord", "sentence_index", "place")
    return mentioned.groupBy("corpus_id", "entity_id").agg(F.min_by("entity", order).alias("text"), F.count("*").alias("mentions"))


def facts(split: DataFrame) -> DataFrame:
    """One row per fact of a sentence."""
    rows = split.select("corpus_id", "ord", "document_index", "title", "chunk_id", "sentence_id", "sentence_index", F.posexplode("triples").alias("fact_index", "t"))
    head, relation, tail = F.col("t.head"), F.col("t.relation"), F.col("t.tail")
    return rows.select(
        "corpus_id", "ord", "document_index", "title", "chunk_id", "sentence_id", "sentence_index", "fact_index",
        X.node_id("fact", head, relation, tail, F.col("sentence_id")).alias("fact_id"), F.concat_ws(" ", head, relation, tail).alias("text"),
        head.alias("head"), relation.alias("relation"), tail.alias("tail"), F.col("t.confidence").alias("confidence"), F.col("t.extractor").alias("extractor"),
        X.node_id("entity", head).alias("head_id"), X.node_id("entity", tail).alias("tail_id"),
    )


def _both_ways(rows: DataFrame, a: str, b: str, kind: str) -> list[DataFrame]:
    """The edges of rows in both directions, from one reading of them."""
    way = lambda x, y, step: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(step).alias("step"))
    made = rows.select("corpus_id", "ord", F.explode(F.array(way(a, b, 0), way(b, a, 1))).alias("e"))
    return [made.select("corpus_id", "e.src", "e.dst", F.lit(1.0).alias("weight"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("relation"), "ord", "e.step")]


def raw_edges(split: DataFrame, mentioned: DataFrame, known: DataFrame, sentence_layer: bool = True) -> DataFrame:
    """All edges as they arise, before those between the same two nodes are merged."""
    order = Window.partitionBy("corpus_id", "ord", "chunk_id").orderBy("sentence_index")
    parts: list[DataFrame] = []
    relation = known.select("corpus_id", F.col("head_id").alias("src"), F.col("tail_id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("entity_relation").alias("kind"), "relation", "ord", F.lit(6).alias("step"))
    ends = known.select("corpus_id", "ord", "chunk_id", "sentence_id", F.explode(F.array("head_id", "tail_id")).alias("entity_id"))
    if sentence_layer:
        parts += _both_ways(split, "sentence_id", "chunk_id", "sentence_chunk")
        row = split.select("corpus_id", "ord", "sentence_id", F.lag("sentence_id").over(order).alias("before")).filter("before is not null")
        parts += _both_ways(row, "before", "sentence_id", "sentence_sequence")
        parts += _both_ways(mentioned, "entity_id", "sentence_id", "entity_sentence") + _both_ways(ends, "entity_id", "sentence_id", "entity_sentence")
    else:
        parts += _both_ways(mentioned, "entity_id", "chunk_id", "entity_chunk") + _both_ways(ends, "entity_id", "chunk_id", "entity_chunk")
    return reduce(DataFrame.union, [*parts, relation])


def raw_similarity(named: DataFrame, encode, config: Config = Config()) -> DataFrame:
    """The edges between entities of one corpus whose vectors are alike; they arise after all others."""
    vectors = stored(named.select("corpus_id", F.col("entity_id").alias("id"), encode("text").alias("vec")))
    hits = stored(similarity_edges(vectors, config.entity_similarity_threshold, config.entity_similarity_top_k))
    one = lambda x, y, step: hits.select("corpus_id", F.col(x).alias("src"), F.col(y).alias("dst"), F.col("cosine").alias("weight"), F.lit("entity_similarity").alias("kind"), F.lit(None).cast("string").alias("relation"), F.lit(2**63 - 1).alias("ord"), F.lit(step).alias("step"))
    return one("src", "dst", 9).union(one("dst", "src", 10))


def all_edges(split: DataFrame, mentioned: DataFrame, known: DataFrame, named: DataFrame, config: Config = Config(), encode=None) -> DataFrame:
    """The merged edges of an index; those between similar entities need an encoder."""
    raw = raw_edges(split, mentioned, known, config.enable_sentence_layer)
    if encode is not None and config.enable_entity_similarity_edges:
        raw = raw.union(raw_similarity(named, encode, config))
    return merged_edges(raw)


#: Kinds between two entities; all other pairs of nodes have edges of one kind only, which their types decide.
BETWEEN_ENTITIES = ("entity_relation", "entity_similarity")
_KINDS = ("entity_chunk", "entity_sentence", "sentence_chunk", "sentence_sequence")


def merged_edges(raw: DataFrame) -> DataFrame:
    """One row per (src, dst): weights summed, kinds and relations as sorted sets, the first kind as type.

    Only pairs of entities can have several kinds, or relations: they are few and aggregate into sets. For all others a
    sum and a number are enough, so they reduce by hash on the map side.
    """
    kind = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    plain = raw.filter(~F.col("kind").isin(*BETWEEN_ENTITIES)).groupBy("corpus_id", "src", "dst").agg(F.sum("weight").alias("weight"), F.min(kind.cast("int")).alias("k"))
    name = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("k"))
    plain = plain.select("corpus_id", "src", "dst", "weight", name.alias("edge_type"), F.array(name).alias("edge_kinds"), F.array().cast("array<string>").alias("relations"))
    rich = raw.filter(F.col("kind").isin(*BETWEEN_ENTITIES)).groupBy("corpus_id", "src", "dst").agg(
        F.sum("weight").alias("weight"), F.min_by("kind", F.struct("ord", "step")).alias("edge_type"),
        F.sort_array(F.collect_set("kind")).alias("edge_kinds"), F.sort_array(F.collect_set("relation")).alias("relations"),
    )
    return plain.union(rich)


def degrees(edges: DataFrame) -> DataFrame:
    """corpus_id, node_id, degree: edges in and out; a loop counts twice."""
    ends = edges.select("corpus_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("corpus_id", "node_id").agg(F.count("*").alias("degree"))


def nodes(chunked: DataFrame, split: DataFrame, named: DataFrame, sentence_layer: bool = True) -> DataFrame:
    """corpus_id, node_id, node_type, chunk_id, title, text; of nodes that share an id the last stays."""
    c = chunked.groupBy("corpus_id", F.col("chunk_id").alias("node_id")).agg(F.lit("chunk").alias("node_type"), F.max_by(F.struct("chunk_id", "title", "text"), F.struct("ord", "chunk_index")).alias("n"))
    s = split.groupBy("corpus_id", F.col("sentence_id").alias("node_id")).agg(F.lit("sentence").alias("node_type"), F.max_by(F.struct("chunk_id", "title", "text"), F.struct("ord", "sentence_index")).alias("n"))
    parts = [x.select("corpus_id", "node_id", "node_type", "n.chunk_id", "n.title", "n.text") for x in ([c, s] if sentence_layer else [c])]
    e = named.select("corpus_id", F.col("entity_id").alias("node_id"), F.lit("entity").alias("node_type"), F.lit(None).cast("string").alias("chunk_id"), F.lit("").alias("title"), "text")
    return reduce(DataFrame.union, [*parts, e])


def chunk_counts(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """corpus_id, entity_id, chunk_count: distinct chunks next to an entity, through its sentences or directly; at least 1."""
    homes = node_table.filter("node_type <> 'entity'").select("corpus_id", F.col("node_id").alias("near"), "chunk_id")
    ends = edges.select("corpus_id", F.col("src").alias("node_id"), F.col("dst").alias("near")).union(edges.select("corpus_id", "dst", "src")).distinct()
    own = node_table.filter("node_type = 'entity'").select("corpus_id", "node_id")
    seen = ends.join(own, ["corpus_id", "node_id"], "left_semi").join(homes, ["corpus_id", "near"]).select("corpus_id", "node_id", "chunk_id").distinct()
    counts = seen.groupBy("corpus_id", "node_id").agg(F.count("*").alias("n"))
    return own.join(counts, ["corpus_id", "node_id"], "left").select("corpus_id", F.col("node_id").alias("entity_id"), F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("chunk_count"))


def build(docs: DataFrame, config: Config = Config(), encode=None) -> dict[str, DataFrame]:
    """All index tables of the corpora in ``docs``; ``encode`` makes the vectors that edges between similar entities need."""
    chunked = chunks(docs, config)
    split = stored(sentences(chunked))
    mentioned, known = stored(mentions(split)), stored(facts(split))  # ids are made once for all that reads them
    # a name among a fact's ends is a mention of its sentence already
    named = entities(mentioned)
    edges = all_edges(split, mentioned, known, named, config, encode)
    table = nodes(chunked, split, named, config.enable_sentence_layer)
    return {"chunks": chunked, "sentences": split, "mentions": mentioned, "entities": named, "facts": known, "edges": edges, "nodes": table}


def materialised(index: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """The index with its tables, or those named, written once to the shared folder, for plans that read them many times."""
    return {k: stored(v) if not names or k in names else v for k, v in index.items()}


def without_sentences(index: dict[str, DataFrame], compensate: bool = True) -> dict[str, DataFrame]:
    """The index with its sentence layer taken out; ``compensate`` links fact ends to their chunks instead."""
    sentence = index["nodes"].filter("node_type = 'sentence'").select("corpus_id", "node_id")
    edges = index["edges"]
    for end in ("src", "dst"):
        edges = edges.join(sentence.withColumnRenamed("node_id", end), ["corpus_id", end], "left_anti").select("corpus_id", "src", "dst", "weight", "edge_type", "edge_kinds", "relations")
    if compensate:
        ends = index["facts"].select("corpus_id", "ord", "chunk_id", F.explode(F.array("head_id", "tail_id")).alias("entity_id"))
        more = merged_edges(reduce(DataFrame.union, _both_ways(ends, "entity_id", "chunk_id", "entity_chunk")))
        edges = edges.union(more)
    return {**index, "edges": edges, "nodes": index["nodes"].filter("node_type <> 'sentence'"), "facts": index["facts"].withColumn("sentence_id", F.lit(""))}


# ---- propagation ----------------------------------------------------------------------------------------------------

#: Node types as numbers, in the order of the shares of a question (fact, sentence, chunk).
TYPES = ("entity", "sentence", "chunk")


def _factor(config: Config) -> Column:
    """The factor of an edge: the largest of its kinds'."""
    return F.array_max(F.transform("edge_kinds", lambda k: reduce(lambda a, kv: F.when(k == kv[0], kv[1]).otherwise(a), config.edge_type_weights.items(), F.lit(1.0))))


def _code(column: str = "node_type") -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), F.col(column)).cast("tinyint")


def walk(edges: DataFrame, node_table: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """What propagation needs of an index, for all questions: ``nodes`` (corpus_id, h, node_id, type, home) and ``links``
    (corpus_id, s, d, weight, factor, both), edges between hashes of ids with the factor of their kinds; those with ``both`` are
    two edges, one either way. ``apart``: the edges and nodes of some corpora as tables, for propagation by joins."""
    home = F.col("chunk_id") if "chunk_id" in node_table.columns else F.lit(None).cast("string")
    nodes = node_table.select("corpus_id", F.xxhash64("node_id").alias("h"), "node_id", _code().alias("type"), home.alias("home"))
    links = edges.select("corpus_id", F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"), F.col("weight").cast("double").alias("weight"), _factor(config).cast("double").alias("factor"), F.lit(False).alias("both"))
    return {"nodes": nodes, "links": links, "apart": lambda keep: (keep(edges), keep(node_table))}


def lean(docs: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """The tables of an index that propagation over it needs, as ``build`` has them but for texts; its edges are not merged
    in tables: ``walked`` gives them to ``pagerank`` as they arise, which merges those of a corpus in its task."""
    chunked = chunks(docs, config)
    split = stored(sentences(chunked))
    mentioned = stored(mentions(split))
    known = facts(split)
    named = stored(entities(mentioned))
    return {"chunks": chunked, "sentences": split, "mentions": mentioned, "entities": named, "facts": known}


def walked(index: dict[str, DataFrame], config: Config = Config()) -> dict[str, DataFrame]:
    """``walk`` of an index (``lean``) with its sentence layer, from its sentences, mentions and facts."""
    split, mentioned, known = index["sentences"], index["mentions"], index["facts"]
    last = lambda rows, i, *order: rows.groupBy("corpus_id", F.col(i).alias("node_id")).agg(F.max_by("chunk_id", F.struct(*order)).alias("home"))
    inner = last(split, "sentence_id", "ord", "sentence_index").select("corpus_id", "node_id", F.lit(2).cast("tinyint").alias("type"), "home")
    outer = index["chunks"].select("corpus_id", F.col("chunk_id").alias("node_id"), F.lit(3).cast("tinyint").alias("type"), F.col("chunk_id").alias("home")).distinct()
    name = index["entities"].select("corpus_id", F.col("entity_id").alias("node_id"), F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("string").alias("home"))
    nodes = stored(inner.union(outer).union(name).select("corpus_id", F.xxhash64("node_id").alias("h"), "node_id", "type", "home"))
    factor = config.edge_type_weights

    def pairs(rows: DataFrame, a: str, b: str, kind: str, both: bool = True) -> DataFrame:
        return rows.select("corpus_id", F.xxhash64(a).alias("s"), F.xxhash64(b).alias("d"), F.lit(1.0).alias("weight"), F.lit(float(factor.get(kind, 1.0))).alias("factor"), F.lit(both).alias("both"))

    order = Window.partitionBy("corpus_id", "ord", "chunk_id").orderBy("sentence_index")
    row = split.select("corpus_id", "ord", "chunk_id", "sentence_index", "sentence_id").withColumn("before", F.lag("sentence_id").over(order)).filter("before is not null")
    ends = known.select("corpus_id", "sentence_id", "head_id", "tail_id")
    links = [pairs(split, "sentence_id", "chunk_id", "sentence_chunk"), pairs(row, "before", "sentence_id", "sentence_sequence"), pairs(mentioned, "entity_id", "sentence_id", "entity_sentence")]
    links += [pairs(ends.select("corpus_id", "sentence_id", F.explode(F.array("head_id", "tail_id")).alias("end")), "end", "sentence_id", "entity_sentence"), pairs(ends, "head_id", "tail_id", "entity_relation", False)]

    def apart(keep):
        raw = raw_edges(keep(split), keep(mentioned), keep(known))
        return merged_edges(raw), keep(nodes).select("corpus_id", "node_id", F.element_at(F.array(*map(F.lit, TYPES)), F.col("type").cast("int")).alias("node_type"), F.col("home").alias("chunk_id"))

    return {"nodes": nodes, "links": reduce(DataFrame.union, links), "apart": apart}


def entity_chunks(split: DataFrame, mentioned: DataFrame) -> DataFrame:
    """``chunk_counts`` from sentences and mentions: an entity is next to the sentences that mention it, and a sentence id
    that several chunks share belongs to the last."""
    homes = split.groupBy("corpus_id", "sentence_id").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b"), F.max_by("chunk_id", F.struct("ord", "sentence_index")).alias("home"))
    shared = stored(homes.filter("a <> b").select("corpus_id", "sentence_id", "home"))
    seen = mentioned.select("corpus_id", "entity_id", "sentence_id", "chunk_id").join(small_side(shared), ["corpus_id", "sentence_id"], "left")
    pairs = seen.select("corpus_id", "entity_id", F.coalesce("home", "chunk_id").alias("chunk_id")).distinct()
    return pairs.groupBy("corpus_id", "entity_id").agg(F.count("*").alias("chunk_count"))


def entity_degrees(mentioned: DataFrame, known: DataFrame) -> DataFrame:
    """``degrees`` of entities from mentions and facts: two edges for each sentence, one at each end of a pair of a fact."""
    near = mentioned.select("corpus_id", "entity_id", "sentence_id").distinct().select("corpus_id", F.col("entity_id").alias("node_id"), F.lit(2).alias("n"))
    pairs = known.select("corpus_id", "head_id", "tail_id").distinct().select("corpus_id", F.explode(F.array("head_id", "tail_id")).alias("node_id"), F.lit(1).alias("n"))
    return near.union(pairs).groupBy("corpus_id", "node_id").agg(F.sum("n").alias("degree"))


def numbered_walk(edges: DataFrame, node_table: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """What propagation by joins needs of an index, once for all questions: ``nodes`` (corpus_id, node_id, nid, type), numbered,
    and ``links`` (corpus_id, s, d, st, dt, there, back) between numbered nodes.

    A link is an ordered pair of nodes that an edge joins in either direction, with the part of the edges' weights that
    no question changes: weight times the factor of its kind, damped by the degree of the edge's end. What depends on a
    question is made on the fly, so no table of questions times edges is ever written.
    """
    ids = stored(numbered(node_table.select("corpus_id", "node_id", _code().alias("type")), "nid"))
    end = lambda name, n, t: ids.select("corpus_id", F.col("node_id").alias(name), F.col("nid").alias(n), F.col("type").alias(t))
    rows = edges.select("corpus_id", "src", "dst", (F.col("weight") * _factor(config)).alias("weight")).join(end("src", "s", "st"), ["corpus_id", "src"]).join(end("dst", "d", "dt"), ["corpus_id", "dst"])
    rows = stored(rows.select("corpus_id", "s", "d", "st", "dt", "weight"))
    degree = rows.select(F.explode(F.array("s", "d")).alias("d")).groupBy("d").agg(F.count("*").alias("degree"))
    base = rows.join(degree, "d").select("corpus_id", "s", "d", "st", "dt", (F.col("weight") * hub_scale(F.col("degree"), config.hub_penalty)).alias("base"))
    there = base.select("corpus_id", "s", "d", "st", "dt", F.col("base").alias("there"), F.lit(0.0).alias("back"))
    back = base.select("corpus_id", F.col("d").alias("s"), F.col("s").alias("d"), F.col("dt").alias("st"), F.col("st").alias("dt"), F.lit(0.0), F.col("base"))
    links = there.union(back).groupBy("corpus_id", "s", "d", "st", "dt").agg(F.max("there").alias("there"), F.max("back").alias("back")).filter("there > 0 or back > 0")
    return {"nodes": ids, "links": stored(links)}


def _weight(config: Config) -> Column:
    """A link's weight for a question: it rises with the question's share of the target's type; of both ways the larger holds."""
    lam = config.transition_lambda if config.enable_granularity_awareness and config.enable_granularity_pagerank_bias else 0.0
    rise = lambda t: 1 + lam * F.coalesce(F.get(F.col("shares"), F.col(t) - 1), F.lit(0.0))
    return F.greatest(F.col("there") * rise("dt"), F.col("back") * rise("st"))


#: Edges of a corpus that a task may hold (about 100 bytes each), questions that are worth a task, tasks of a corpus.
HELD_EDGES, QUESTIONS, TASKS = 8_000_000, 32, 12


def pagerank(walked: dict[str, DataFrame], queries: DataFrame, seeds: DataFrame, config: Config = Config(), iterations: int | None = None, emit: str = "all", top: int = 0) -> DataFrame:
    """query_id, node_id, score, iterations, converged: personalised PageRank of every question (query_id, corpus_id,
    alpha) at once, with restarts at its ``seeds`` (query_id, node_id, score) and a floor at every node of its corpus.

    Starts uniform; nodes without links send their mass along the restart distribution; a question stops when its total
    change is under its node count times the tolerance. ``iterations`` fixes their number instead. At
    ``pagerank_max_iter`` the last scores come out, marked as not converged.

    A corpus with a block of its questions is one task that holds the corpus's links as arrays, so no score of a step
    leaves it; corpora of more than ``HELD_EDGES`` edges, or with two ids of one hash, go by joins (``joined_pagerank``).
    ``emit`` is what comes out: ``all`` nodes; ``top``: those of the ``top`` highest scores, and all that might tie
    with them when rounded to 9 places; ``sentence``: sentences; ``passages``: query_id, chunk_id and the sums that
    ``passage_sums`` forms.
    """
    kind = dict(queries.dtypes)["query_id"]
    q = stored(queries.filter("corpus_id is not null").select("query_id", "corpus_id", F.array("alpha.fact", "alpha.sentence", "alpha.chunk").alias("shares")))
    corpora = q.groupBy("corpus_id").agg(F.least(F.lit(TASKS), F.ceil(F.count("*") / QUESTIONS)).cast("int").alias("blocks"))
    sized = stored(corpora.join(walked["links"].groupBy("corpus_id").agg(F.count("*").alias("edges")), "corpus_id", "left"))
    same = walked["nodes"].join(small_side(sized.select("corpus_id")), "corpus_id").groupBy("corpus_id").agg((F.count("*") > F.countDistinct("h")).alias("same"))
    sized = stored(sized.join(same, "corpus_id", "left").select("corpus_id", "blocks", (F.coalesce("same", F.lit(False)) | (F.coalesce("edges", F.lit(0)) > HELD_EDGES)).alias("apart")))
    near = small_side(stored(sized.filter("not apart").select("corpus_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))))
    given = seeds.groupBy("query_id", "node_id").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("given")).groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("node_id").alias("h"), "given")).alias("given"))
    asked = q.join(small_side(sized.filter("not apart")), "corpus_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).join(given, "query_id", "left").select("corpus_id", "block", "query_id", "shares", "given")
    none = lambda t: F.lit(None).cast(t)
    graph = walked["nodes"].select("corpus_id", "h", none("long").alias("d"), none("double").alias("weight"), none("double").alias("factor"), none("boolean").alias("both"), "node_id", "type", "home").union(walked["links"].select("corpus_id", "s", "d", "weight", "factor", "both", none("string"), none("tinyint"), none("string")))
    graph = graph.join(near, "corpus_id")
    out = "chunk_id string, own double, inner_sum double, through double" if emit == "passages" else "node_id string, score double, iterations int, converged boolean"
    ranks = graph.groupBy("corpus_id", "block").cogroup(asked.groupBy("corpus_id", "block")).applyInArrow(_ranker(config, iterations, emit, top, kind), f"query_id {kind}, {out}")
    apart = sized.filter("apart").select("corpus_id")
    if apart.isEmpty():
        return ranks
    few = lambda rows: rows.join(small_side(apart), "corpus_id", "left_semi")
    edges, node_table = walked["apart"](few)
    rest = joined_pagerank(numbered_walk(edges, node_table, config), few(queries), seeds, config, iterations)
    if emit == "passages":
        return ranks.union(passage_sums(rest, edges, node_table, few(queries), config))
    return ranks.union(rest.filter(F.col("node_id").startswith("sentence:")) if emit == "sentence" else rest)


def _ranker(config: Config, iterations: int | None, emit: str, top: int, kind: str):
    """The function of ``pagerank`` on one corpus and a block of its questions."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lam = config.transition_lambda if config.enable_granularity_awareness and config.enable_granularity_pagerank_bias else 0.0
    penalty, floor, damp, tolerance, most = config.hub_penalty, config.seed_floor, config.pagerank_alpha, config.pagerank_tolerance, iterations or config.pagerank_max_iter
    near_type = 2 if config.enable_sentence_layer else 3
    names = ["query_id", "chunk_id", "own", "inner_sum", "through"] if emit == "passages" else ["query_id", "node_id", "score", "iterations", "converged"]
    types = [pa.string(), pa.float64(), pa.float64(), pa.float64()] if emit == "passages" else [pa.string(), pa.float64(), pa.int32(), pa.bool_()]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema(list(zip(names, [asked.schema.field("query_id").type, *types])))
        is_node = pc.is_null(rows["d"])
        own, ties = rows.filter(is_node).select(["h", "node_id", "type", "home"]), rows.filter(pc.invert(is_node)).select(["h", "d", "weight", "factor", "both"])
        n = own.num_rows
        if not n or not asked.num_rows:
            return schema.empty_table()
        h = own["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        own, h = own.take(pa.array(order)), h[order]
        kinds = own["type"].to_numpy().astype(np.int64)
        s, d, weight, factor, both = (ties[c].to_numpy() for c in ("h", "d", "weight", "factor", "both"))
        i, j = (np.minimum(np.searchsorted(h, x), n - 1) for x in (s, d))
        there = (h[i] == s) & (h[j] == d)
        turned = there & both.astype(bool)
        pairs, at = np.unique(np.concatenate((i[there] * n + j[there], j[turned] * n + i[turned])), return_inverse=True)
        most_of = np.zeros(len(pairs))
        np.maximum.at(most_of, at, np.concatenate((factor[there], factor[turned])))
        weight = np.bincount(at, np.concatenate((weight[there], weight[turned])), len(pairs)) * most_of
        s, d = pairs // n, pairs % n
        del i, j, there, turned, pairs, at, most_of
        degree = np.bincount(s, minlength=n) + np.bincount(d, minlength=n)
        base = weight / (1 + penalty * np.log1p(degree))[d]
        keys, at = np.unique(np.concatenate((s * n + d, d * n + s)), return_inverse=True)
        go, back = np.zeros(len(keys)), np.zeros(len(keys))
        np.maximum.at(go, at[: len(s)], base)
        np.maximum.at(back, at[len(s) :], base)
        del at
        some = (go > 0) | (back > 0)
        keys, go, back = keys[some], go[some], back[some]
        a, b = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
        del keys
        if emit == "passages":
            told = own["home"].combine_chunks().dictionary_encode()
            told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
            home, homes = told.indices.fill_null(-1).to_numpy(zero_copy_only=False), told.dictionary
            is_chunk, is_inner = (np.nonzero((kinds == t) & (home >= 0))[0] for t in (3, 2))
            one, two = ((kinds[x] == 1) & (kinds[y] == near_type) & (home[y] >= 0) for x, y in ((s, d), (d, s)))
            giver, taker = np.concatenate((s[one], d[two])), home[np.concatenate((d[one], s[two]))]
        elif emit == "sentence":
            shown = np.nonzero(kinds == 2)[0]
            ids = own["node_id"].take(pa.array(shown)).combine_chunks()
        else:
            ids = own["node_id"].combine_chunks()
        ids = ids.chunk(0) if emit != "passages" and isinstance(ids, pa.ChunkedArray) else ids if emit != "passages" else None
        shares = np.array([[x or 0.0 for x in row] for row in asked["shares"].to_pylist()])
        made, last, parts = None, None, []
        for k in np.lexsort(shares.T):
            if last is None or (shares[k] != last).any():
                last = shares[k]
                rise = np.concatenate(([1.0], 1 + lam * last))
                made = np.maximum(go * rise[kinds[b]], back * rise[kinds[a]])
                out = np.bincount(a, weights=made, minlength=n)
                sends = out > 0
                share = made / out[a]
            r = np.full(n, floor)
            for seed in asked["given"][int(k)].as_py() or ():
                p = np.searchsorted(h, seed["h"])
                if p < n and h[p] == seed["h"]:
                    r[p] += seed["given"]
            r /= r.sum()
            x, settled = np.full(n, 1 / n), False
            for turn in range(1, most + 1):
                before = x
                x = damp * (np.bincount(b, weights=share * x[a], minlength=n) + x[~sends].sum() * r) + (1 - damp) * r
                if iterations is None and np.abs(x - before).sum() < n * tolerance:
                    settled = True
                    break
            who = asked["query_id"].slice(int(k), 1).combine_chunks()
            who = who.chunk(0) if isinstance(who, pa.ChunkedArray) else who
            if emit == "passages":
                sums = (np.bincount(home[is_chunk], x[is_chunk], len(homes)), np.bincount(home[is_inner], x[is_inner], len(homes)), np.bincount(taker, x[giver], len(homes)))
                columns, size = [homes, *map(pa.array, sums)], len(homes)
            else:
                named = ids
                if emit == "sentence":
                    x = x[shown]
                elif emit == "top" and n > top:
                    best = np.nonzero(x >= np.partition(x, n - top)[n - top] - 1e-8)[0]
                    x, named = x[best], ids.take(pa.array(best))
                size = len(x)
                columns = [named, pa.array(x), pa.array(np.full(size, turn, np.int32)), pa.array(np.full(size, settled))]
            parts.append(pa.Table.from_arrays([who.take(pa.array(np.zeros(size, np.int64))), *columns], schema=schema))
        return pa.concat_tables(parts)

    return run


def passage_sums(ranks: DataFrame, edges: DataFrame, node_table: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, chunk_id, own, inner_sum, through: of ``ranks``, a chunk's own score, the sum of its sentences' and that of
    entities', once per edge, in either direction, to one of its sentences (without a sentence layer, to the chunk)."""
    q = small_side(queries.select("query_id", "corpus_id"))
    placed = ranks.join(q, "query_id").join(node_table.select("corpus_id", "node_id", "node_type", "chunk_id"), ["corpus_id", "node_id"])
    zero = F.lit(0.0)
    own = placed.filter("node_type = 'chunk'").select("query_id", "chunk_id", F.col("score").alias("own"), zero.alias("inner_sum"), zero.alias("through"))
    inner = placed.filter("node_type = 'sentence'").select("query_id", "chunk_id", zero, "score", zero)
    home_type = "sentence" if config.enable_sentence_layer else "chunk"
    e = edges.select("corpus_id", "src", "dst")
    homes = node_table.filter(F.col("node_type") == home_type).select("corpus_id", F.col("node_id").alias("near"), F.col("chunk_id").alias("home"))
    touch = e.select("corpus_id", F.col("src").alias("node_id"), F.col("dst").alias("near")).union(e.select("corpus_id", "dst", "src")).join(homes, ["corpus_id", "near"]).groupBy("corpus_id", "node_id", "home").agg(F.count("*").alias("times"))
    through = placed.filter("node_type = 'entity'").drop("chunk_id").join(touch, ["corpus_id", "node_id"]).select("query_id", F.col("home").alias("chunk_id"), zero, zero, F.col("score") * F.col("times"))
    return own.union(inner).union(through).groupBy("query_id", "chunk_id").agg(*[F.sum(c).alias(c) for c in ("own", "inner_sum", "through")])


def joined_pagerank(walked: dict[str, DataFrame], queries: DataFrame, seeds: DataFrame, config: Config = Config(), iterations: int | None = None) -> DataFrame:
    """``pagerank`` by joins, for corpora that no task can hold. A step is one join of numbers on the link's source and one
    partial aggregation; questions that settle keep their scores while others go on; scores are written to the shared
    folder, which cuts the lineage.
    """
    nodes, links = walked["nodes"], walked["links"]
    q = small_side(stored(queries.select("query_id", "corpus_id", F.array("alpha.fact", "alpha.sentence", "alpha.chunk").alias("shares"))))
    placed = seeds.join(q.select("query_id", "corpus_id"), "query_id").join(nodes.select("corpus_id", "node_id", "nid"), ["corpus_id", "node_id"])
    given = placed.groupBy("query_id", "nid").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("given"))
    mass = nodes.select("corpus_id", "nid").join(q, "corpus_id").join(given, ["query_id", "nid"], "left").withColumn("r", config.seed_floor + F.coalesce("given", F.lit(0.0)))
    totals = links.join(q, "corpus_id").groupBy("query_id", F.col("s").alias("nid")).agg(F.sum(_weight(config)).alias("out"))
    mass = stored(mass.join(totals, ["query_id", "nid"], "left").select("query_id", "shares", "nid", "r", "out"))
    sizes = mass.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("r").alias("t"))
    base = mass.join(small_side(stored(sizes)), "query_id").select("query_id", "shares", "nid", "n", (F.col("r") / F.col("t")).alias("r"), "out")
    state = stored(base.withColumn("score", 1 / F.col("n")))
    d, done = config.pagerank_alpha, []
    most = iterations or config.pagerank_max_iter

    def result(rows: DataFrame, turn: int, converged: bool) -> DataFrame:
        return rows.select("query_id", "nid", "score", F.lit(turn).alias("iterations"), F.lit(converged).alias("converged"))

    def named() -> DataFrame:
        return reduce(DataFrame.union, done).join(nodes.select("nid", "node_id"), "nid").select("query_id", "node_id", "score", "iterations", "converged")

    for turn in range(1, most + 1):
        sent = state.filter("out > 0").select("query_id", "shares", F.col("nid").alias("s"), (F.col("score") / F.col("out")).alias("each"))
        flow = links.join(sent, "s").groupBy("query_id", F.col("d").alias("nid")).agg(F.sum(_weight(config) * F.col("each")).alias("in"))
        lost = state.groupBy("query_id").agg(F.sum(F.when(F.col("out") > 0, 0.0).otherwise(F.col("score"))).alias("lost"))
        after = state.join(flow, ["query_id", "nid"], "left").join(small_side(lost), "query_id")
        moved = after.select("query_id", "shares", "nid", "n", "r", "out", F.col("score").alias("before"), (d * (F.coalesce("in", F.lit(0.0)) + F.col("lost") * F.col("r")) + (1 - d) * F.col("r")).alias("score"))
        state = stored(moved)
        if iterations is None:
            change = stored(state.groupBy("query_id").agg((F.sum(F.abs(F.col("score") - F.col("before"))) < F.first("n") * config.pagerank_tolerance).alias("still")))
            settled, others = change.filter("still"), change.filter("not still")
            if others.isEmpty():
                done.append(result(state, turn, True))
                return named()
            if not settled.isEmpty():
                done.append(result(state.join(small_side(settled), "query_id", "left_semi"), turn, True))
                state = state.join(small_side(others), "query_id", "left_semi")
    done.append(result(state, most, False))
    return named()


def similarity_edges(vectors: DataFrame, threshold: float, top_k: int = Config().entity_similarity_top_k) -> DataFrame:
    """src, dst, cosine: pairs of vectors at ``threshold`` or above, at most ``top_k`` per source; with a column
    ``corpus_id``, which then comes out too, pairs are those of one corpus, in as many blocks as its size calls for.

    Vectors (id, vec) are dealt into blocks; each pair of blocks is one matrix product, and only its hits leave it, so
    no pair of rows is ever materialised. The work is quadratic in the number of vectors, as the definition is.
    """
    import numpy as np
    import pandas as pd

    by = [c for c in vectors.columns if c == "corpus_id"]
    given = vectors.filter("vec is not null")
    size = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    if by:
        given = given.join(small_side(given.groupBy(*by).agg(size)), by)
    else:
        given = given.withColumn("blocks", F.lit(max(2, given.agg(size).first()[0])))
    dealt = given.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select(*by, F.col("b").alias("x"), F.col("o").alias("y"), "id", "vec")
    right = dealt.select(*(F.col(c).alias(c) for c in by), F.col("o").alias("x"), F.col("b").alias("y"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (*by, "src", "dst", "cosine")})
        m, n = np.stack(a["vec"]).astype(np.float64), np.stack(b["vec"]).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-8
        n /= np.linalg.norm(n, axis=1, keepdims=True) + 1e-8
        s = m @ n.T
        i, j = np.nonzero(s >= threshold)
        return pd.DataFrame({**{c: [a[c].iloc[0]] * len(i) for c in by}, "src": a["id"].to_numpy()[i], "dst": b["id"].to_numpy()[j], "cosine": s[i, j]})

    kind = dict(vectors.dtypes)["id"]
    keys = [*by, "x", "y"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, ", ".join([*(f"{c} string" for c in by), f"src {kind}, dst {kind}, cosine double"])).filter("src <> dst")
    rank = F.row_number().over(Window.partitionBy(*by, "src").orderBy(F.desc("cosine"), "dst"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= top_k).select(*by, "src", "dst", "cosine")


def similarity_weights(hits: DataFrame) -> DataFrame:
    """src, dst, weight of the edges that similar entities get: each hit counts in both directions."""
    both = hits.union(hits.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine"))
    return both.groupBy("src", "dst").agg(F.sum("cosine").alias("weight"))


def typed(column: Column) -> Column:
    """The node type that an id's prefix names."""
    return F.substring_index(column, ":", 1)
