"""The SQL that DuckDB runs beside the core queries, put together from shared common table expressions."""

from __future__ import annotations

from ..config import Config
from ..functions import text as X

C = Config()
WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words_list(items) -> str:
    return "[" + ",".join("'" + x + "'" for x in items) + "]"


def strip(t: str) -> str:
    return f"regexp_replace(coalesce({t},''),'^{WS}+|{WS}+$','','g')"


def spaced(t: str) -> str:
    return f"trim(regexp_replace({t},'{WS}+',' ','g'))"


def words(t: str) -> str:
    return f"list_filter(string_split({spaced(f'coalesce({t},{chr(39) * 2})')},' '), lambda w: w<>'')"


def node_id(prefix: str, *parts: str) -> str:
    joined = "||'||'||".join(strip(f"cast({p} as varchar)") for p in parts)
    clean = f"left(lower(trim(regexp_replace({joined},'[^a-zA-Z0-9]+','_','g'),'_')),120)"
    return f"'{prefix}:'||(case when {clean}='' then 'node' else {clean} end)"


def split(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({spaced(t)},'([.!?]) +([A-Z0-9\"''])','\\1'||chr(1)||'\\2','g'),chr(1)), lambda s: trim(s)<>'')"


def overlap_terms(t: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t},'')),'[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t)>2))"


def overlap(q: str, t: str) -> str:
    return f"(case when len({overlap_terms(q)})>0 then len(list_intersect({overlap_terms(q)},{overlap_terms(t)}))/len({overlap_terms(q)})::double else 0.0 end)"


def content_terms(t: str, stop=X.CONTENT_STOPWORDS) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t},'')),'[A-Za-z0-9'']+'), lambda t: length(t)>2 and not list_contains({words_list(stop)},t)))"


def coverage(q: str, t: str) -> str:
    return f"(case when len({content_terms(q)})>0 then len(list_intersect({content_terms(q)},{content_terms(t)}))/len({content_terms(q)})::double else 0.0 end)"


def normal(t: str) -> str:
    low = f"regexp_replace(lower(coalesce({t},'')),'[!-/:-@\\[-`{{-~]','','g')"
    # RE2's \b is ASCII only, so articles are taken between characters that are no letters, digits or underscores
    return f"array_to_string(list_filter(string_split({spaced(low)},' '), lambda w: w not in ('a','an','the','')),' ')"


def alpha_sql(q: str) -> str:
    low = f"lower(coalesce({q},''))"
    case = lambda i: f"(case when regexp_matches({low},'summary|overview|background|context|describe') then {C.profile_alpha_priors['long_context'][i]} when regexp_matches({low},'employer|spouse|father|mother|after|before|whose|which') then {C.profile_alpha_priors['multi_hop'][i]} when regexp_matches({low},'who|when|where|name') then {C.profile_alpha_priors['single_hop'][i]} else {(0.4, 0.4, 0.2)[i]} end)"
    return f"{case(0)}::double af, {case(1)}::double as_, {case(2)}::double ac"


LEAD = words_list(sorted({*X.QUESTION_WORDS, *X.LIGHT_STOPWORDS}))
TRAIL = words_list(X.LIGHT_STOPWORDS)
PATTERN = X.ENTITY_PATTERN.replace("'", "''")


def entity_ctes(source: str, out: str, keys: str) -> str:
    """CTEs that take the rows (keys, text) of ``source`` to their distinct entities in order: keys, place, entity."""
    generic = "trim(regexp_replace(regexp_replace(lower(e),'[.\\-_/]+',' ','g'),'\\s+',' ','g'))"
    return f"""{out}_m as (select {keys}, unnest(regexp_extract_all(text,'{PATTERN}')) m, generate_subscripts(regexp_extract_all(text,'{PATTERN}'),1) k from {source}),
{out}_t as (select {keys}, k, regexp_extract_all(m,'[A-Za-z0-9][A-Za-z0-9''\\-]*') t from {out}_m),
{out}_f as (select *, coalesce(list_position(list_transform(t, lambda x: list_contains({LEAD},lower(x))),false),0) f from {out}_t),
{out}_k as (select {keys}, k, case when f>0 then t[f:] else []::varchar[] end t from {out}_f),
{out}_b as (select *, coalesce(list_position(list_transform(list_reverse(t), lambda x: list_contains({TRAIL},lower(x))),false),0) b from {out}_k),
{out}_e as (select {keys}, k, case when b>0 then array_to_string(t[:len(t)-b+1],' ') else '' end e from {out}_b),
{out}_n as (select {keys}, e, min(k) k from {out}_e where length(e)>=2 and not list_contains({words_list(X.GENERIC_TERMS)},{generic}) and {generic}<>'' and len(list_filter(string_split({generic},' '), lambda p: length(p)<>1))>0
 and not list_has_any(list_transform(string_split(e,' '), lambda x: lower(x)),{words_list(X.QUESTION_WORDS)})
 and (len(list_filter(string_split(e,' '), lambda x: regexp_matches(x,'^\\p{{Lu}}')))>0 or (len(string_split(e,' '))=1 and upper(e)=e and regexp_matches(e,'\\p{{Lu}}'))) group by all),
{out} as (select {keys}, row_number() over (partition by {keys} order by k)-1 place, e entity from {out}_n)"""


DOCS = f"""docs as (select corpus_id, doc_id ord, document_index, case when {strip('title')}='' then 'doc_'||coalesce(cast(document_index as varchar),'0') else {strip('title')} end title, {strip('text')} body from documents where corpus_id is not null and {strip('text')}<>'')"""
CHUNKS = f"""chunks as (select corpus_id, ord, title, body, {node_id('chunk', 'title', '0')} chunk_id from docs)"""
SENTS = f"""sents0 as (select corpus_id, ord, title, chunk_id, unnest({split('body')}) text, generate_subscripts({split('body')},1)-1 sentence_index from chunks),
sents as (select *, {node_id('sentence', 'title', '0', 'sentence_index', 'left(text,80)')} sentence_id from sents0)"""
MENTS = entity_ctes("sents", "ments0", "corpus_id, ord, chunk_id, sentence_id, sentence_index") + f""",
ments as (select *, {node_id('entity', 'entity')} entity_id from ments0)"""
FACTS = f"""pairs as (select *, lead(entity) over (partition by corpus_id, ord, chunk_id, sentence_id, sentence_index order by place) nxt from ments),
facts as (select corpus_id, ord, chunk_id, sentence_id, sentence_index, place fact_index, entity head, nxt tail, entity||' related_to '||nxt text, {node_id('entity', 'entity')} head_id, {node_id('entity', 'nxt')} tail_id, {node_id('fact', 'entity', chr(39) + 'related_to' + chr(39), 'nxt', 'sentence_id')} fact_id from pairs where nxt is not null and place<3)"""
ENTITIES = """entities as (select corpus_id, entity_id, arg_min(entity, struct_pack(a:=ord,b:=sentence_index,c:=place)) text, count(*) mentions from ments group by 1,2)"""


def _two(rows: str, a: str, b: str, kind: str) -> str:
    return f"select corpus_id,{a} src,{b} dst,'{kind}' kind,null::varchar relation,ord,0 step from {rows} union all select corpus_id,{b},{a},'{kind}',null,ord,1 from {rows}"


EDGES = f"""seq as (select corpus_id, ord, sentence_id, lag(sentence_id) over (partition by corpus_id, ord, chunk_id order by sentence_index) before from sents),
seq2 as (select * from seq where before is not null),
ends as (select corpus_id, ord, chunk_id, sentence_id, unnest([head_id,tail_id]) entity_id from facts),
raw as ({_two('sents', 'sentence_id', 'chunk_id', 'sentence_chunk')} union all {_two('seq2', 'before', 'sentence_id', 'sentence_sequence')} union all {_two('ments', 'entity_id', 'sentence_id', 'entity_sentence')} union all {_two('ends', 'entity_id', 'sentence_id', 'entity_sentence')}
 union all select corpus_id, head_id, tail_id, 'entity_relation', 'related_to', ord, 6 from facts),
edges as (select corpus_id, src, dst, count(*)::double weight, arg_min(kind, struct_pack(a:=ord,b:=step)) edge_type, list_sort(list_distinct(list(kind))) edge_kinds, list_sort(list_distinct(list(relation) filter (relation is not null))) relations from raw group by 1,2,3)"""
DEGREE = """degree as (select corpus_id, node_id, count(*) degree from (select corpus_id, src node_id from edges union all select corpus_id, dst from edges) group by 1,2)"""
NODES = """nodes as (select corpus_id, chunk_id node_id, 'chunk' node_type, chunk_id, arg_max(title, ord) title from chunks group by 1,2,4
 union all select corpus_id, sentence_id, 'sentence', arg_max(chunk_id, struct_pack(a:=ord,b:=sentence_index)), arg_max(title, struct_pack(a:=ord,b:=sentence_index)) from sents group by 1,2
 union all select corpus_id, entity_id, 'entity', null, '' from entities)"""
COUNTS = """touch0 as (select distinct corpus_id, node_id, near from (select corpus_id, src node_id, dst near from edges union all select corpus_id, dst, src from edges)),
counts as (select n.corpus_id, n.node_id entity_id, greatest(1, count(distinct h.chunk_id)) chunk_count from nodes n left join touch0 t on t.corpus_id=n.corpus_id and t.node_id=n.node_id left join nodes h on h.corpus_id=t.corpus_id and h.node_id=t.near and h.node_type<>'entity' where n.node_type='entity' group by 1,2)"""
QUERIES = f"""qs as (select example_id query_id, corpus_id, question query, {alpha_sql('question')} from per_example where example_id%100=0 and question is not null)"""
QENTS = entity_ctes("(select query_id, corpus_id, query as text from qs)", "qents0", "query_id, corpus_id") + f""",
qents as (select *, {node_id('entity', 'entity')} entity_id from qents0)"""
SEEDS = """seeds as (select distinct q.query_id, q.entity_id node_id, 1.0::double score from qents q join entities e using (corpus_id, entity_id))"""
FACTOR = "list_max(list_transform(edge_kinds, lambda k: case " + " ".join(f"when k='{k}' then {v}" for k, v in C.edge_type_weights.items()) + " else 1.0 end))"
MOVES = f"""base as (select e.corpus_id, e.src, e.dst, n.node_type dst_type, weight*{FACTOR}/(1+{C.hub_penalty}*ln(1+d.degree)) base from edges e join degree d on d.corpus_id=e.corpus_id and d.node_id=e.dst join nodes n on n.corpus_id=e.corpus_id and n.node_id=e.dst),
weighted as (select q.query_id, src, dst, base*(1+{C.transition_lambda}*case dst_type when 'entity' then af when 'sentence' then as_ when 'chunk' then ac else 0 end) w from base join qs q using (corpus_id)),
sym as (select query_id, src, dst, max(w) w from (select query_id, src, dst, w from weighted union all select query_id, dst, src, w from weighted) group by 1,2,3 having max(w)>0),
moves as (select query_id, src, dst, w/sum(w) over (partition by query_id, src) p from sym)"""
RESTART = f"""mass as (select q.query_id, n.node_id, {C.seed_floor}+coalesce(s.score,0) r from qs q join nodes n using (corpus_id) left join seeds s on s.query_id=q.query_id and s.node_id=n.node_id),
restart as (select query_id, node_id, r/sum(r) over (partition by query_id) r, count(*) over (partition by query_id) n from mass),
movers as (select distinct query_id, src node_id from moves)"""


def _iterate(n: int) -> str:
    out = ["it0 as (select query_id, node_id, 1.0/n score from restart)"]
    for i in range(1, n + 1):
        p = f"it{i - 1}"
        out.append(f"""lost{i} as (select p.query_id, coalesce(sum(p.score) filter (m.node_id is null),0) lost from {p} p left join movers m on m.query_id=p.query_id and m.node_id=p.node_id group by 1),
flow{i} as (select m.query_id, m.dst node_id, sum(m.p*p.score) f from moves m join {p} p on p.query_id=m.query_id and p.node_id=m.src group by 1,2),
it{i} as (select r.query_id, r.node_id, {C.pagerank_alpha}*(coalesce(f.f,0)+l.lost*r.r)+{1 - C.pagerank_alpha}*r.r score from restart r left join flow{i} f on f.query_id=r.query_id and f.node_id=r.node_id join lost{i} l on l.query_id=r.query_id)""")
    return ",\n".join(out)


STEPS = 3
PPR = _iterate(STEPS)
GRAPH = ",\n".join((DOCS, CHUNKS, SENTS, MENTS, FACTS, ENTITIES, EDGES, DEGREE, NODES))
ALL = ",\n".join((GRAPH, COUNTS, QUERIES, QENTS, SEEDS, MOVES, RESTART, PPR))
FACT_PARTS = f"""fact_last as (select corpus_id, fact_id, arg_max(struct_pack(t:=text,s:=sentence_id,c:=chunk_id,h:=head_id,l:=tail_id,o:=ord,si:=sentence_index,fi:=fact_index), struct_pack(a:=ord,b:=sentence_index,c:=fact_index)) x from facts group by 1,2),
fact_scored as (select q.query_id, q.query, q.corpus_id, fact_id id, x.t text, x.o ord, x.si si, x.fi fi, {overlap('q.query', 'x.t')} score from qs q join fact_last using (corpus_id)),
fact_first as (select * from fact_scored qualify row_number() over (partition by query_id order by score desc, id) <= {C.fact_rerank_top_k}),
fact_again as (select *, 0.7*score+0.3*{overlap('query', 'text')} s2 from fact_first),
fact_kept as (select *, row_number() over (partition by query_id order by s2 desc, id) rank from fact_again qualify rank <= {C.fact_rerank_keep_k}),
fact_rank as (select query_id, corpus_id, id, rank, s2/sum(s2) over (partition by query_id) score from fact_kept where s2>0),
chunk_scored as (select q.query_id, c.chunk_id id, {overlap('q.query', 'c.body')} score from qs q join (select corpus_id, chunk_id, arg_max(body, ord) body from chunks group by 1,2) c using (corpus_id)),
chunk_kept as (select *, row_number() over (partition by query_id order by score desc, id) rank from chunk_scored qualify rank<={C.chunk_top_k}),
chunk_rank as (select query_id, id, rank, score/sum(score) over (partition by query_id) score from chunk_kept where score>0)"""
SEED_SCORES = f"""hit as (select f.query_id, f.corpus_id, unnest([x.h,x.l]) node_id, f.score*greatest(q.af,0.05) s from fact_rank f join qs q using (query_id) join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id),
seed0 as (select query_id, h.corpus_id, node_id, s/chunk_count s from hit h join counts c on c.corpus_id=h.corpus_id and c.entity_id=h.node_id union all select c.query_id, q.corpus_id, c.id, c.score*greatest(q.ac,0.05) from chunk_rank c join qs q using (query_id)),
seed1 as (select query_id, corpus_id, node_id, sum(s) s from seed0 group by 1,2,3),
seed2 as (select query_id, s1.node_id, s/(case when s1.node_id like 'entity:%' then 1+{C.entity_hub_suppression}*ln(1+coalesce(degree,0)) else 1 end) score from seed1 s1 left join degree d on d.corpus_id=s1.corpus_id and d.node_id=s1.node_id),
seed3 as (select query_id, node_id, score from seed2 union all select query_id, id, score from chunk_rank where query_id not in (select query_id from fact_rank)),
seed4 as (select query_id, node_id, sum(score) score from seed3 group by 1,2),
seed_scores as (select query_id, node_id, score/sum(score) over (partition by query_id) score from seed4 where score>0)"""

SQL: dict[str, str] = {}


def _add(name: str, ctes: str, body: str) -> None:
    SQL[name] = (f"with {ctes}\n" if ctes else "") + body


_n = f"len({words('body')})"
_add("chunk_windows", DOCS, f"""select ord doc_id, i chunk_index, len({words('body')}[i*192+1:i*192+256]) n_words, md5(array_to_string({words('body')}[i*192+1:i*192+256],' ')) digest from (select *, unnest(range(0, cast(greatest(0, ceil(({_n}-256)/192.0)) as bigint)+1)) i from docs where {_n}>0)""")
_add("sentence_split", ",".join((DOCS, CHUNKS, SENTS)), "select ord doc_id, sentence_index, text sentence from sents")
_add("sentence_sequence_edges", ",".join((DOCS, CHUNKS, SENTS)), "select * from (select corpus_id, ord doc_id, sentence_index, lag(sentence_id) over (partition by corpus_id, ord, chunk_id order by sentence_index) src, sentence_id dst from sents) where src is not null")
_add("node_ids", ",".join((DOCS, CHUNKS)), "select ord doc_id, chunk_id from chunks")
_add("entity_mentions", ",".join((DOCS, CHUNKS, SENTS, MENTS)), "select ord doc_id, sentence_index, place, entity from ments")
_add("entity_nodes", ",".join((DOCS, CHUNKS, SENTS, MENTS, ENTITIES)), "select * from entities")
_add("facts_regex", ",".join((DOCS, CHUNKS, SENTS, MENTS, FACTS)), "select ord doc_id, sentence_index, fact_index, head, 'related_to' relation, tail, 0.35::double confidence from facts")
_add("edges_merged", GRAPH, "select corpus_id, src, dst, weight, edge_type, array_to_string(edge_kinds,',') edge_kinds, coalesce(array_to_string(relations,','),'') relations from edges")
_add("edge_kind_counts", GRAPH, "select corpus_id, k edge_kind, count(*) edges from (select corpus_id, unnest(edge_kinds) k from edges) group by 1,2")
_add("layer_counts", GRAPH, "select corpus_id, node_type layer, count(*) n from nodes group by 1,2 union all select corpus_id, 'fact', count(*) from facts group by 1")
_add("entity_degree", GRAPH, "select corpus_id, node_id, degree from degree where node_id like 'entity:%'")
_add("entity_chunk_count", GRAPH + "," + COUNTS, "select * from counts")
_cos = "list_dot_product(a,b)/((sqrt(list_dot_product(a,a))+1e-8)*(sqrt(list_dot_product(b,b))+1e-8))"
_add("dense_topk", "", f"select query_id, id, rank, round(greatest(s,0),6) score from (select *, row_number() over (partition by query_id order by s desc, id) rank from (select query_id, id, {_cos} s from (select q.vec_id query_id, v.vec_id id, q.embedding::double[] a, v.embedding::double[] b from embeddings q, embeddings v where q.vec_id%100=0))) where rank<=12")
_add("similarity_edges", "", f"select src, dst, round(2*s,6) weight from (select a.vec_id src, b.vec_id dst, {_cos.replace('(a,b)', '(a.embedding::double[],b.embedding::double[])').replace('(a,a)', '(a.embedding::double[],a.embedding::double[])').replace('(b,b)', '(b.embedding::double[],b.embedding::double[])')} s from embeddings a, embeddings b where a.vec_id<>b.vec_id) where s>=0.3")
_add("score_normalise", "", "select example_id, corpus_id, round(f1/sum(f1) over (partition by corpus_id),9) score from (select example_id, corpus_id, greatest(coalesce(f1,0),0) f1 from per_example) qualify f1>0")
_add("lexical_overlap", "", f"select example_id, round({overlap('question', 'gold_answer')},6) overlap from per_example")
_add("content_coverage", "", f"select example_id, round({coverage('question', 'predicted_answer')},6) coverage from per_example")
_add("max_merge", "", "select query_id, id, round(s/sum(s) over (partition by query_id),9) score from (select query_id, execution_mode id, max(coalesce(retrieval_latency,0)) s from per_example where query_id is not null and execution_mode is not null group by 1,2) where s>0")
_add("last_wins_merge", "", "select query_id, id, round(s/sum(s) over (partition by query_id),9) score from (select query_id, execution_mode id, arg_max(coalesce(retrieval_latency,0), example_id) s from per_example where query_id is not null and execution_mode is not null group by 1,2) where s>0")
_add("fact_rerank", ",\n".join((GRAPH, QUERIES, FACT_PARTS)), "select query_id, id, rank, round(score,6) score from fact_rank")
_add("seed_scores", ",\n".join((GRAPH, COUNTS, QUERIES, FACT_PARTS, SEED_SCORES)), "select query_id, node_id, round(score,6) score from seed_scores")
_add("ppr_fixed_iters", ALL, f"select query_id, node_id, round(score,9) score from it{STEPS} qualify row_number() over (partition by query_id order by round(score,9) desc, node_id)<=30")
PASSAGES = f"""placed as (select i.query_id, i.node_id, i.score, q.corpus_id, q.af, q.as_, q.ac, n.node_type, n.chunk_id from it{STEPS} i join qs q using (query_id) join nodes n on n.corpus_id=q.corpus_id and n.node_id=i.node_id),
touch as (select t.corpus_id, t.node_id, h.chunk_id home, count(*) times from (select corpus_id, src node_id, dst near from edges union all select corpus_id, dst, src from edges) t join nodes h on h.corpus_id=t.corpus_id and h.node_id=t.near and h.node_type='sentence' group by 1,2,3),
contrib as (select query_id, chunk_id, (case node_type when 'chunk' then 0.35+0.90*ac else 0.08+0.55*as_ end)*score s from placed where node_type<>'entity'
 union all select p.query_id, t.home, (0.02+0.25*af)*score*times from placed p join touch t on t.corpus_id=p.corpus_id and t.node_id=p.node_id where node_type='entity'
 union all select c.query_id, c.id, (0.12+0.70*ac)*c.score from chunk_rank c join qs using (query_id)
 union all select f.query_id, l.x.c, (0.06+0.45*af)*f.score from fact_rank f join qs using (query_id) join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id where f.rank<={C.fact_top_k}),
passages as (select query_id, chunk_id, sum(s) score from contrib group by 1,2)"""
_add("passage_rank", ",\n".join((ALL, FACT_PARTS, PASSAGES)), f"select query_id, chunk_id, round(score,6) score from passages qualify row_number() over (partition by query_id order by score desc, chunk_id)<={C.passage_output_top_k}")
_add("sentence_blend", ",\n".join((ALL, FACT_PARTS)), f"""select query_id, node_id, round(s/sum(s) over (partition by query_id),9) score from (select query_id, node_id, sum(s) s from (select query_id, node_id, 0.65*score s from it{STEPS} where node_id like 'sentence:%' union all select f.query_id, l.x.s, 0.45*f.score from fact_rank f join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id where f.rank<={C.fact_top_k}) group by 1,2) where s>0""")
_add("neighbour_sentences", ",\n".join((GRAPH, QUERIES, FACT_PARTS)), "select f.query_id, s.sentence_id, round(max(0.82*f.score),6) score from fact_rank f join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id join sents s on s.corpus_id=f.corpus_id and s.chunk_id=l.x.c and abs(s.sentence_index-l.x.si)<=1 group by 1,2")
_add("title_diverse_topk", ",\n".join((DOCS, CHUNKS, QUERIES, "chunk_scored as (select q.query_id, c.chunk_id node_id, c.title, " + overlap("q.query", "c.body") + " score from qs q join (select corpus_id, chunk_id, arg_max(title, ord) title, arg_max(body, ord) body from chunks group by 1,2) c using (corpus_id)), ranked as (select *, row_number() over (partition by query_id order by score desc, node_id) rank from chunk_scored), firsts as (select *, row_number() over (partition by query_id, lower(trim(title)) order by rank) n from ranked)")), "select query_id, node_id, row_number() over (partition by query_id order by rank) rank from firsts where n=1 qualify row_number() over (partition by query_id order by rank)<=4")
_add("heuristic_alpha", "", f"select example_id, af fact, as_ sentence, ac chunk, case when ac>=0.42 then 'long_context' when as_+af>=0.62 then 'multi_hop' else 'single_hop' end profile, round(greatest(0,1+(case when af>0 then af*ln(af) else 0 end+case when as_>0 then as_*ln(as_) else 0 end+case when ac>0 then ac*ln(ac) else 0 end)/ln(3)),6) confidence from (select example_id, {alpha_sql('question')} from per_example)")
_f1p, _f1g = f"string_split({normal('predicted_answer')},' ')", f"string_split({normal('gold_answer')},' ')"
_add("token_f1", "", f"""select example_id, case when p='' and g='' then 1.0 when p='' or g='' then 0.0 else round(2.0*coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y=x)),len(list_filter(gt, lambda y: y=x))))),0)/(len(pt)+len(gt)),6) end f1, case when p=g then 1.0 else 0.0 end em from (select example_id, {normal('predicted_answer')} p, {normal('gold_answer')} g, {_f1p} pt, {_f1g} gt from per_example)""")
_add("source_summary", "", "select case when grouping(s)=1 then 'overall' else s end source, count(*) examples, round(avg(f1),9) avg_f1, round(avg(em),9) avg_em, round(avg(query_total_latency),9) avg_query_total_latency, round(avg(retrieval_latency),9) avg_retrieval_latency, round(avg(final_evidence_tokens),9) avg_final_evidence_tokens from (select *, coalesce(source_dataset,'unknown') s from per_example) group by rollup(s)")
_add("alpha_std_by_source", "", "select coalesce(source_dataset,'unknown') source, count(*) examples, " + ", ".join(f"round(avg({a}),9) avg_{a}, round(coalesce(stddev_pop({a}),0),9) std_{a}" for a in ("alpha_f", "alpha_s", "alpha_c")) + " from per_example group by 1")
_key = f"md5(lower({spaced(chr(99) + 'oalesce(title,' + chr(39) * 2 + ')')})||'||'||lower({spaced('text')}))"
_add("doc_dedup", "", f"select key, min(doc_id) doc_id from (select doc_id, {_key} key from documents where text is not null) group by 1")
_add("required_docs", "", f"""select key, list_sort(list_distinct(list(sample_id))) is not null has, count(distinct sample_id) samples from (select sample_id, d.is_supporting s, {_key.replace('title', 'd.title').replace('text', 'd.text')} key, max(coalesce(d.is_supporting,false)::int) over (partition by sample_id) m from (select sample_id, unnest(documents) d from samples) where trim(coalesce(d.text,''))<>'') where m=0 or coalesce(s,false) group by 1""")
SQL["distractors"] = f"""with need as ({SQL['required_docs']}) select key, min(doc_id) doc_id from (select doc_id, {_key} key from documents where text is not null) where key not in (select key from need) group by 1"""
_add("strip_sentence_layer", GRAPH, """, kept as (select corpus_id, src, dst, weight, edge_type from edges where src not like 'sentence:%' and dst not like 'sentence:%') select corpus_id, edge_type, count(*) edges, sum(weight) weight from (select * from kept union all select corpus_id, src, dst, count(*)::double, 'entity_chunk' from (select corpus_id, entity_id src, chunk_id dst from ends union all select corpus_id, chunk_id, entity_id from ends) group by 1,2,3) group by 1,2""".replace(", kept", ", kept", 1))
SQL["strip_sentence_layer"] = SQL["strip_sentence_layer"].replace("\n, kept", ", kept")
_add("mode_consistency", "", """select count(*) queries, count(b.query_id) paired, """ + ", ".join(f"sum(case when b.query_id is not null and a.r.{f} is not distinct from b.r.{f} then 1 when b.query_id is null and a.r.{f} is null then 1 else 0 end) same_{f}" for f in ("f1", "em", "final_evidence_tokens", "predicted_answer")) + """ from (select query_id, arg_max(struct_pack(f1:=f1,em:=em,final_evidence_tokens:=final_evidence_tokens,predicted_answer:=predicted_answer), struct_pack(a:=loaded_at,b:=example_id)) r from per_example where query_id is not null and execution_mode='sequential' group by 1) a left join (select query_id, arg_max(struct_pack(f1:=f1,em:=em,final_evidence_tokens:=final_evidence_tokens,predicted_answer:=predicted_answer), struct_pack(a:=loaded_at,b:=example_id)) r from per_example where query_id is not null and execution_mode='multi_worker' group by 1) b using (query_id)""")
_add("given_facts", "", "select relation, count(*) facts, count(distinct sentence_id) sentences from (select sentence_id, case when trim(regexp_replace(lower(coalesce(t.relation,'')),'[^A-Za-z0-9]+','_','g'),'_')='' then 'related_to' else trim(regexp_replace(lower(coalesce(t.relation,'')),'[^A-Za-z0-9]+','_','g'),'_') end relation from (select sentence_id, unnest(triples) t from extract_sentence)) group by 1")
_add("truncate_words", "", f"select doc_id, md5(case when len({words('text')})<=50 then {strip('text')} else array_to_string({words('text')}[:50],' ') end) digest from documents where text is not null")

# ---- propagation until it settles ------------------------------------------------------------------------------------
LONGEST = 24


def _settle(n: int) -> str:
    """Steps until every question's change is under its nodes times the tolerance; settled questions keep their scores."""
    out = ["st0 as materialized (select query_id, node_id, 1.0/n score, false settled from restart)"]
    for i in range(1, n + 1):
        p = f"st{i - 1}"
        out.append(f"""sl{i} as materialized (select p.query_id, coalesce(sum(p.score) filter (m.node_id is null),0) lost from {p} p left join movers m on m.query_id=p.query_id and m.node_id=p.node_id where not settled group by 1),
sf{i} as materialized (select m.query_id, m.dst node_id, sum(m.p*p.score) f from moves m join {p} p on p.query_id=m.query_id and p.node_id=m.src where not settled group by 1,2),
sn{i} as materialized (select p.query_id, p.node_id, p.score before, case when p.settled then p.score else {C.pagerank_alpha}*(coalesce(f.f,0)+l.lost*r.r)+{1 - C.pagerank_alpha}*r.r end score, p.settled, r.n from {p} p join restart r on r.query_id=p.query_id and r.node_id=p.node_id left join sf{i} f on f.query_id=p.query_id and f.node_id=p.node_id left join sl{i} l on l.query_id=p.query_id),
st{i} as materialized (select query_id, node_id, score, settled or sum(abs(score-before)) over (partition by query_id) < n*{C.pagerank_tolerance} settled from sn{i})""")
    return ",\n".join(out)


_MATERIAL = MOVES.replace("moves as (", "moves as materialized (") + ",\n" + RESTART.replace("restart as (", "restart as materialized (")
_SEEDED = ",\n".join((GRAPH, COUNTS, QUERIES, FACT_PARTS, SEED_SCORES, "seeds as (select * from seed_scores)", _MATERIAL, _settle(LONGEST)))
_add("passage_rank_converged", ",\n".join((_SEEDED, PASSAGES.replace(f"it{STEPS}", f"st{LONGEST}"))), f"select query_id, chunk_id, round(score,5) score from passages qualify row_number() over (partition by query_id order by score desc, chunk_id)<={C.passage_output_top_k}")
_SENT_RANK = f"""sent_scored as (select q.query_id, s.sentence_id id, {overlap('q.query', 's.text')} score from qs q join (select corpus_id, sentence_id, arg_max(text, struct_pack(a:=ord,b:=sentence_index)) text from sents group by 1,2) s using (corpus_id)),
sent_kept as (select * from sent_scored qualify row_number() over (partition by query_id order by score desc, id)<={C.sentence_top_k}),
sent_rank as (select query_id, id, score/sum(score) over (partition by query_id) score from sent_kept where score>0)"""
_add("sentence_blend_dense", ",\n".join((ALL, FACT_PARTS, _SENT_RANK)), f"""select query_id, node_id, round(s/sum(s) over (partition by query_id),9) score from (select query_id, node_id, sum(s) s from (select query_id, node_id, 0.65*score s from it{STEPS} where node_id like 'sentence:%' union all select query_id, id, 0.35*score from sent_rank union all select f.query_id, l.x.s, 0.45*f.score from fact_rank f join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id where f.rank<={C.fact_top_k}) group by 1,2) where s>0""")

# ---- scalar operators ------------------------------------------------------------------------------------------------
_CAPS = dict(zip("fsc", (C.fact_top_k, C.sentence_top_k, C.passage_output_top_k)))
_add("alpha_quota", f"""p as (select example_id, greatest(alpha_f,0) f, greatest(alpha_s,0) s, greatest(alpha_c,0) c from per_example where alpha_f is not null and alpha_s is not null and alpha_c is not null),
n as (select example_id, case when f+s+c=0 then 1.0 else f+s+c end t, f, s, c from p),
k as (select example_id, unnest([struct_pack(k:=1,x:=f/t,cap:={_CAPS['f']}),struct_pack(k:=2,x:=s/t,cap:={_CAPS['s']}),struct_pack(k:=3,x:=c/t,cap:={_CAPS['c']})]) u from n),
r as (select example_id, u.k k, u.x x, u.cap cap, {C.evidence_alpha_total_units}*u.x raw, least(u.cap, cast(floor({C.evidence_alpha_total_units}*u.x) as bigint)) given from k),
l as (select *, {C.evidence_alpha_total_units}-sum(given) over (partition by example_id) rest, row_number() over (partition by example_id order by raw-floor(raw) desc, x desc, k) turn from r),
more as (select example_id, k, rest, row_number() over (partition by example_id order by round_no, turn) nth from l, (select unnest(range(1,{C.evidence_alpha_total_units}+1)) round_no) where given+round_no<=cap),
got as (select l.example_id, l.k, l.given+count(m.k) q from l left join more m on m.example_id=l.example_id and m.k=l.k and m.nth<=m.rest group by l.example_id, l.k, l.given)""",
     "select example_id, max(q) filter (k=1) fact, max(q) filter (k=2) sentence, max(q) filter (k=3) chunk from got group by 1")
_flat = spaced("coalesce(question,'')")
_mark = "regexp_replace({},'^[ ?]+|[ ?]+$','','g')||'?'"
_add("heuristic_decompose", f"""f as (select example_id, {_flat} flat from per_example where question is not null),
c as (select example_id, flat, list_transform(list_filter(regexp_split_to_array(flat,'(?i)\\s+(?:and then|then|after|before|while)\\s+'), lambda p: len(string_split(trim(p),' '))>=3), lambda s: {_mark.format('s')}) cut from f),
a as (select example_id, case when flat='' then []::varchar[] when len(cut)>1 then cut[:4] when contains(lower(flat),' which ') and contains(flat,',') then [{_mark.format("regexp_extract(flat,'^(.*),(.*)$',1)")}, {_mark.format("regexp_extract(flat,'^(.*),(.*)$',2)")}] else [regexp_replace(flat,'[?]+$','')||'?'] end parts from c)""",
     "select example_id, generate_subscripts(parts,1)-1 part, unnest(parts) sub_question from a")
_add("best_em_f1", f"""s as (select sample_id, lower(answer) p, list_filter(list_concat([answer], coalesce(answer_aliases,[]::varchar[])), lambda a: a is not null and trim(a)<>'') g from samples),
u as (select sample_id, p, unnest(g) a, generate_subscripts(g,1) i from s),
n as (select sample_id, {normal('p')} p, {normal('a')} a, i from u),
d as (select sample_id, p, a from n qualify row_number() over (partition by sample_id, a order by i)=1),
t as (select sample_id, p, a, string_split(p,' ') pt, string_split(a,' ') gt from d),
x as (select sample_id, case when p=a then 1.0 else 0.0 end em, case when p='' and a='' then 1.0 when p='' or a='' then 0.0 else 2.0*coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y=x)),len(list_filter(gt, lambda y: y=x))))),0)/(len(pt)+len(gt)) end f1 from t)""",
     "select s.sample_id, count(x.sample_id) golds, coalesce(max(em),0.0) em, round(coalesce(max(f1),0.0),6) f1 from s left join x using (sample_id) group by 1")
SQL["scaled_corpus"] = f"""with rq as ({SQL['required_docs']}), di as ({SQL['distractors']}), k as (select cast(floor(0.5*count(*)) as bigint) n from di)
select key, true required from rq union all select key, false from (select key, row_number() over (order by md5('42|'||key), key) i from di), k where i<=n"""
_AUX = "do|does|did|is|are|was|were|can|could|has|have|had"
_last = lambda src, pattern, g: f"regexp_extract_all({src},'{pattern}',{g})[-1]"
_OR = (r"(?i)(.+?)\s+or\s+(.+?)(?:\?|$)", r"(?i)\b(?:between|of|from|than)\s+(.+?)\s+or\s+(.+?)(?:\?|$)", r"(?i)([^,?]+?)\s+or\s+([^,?]+?)(?:\?|$)")
_tail = "list_last(string_split(flat,','))"


def _tidy(x: str) -> str:
    for pattern in (r"^[ ,.?\"'']+|[ ,.?\"'']+$", rf"(?i)^(?:{_AUX})\s+", r"(?i)^(?:the|film|song|person)\s+", r"(?i)\s+(?:first|earlier|later|older|younger)$"):
        x = f"regexp_replace({x},'{pattern}','','g')"
    return spaced(x)


_plain = "trim(regexp_replace(lower(coalesce({},'')),'[^a-z0-9]+',' ','g'))"
_stripped = lambda t: f"regexp_replace(coalesce({t},''),'^{WS}+|{WS}+$','','g')"
_lines = r"\r\n|[\n\x0B\f\r\x{0085}\x{2028}\x{2029}]"
_parsed = f"""case when t='' then '' when contains(t,'Answer:') then regexp_replace(regexp_replace(trim(regexp_split_to_array({_stripped("list_last(string_split(t,'Answer:'))")},'{_lines}')[1]),'^"+|"+$','','g'),'^''+|''+$|\\.+$','','g') else regexp_replace(trim(list_last(regexp_split_to_array(t,'{_lines}'))),'\\.+$','','g') end"""


def _cut(x: str) -> str:
    for mark in ("chr(10)", "';'", "' because '", "' since '"):
        x = f"regexp_replace(trim(string_split({x},{mark})[1]),'\\.+$','','g')"
    return f"trim({x})"


_add("or_choices", f"""f as (select example_id, predicted_answer, {spaced("replace(coalesce(question,''),'?',' ?')")} flat from per_example where question is not null),
o as (select example_id, predicted_answer, flat, [{_last(_tail, _OR[0], 1)},{_last(_tail, _OR[0], 2)}] a, [{_last('flat', _OR[1], 1)},{_last('flat', _OR[1], 2)}] b, [{_last('flat', _OR[2], 1)},{_last('flat', _OR[2], 2)}] c from f),
g as (select example_id, predicted_answer, flat, list_filter(case when contains(flat,',') and contains(lower(flat),' or ') and a[1] is not null then a when b[1] is not null then b else c end, lambda x: x is not null) found from o),
m as (select example_id, predicted_answer, flat, list_filter(list_transform(found, lambda x: {_tidy('x')}), lambda x: x<>'' and len(string_split(x,' '))<=8) made0 from g),
d as (select *, case when len(made0)=2 and made0[1]=made0[2] then made0[:1] else made0 end made from m),
e as (select example_id, {_stripped('predicted_answer')} t, case when len(made)>=2 then made[:2] when regexp_matches(lower(flat),'^(?:{_AUX})\\b') then ['yes','no'] else made end offered from d),
h as (select example_id, offered, {_parsed} answer from e),
b2 as (select example_id, offered, trim(regexp_replace(regexp_replace(trim(answer),'^["'']+|["'']+$','','g'),'\\.+$','','g')) bare from h),
n2 as (select *, {_plain.format('bare')} norm from b2),
k as (select *, list_filter(offered, lambda c: norm<>'' and {_plain.format('c')}<>'' and (contains(norm,{_plain.format('c')}) or contains({_plain.format('c')},norm)))[1] named from n2)""",
     f"select example_id, array_to_string(offered,' | ') offered, case when named is not null then named when offered=['yes','no'] and regexp_matches(lower(bare),'\\byes\\b') and not regexp_matches(lower(bare),'\\bno\\b') then 'yes' when offered=['yes','no'] and regexp_matches(lower(bare),'\\bno\\b') and not regexp_matches(lower(bare),'\\byes\\b') then 'no' else {_cut('bare')} end settled from k")

_add("fact_evidence_scores", ",\n".join((ALL, FACT_PARTS)), f"""select f.query_id, f.id, round(f.score+0.35*(coalesce(h.score,0)+coalesce(t.score,0))+0.20*coalesce(c.score,0),6) score from fact_rank f join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id left join it{STEPS} h on h.query_id=f.query_id and h.node_id=l.x.h left join it{STEPS} t on t.query_id=f.query_id and t.node_id=l.x.l left join it{STEPS} c on c.query_id=f.query_id and c.node_id=l.x.c where f.rank<={C.fact_top_k}""")
_add("index_summary", GRAPH, """select corpus_id, n.nodes, entity_nodes, sentence_nodes, chunk_nodes, coalesce(f.n,0) fact_nodes, coalesce(e.n,0) edges from (select corpus_id, count(*) nodes, count(*) filter (node_type='entity') entity_nodes, count(*) filter (node_type='sentence') sentence_nodes, count(*) filter (node_type='chunk') chunk_nodes from nodes group by 1) n left join (select corpus_id, count(*) n from facts group by 1) f using (corpus_id) left join (select corpus_id, count(*) n from edges group by 1) e using (corpus_id)""")
_add("edge_type_averages", GRAPH, "select edge_type, round(avg(n),6) edges from (select corpus_id, edge_type, count(*) n from edges group by 1,2) group by 1")
_add("repeat_summary", "", "select coalesce(source_dataset,'unknown') source, count(*) runs, " + ", ".join(f"round(avg({m}),9) {m}_mean, round(coalesce(stddev_samp({m}),0),9) {m}_std" for m in ("f1", "em", "retrieval_latency")) + " from per_example group by 1")
_add("gold_in_answer", "", f"select example_id, {normal('gold_answer')}<>'' and contains({normal('predicted_answer')},{normal('gold_answer')}) matched from per_example where gold_answer is not null")
_add("title_slugs", "", "select doc_id, trim(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'-') slug from documents where title is not null")
_add("held_out_samples", "", "select sample_id, len(documents) documents from samples where lower(split) in ('dev','valid','validation')")
SQL["required_in_corpus"] = f"with need as ({SQL['required_docs']}) select key from need where key in (select {_key} from documents where text is not null)"
_LEFT = """, kept0 as (select corpus_id, src, dst, weight, edge_type, edge_kinds from edges where src not like 'sentence:%' and dst not like 'sentence:%'),
edges2 as (select * from kept0 union all select corpus_id, src, dst, count(*)::double, 'entity_chunk', ['entity_chunk'] from (select corpus_id, entity_id src, chunk_id dst from ends union all select corpus_id, chunk_id, entity_id from ends) group by 1,2,3),
degree2 as (select corpus_id, node_id, count(*) degree from (select corpus_id, src node_id from edges2 union all select corpus_id, dst from edges2) group by 1,2),
nodes2 as (select * from nodes where node_type<>'sentence')"""
_MOVES2 = MOVES.replace("from edges e join degree d", "from edges2 e join degree2 d").replace("join nodes n", "join nodes2 n") + ",\n" + RESTART.replace("join nodes n", "join nodes2 n")
_PASS2 = f"""placed as (select i.query_id, i.node_id, i.score, q.corpus_id, q.af, q.ac, n.node_type, n.chunk_id from it{STEPS} i join qs q using (query_id) join nodes2 n on n.corpus_id=q.corpus_id and n.node_id=i.node_id),
touch as (select t.corpus_id, t.node_id, h.chunk_id home, count(*) times from (select corpus_id, src node_id, dst near from edges2 union all select corpus_id, dst, src from edges2) t join nodes2 h on h.corpus_id=t.corpus_id and h.node_id=t.near and h.node_type='chunk' group by 1,2,3),
contrib as (select query_id, chunk_id, (0.35+0.90*ac)*score s from placed where node_type='chunk'
 union all select p.query_id, t.home, (0.02+0.25*af)*score*times from placed p join touch t on t.corpus_id=p.corpus_id and t.node_id=p.node_id where node_type='entity'
 union all select c.query_id, c.id, (0.12+0.70*ac)*c.score from chunk_rank c join qs using (query_id)
 union all select f.query_id, l.x.c, (0.06+0.45*af)*f.score from fact_rank f join qs using (query_id) join fact_last l on l.corpus_id=f.corpus_id and l.fact_id=f.id where f.rank<={C.fact_top_k}),
passages as (select query_id, chunk_id, sum(s) score from contrib group by 1,2)"""
_add("passages_without_sentences", ",\n".join((GRAPH + _LEFT, QUERIES, QENTS, SEEDS, _MOVES2, PPR, FACT_PARTS, _PASS2)), f"select query_id, chunk_id, round(score,6) score from passages qualify row_number() over (partition by query_id order by score desc, chunk_id)<={C.passage_output_top_k}")
