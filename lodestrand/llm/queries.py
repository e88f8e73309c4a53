"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from ..sources.tables import table
from . import exact_dups, leakage, mixing, names, near_dups, pairs, pieces, privacy, sentences


def p1_found(spark, d):
    """Pairs of near-duplicate documents."""
    return near_dups.pairs(table(spark, d, "documents"))


def p1_groups(spark, d):
    """Every document with its near-duplicate group and its number of links."""
    return near_dups.groups(table(spark, d, "documents"))


def _sentence_model(spark, d):
    return sentences.train(table(spark, d, "documents"), table(spark, d, "extract_sentence"))


def p2_found(spark, d):
    """The sentence units of every document."""
    return sentences.unit_table(table(spark, d, "documents"), _sentence_model(spark, d))


def p3_found(spark, d):
    """Defective answers with the type of their defect."""
    return pairs.defects(table(spark, d, "per_example"))


def p4_found(spark, d):
    """Documents hidden behind formatting differences, with the one kept."""
    return exact_dups.copies(table(spark, d, "documents"))


def p4_groups(spark, d):
    """Each distinct document once, with its number of copies."""
    return exact_dups.groups(table(spark, d, "documents"))


def p5_found(spark, d):
    """Pairs of spellings of one person, organisation or place."""
    return names.pairs(table(spark, d, "extract_sentence"))


def p5_entities(spark, d):
    """Every spelling with its entity and its number of links."""
    return names.linked(table(spark, d, "extract_sentence"))


def p6_found(spark, d):
    """Documents above 4,000 characters and how they were cut."""
    return pieces.cuts(table(spark, d, "documents"), _sentence_model(spark, d))


def p6_pieces(spark, d):
    """The overlapping pieces of every document above 4,000 characters."""
    return pieces.pieces(table(spark, d, "documents"), _sentence_model(spark, d))


def p8_found(spark, d):
    """Documents that hold held-out text, with the samples concerned."""
    return leakage.found(table(spark, d, "documents"), table(spark, d, "samples"))


def p8_leaks(spark, d):
    """The same with questions that recur with other values in their slots."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "samples"))


def p9_mixture(spark, d):
    """The documents chosen for each mixture, with how often."""
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark, d):
    """Target and reached shares of each mixture's sources."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


def p10_found(spark, d):
    """Private data in every document, with its place and kind."""
    docs = table(spark, d, "documents")
    return privacy.findings(docs, privacy.session_key(spark), privacy.train(docs), tags=False).select("doc_id", "start_char", "end_char", "kind")


def p10_linked(spark, d):
    """Numbers, dates of birth and other private data with their pseudonyms, equal for equal values in all documents."""
    docs = table(spark, d, "documents")
    return privacy.findings(docs, privacy.session_key(spark), privacy.train(docs), dates=True)


def p10_redacted(spark, d):
    """Every document with its private data replaced."""
    docs = table(spark, d, "documents")
    return privacy.redacted(docs, privacy.session_key(spark), privacy.train(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p4_found, p4_groups, p5_found, p5_entities, p6_found, p6_pieces, p8_found, p8_leaks, p9_mixture, p9_shares, p10_found, p10_linked, p10_redacted)}
_BARE = "regexp_replace(lower({}),'[^\\p{{L}}\\p{{N}}]+','','g')"
_LINES = "regexp_split_to_array(text,'\\r\\n|[\\n\\x0B\\f\\r]')"
_IS_LABELS = f"contains(text,':') and len(list_filter({_LINES}, lambda x: not regexp_matches(x,'^[^:]{{1,60}}:.*[\\p{{L}}\\p{{N}}]|^[^\\p{{L}}\\p{{N}}]*$')))=0"
_P4 = f"""with d as (select doc_id, {_BARE.format("coalesce(title,'')")} t, {_BARE.format("text")} x, case when {_IS_LABELS} then array_to_string(list_sort(list_filter(list_transform({_LINES}, lambda l: {_BARE.format("l")}), lambda l: l<>'')),chr(10)) end k from documents where text is not null),
b as (select *, max(k) over (partition by t, x) kk from d where x<>''),
g as (select doc_id, min(doc_id) over (partition by t, coalesce(chr(10)||kk, x)) keep, count(*) over (partition by t, coalesce(chr(10)||kk, x)) copies from b)"""
_WINDOWS = "select {0}, substr(b, i, {1}) w from (select {0}, b, unnest(range(1, length(b)-{1}+2)) i from {2})"
_P8 = f"""with s as (select sample_id, question, unnest(list_concat([question], list_transform(coalesce(documents,[]), lambda x: x.text))) t from samples where split in ('test','validation','dev')),
sb as (select sample_id, case when regexp_matches(question,'[一-鿿㐀-䶿]') then 24 else 75 end n, {_BARE.format("t")} b from s where t is not null),
db as (select doc_id, {_BARE.format("text")} b from documents where text is not null)
select distinct doc_id, sample_id from ({_WINDOWS.format("doc_id", 75, "db")}) join ({_WINDOWS.format("sample_id", 75, "(select * from sb where n=75)")}) using (w)
union select distinct doc_id, sample_id from ({_WINDOWS.format("doc_id", 24, "db")}) join ({_WINDOWS.format("sample_id", 24, "(select * from sb where n=24)")}) using (w)"""

_P1 = f"""{_P4.replace("g as (select doc_id,", "g as (select doc_id, x,")}, t as (select distinct x from b where length(x)>=8), n as (select x, row_number() over () i from t),
w as (select distinct i, substr(x, k, 8) s from (select x, i, unnest(range(1, length(x)-6)) k from n)), c as (select i, count(*) n from w group by 1),
p as (select a.i a, b.i b, count(*) shared from w a join w b on a.s=b.s and a.i<b.i group by 1,2),
l as (select a, b from p join c ca on ca.i=a join c cb on cb.i=b where shared>=0.6*(ca.n+cb.n-shared) union all select i, i from n),
m as (select doc_id, keep, i from g join n using (x))
select distinct least(u.doc_id,v.doc_id) doc_id_a, greatest(u.doc_id,v.doc_id) doc_id_b from l join m u on u.i=l.a join m v on v.i=l.b where u.keep<>v.keep and u.doc_id<>v.doc_id"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p4_found": _P4 + " select distinct keep keep_doc_id, doc_id copy_doc_id from g where doc_id<>keep",
    "p4_groups": _P4 + " select distinct keep, copies from g",
    "p8_found": _P8,
}
