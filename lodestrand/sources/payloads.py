"""Corpora, samples and results as JSON, JSON Lines and Parquet, in the layouts in which they come."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import numbered, stored

# Member names that loaders accept, in order.
LIST_KEYS = "documents docs corpus paragraphs contexts context passages items data".split()
SAMPLE_KEYS = "samples data examples items".split()
TEXT_KEYS = "text content contents body page_content paragraph_text".split()
TITLE_KEYS = "title name doc_id id uid".split()
ID_KEYS = "id _id qid question_id uid".split()
CONTEXT_TEXT_KEYS = "paragraph_text text contents content body page_content".split()
DATASET_KEYS = "source_dataset dataset dataset_name source task".split()
FORMATS = ("canonical_json", "canonical_jsonl", "musique_jsonl", "2wiki_json", "hotpot_parquet")
DATASET_SUFFIX = re.compile(r"[_-](?:dev|test|train|validation|samples?|sampled|subset|\d+)$")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per row (column ``value``): whole files, lines of .jsonl, or rows of Parquet."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).filter(F.trim("value") != "").select("value")
    if path.endswith(".parquet") or any(c in path.rsplit("/", 1)[-1] for c in "*?[]"):
        rows = spark.read.parquet(path)
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    return spark.read.text(path, wholetext=True).select("value")


def _array(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def _list_of(value: Column, keys: list[str]) -> Column:
    """The JSON texts of the elements of a list: the value itself, or its first member of ``keys`` that is a list."""
    member = lambda k: F.get_json_object(value, f"$.{k}")
    named = F.coalesce(*[F.when(member(k).startswith("["), member(k)) for k in keys])
    return _array(F.when(F.ltrim(value).startswith("["), value).otherwise(named))


def _first(item: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(item, f"$.{k}") for k in keys])


DOCUMENT = "struct<idx:string,title:string,text:string,is_supporting:boolean>"


def _joined(c: Column) -> Column:
    return F.when(F.ltrim(c).startswith("["), F.array_join(_array(c), " ")).otherwise(c)


def document_of(item: Column, index: Column, titles: Column | None = None, text_keys: list[str] = TEXT_KEYS) -> Column:
    """idx, title, text, is_supporting of one item of a list: a bare text, a [title, body] pair or an object.

    An item without a title is ``doc_<index>``; lists of sentences are joined by spaces; ``titles`` names those that
    support the answer.
    """
    bare, pair = F.ltrim(item), _array(item)
    is_pair, is_object = bare.startswith("["), bare.startswith("{")
    text = F.when(is_pair, _joined(F.get(pair, F.lit(1)))).when(is_object, F.coalesce(_first(item, text_keys), _joined(F.get_json_object(item, "$.sentences")))).otherwise(item)
    title = F.coalesce(F.when(is_pair, F.get(pair, F.lit(0))).when(is_object, _first(item, TITLE_KEYS)), F.concat(F.lit("doc_"), index.cast("string")))
    flag = F.when(is_object, F.get_json_object(item, "$.is_supporting").cast("boolean"))
    if titles is not None:
        flag = F.coalesce(flag, F.array_contains(titles, title))
    return F.struct(F.when(is_object, F.coalesce(F.get_json_object(item, "$.idx"), index.cast("string"))).otherwise(index.cast("string")).alias("idx"), title.alias("title"), text.alias("text"), flag.alias("is_supporting"))


def documents(objects: DataFrame) -> DataFrame:
    """document_index, title, text, idx, is_supporting of a corpus payload; blank texts go."""
    items = objects.select(F.posexplode(_list_of(F.col("value"), LIST_KEYS)).alias("document_index", "item"))
    made = items.select("document_index", "item", document_of(F.col("item"), F.col("document_index")).alias("d"))
    own = F.when(F.ltrim("item").startswith("{"), F.get_json_object("item", "$.idx"))
    return made.select("document_index", "d.title", "d.text", own.alias("idx"), "d.is_supporting").filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def document_list(items: Column, titles: Column | None = None, text_keys: list[str] = TEXT_KEYS) -> Column:
    """The documents of a JSON list, blank texts left out; an empty array where there is none."""
    made = F.transform(_array(items), lambda x, i: document_of(x, i, titles, text_keys))
    return F.coalesce(F.filter(made, lambda d: F.trim(F.coalesce(d["text"], F.lit(""))) != ""), F.array().cast(f"array<{DOCUMENT}>"))


def sample_objects(objects: DataFrame) -> DataFrame:
    """number, s: the JSON text of every sample of a payload (a list, an object with one, or one sample a row), numbered from 1."""
    is_list = F.ltrim("value").startswith("[")
    listed = F.coalesce(*[F.when(F.get_json_object("value", f"$.{k}").startswith("["), F.get_json_object("value", f"$.{k}")) for k in SAMPLE_KEYS])
    own = F.get_json_object("value", "$.question").isNotNull() | F.get_json_object("value", "$.query").isNotNull()
    rows = objects.select(F.explode(F.when(is_list, _array(F.col("value"))).when(own, F.array("value")).otherwise(_array(listed))).alias("s"), *[c for c in objects.columns if c != "value"])
    return numbered(rows.filter(F.ltrim("s").startswith("{")), "number").withColumn("number", F.col("number") + 1)


def samples(objects: DataFrame) -> DataFrame:
    """sample_id, question, answer, answer_aliases, source_dataset, split, documents of samples in their own layout.

    A sample without an id is ``sample_<number>``, in order; of a list of answers the first is the answer and the rest
    are aliases; documents come from the first list there is.
    """
    rows, s = sample_objects(objects), F.col("s")
    answers = F.from_json(F.get_json_object(s, "$.answers"), "array<string>")
    more = F.filter(F.slice(answers, F.lit(2), F.greatest(F.size(answers) - 1, F.lit(0))), lambda x: x != "")
    aliases = F.coalesce(F.from_json(F.get_json_object(s, "$.answer_aliases"), "array<string>"), more)
    lists = F.coalesce(*[F.when(F.get_json_object(s, f"$.{k}").startswith("["), F.get_json_object(s, f"$.{k}")) for k in LIST_KEYS])
    return rows.select(
        F.coalesce(_first(s, ID_KEYS), F.format_string("sample_%04d", "number")).alias("sample_id"), _first(s, ["question", "query"]).alias("question"),
        F.coalesce(F.get_json_object(s, "$.answer"), F.get(answers, F.lit(0)), F.get_json_object(s, "$.gold_answer")).alias("answer"), F.coalesce(aliases, F.array().cast("array<string>")).alias("answer_aliases"),
        _first(s, DATASET_KEYS).alias("source_dataset"), _first(s, ["split", "subset"]).alias("split"), document_list(lists, None, CONTEXT_TEXT_KEYS).alias("documents"))


def support_titles(facts: Column) -> Column:
    """The titles that supporting facts name, given as [[title, sentence]] or as objects with a title, or one of parallel lists."""
    listed = F.transform(_array(facts), lambda x: F.coalesce(F.get(_array(x), F.lit(0)), F.get_json_object(x, "$.title")))
    return F.coalesce(F.when(F.ltrim(facts).startswith("["), listed).otherwise(F.from_json(F.get_json_object(facts, "$.title"), "array<string>")), F.array().cast("array<string>"))


def context_list(context: Column, titles: Column) -> Column:
    """The documents of a context: [[title, [sentence]]], objects, or parallel lists of titles and sentence lists; each knows whether it supports."""
    flagged = lambda i, t, x: F.struct(i.cast("string").alias("idx"), t.alias("title"), x.alias("text"), F.array_contains(titles, t).alias("is_supporting"))
    listed = F.transform(_array(context), lambda x, i: flagged(
        i, F.coalesce(F.when(F.ltrim(x).startswith("["), F.get(_array(x), F.lit(0))).otherwise(F.get_json_object(x, "$.title")), F.concat(F.lit("doc_"), i.cast("string"))),
        F.coalesce(F.when(F.ltrim(x).startswith("["), _joined(F.get(_array(x), F.lit(1)))).otherwise(_joined(_first(x, ["sentences", "text"]))), F.lit(""))))
    names, bodies = F.from_json(F.get_json_object(context, "$.title"), "array<string>"), _array(F.get_json_object(context, "$.sentences"))
    parallel = F.transform(names, lambda t, i: flagged(i, t, F.coalesce(_joined(F.get(bodies, i)), F.lit(""))))
    return F.coalesce(F.when(F.ltrim(context).startswith("["), listed).otherwise(parallel), F.array().cast(f"array<{DOCUMENT}>"))


def _with_context(objects: DataFrame, name: str, digits: int, dataset: str | None) -> DataFrame:
    rows, s = sample_objects(objects), F.col("s")
    titles = support_titles(F.get_json_object(s, "$.supporting_facts"))
    split = F.coalesce(F.get_json_object(s, "$.split"), F.col("split")) if "split" in rows.columns else F.get_json_object(s, "$.split")
    return rows.select(
        F.coalesce(_first(s, ["_id", "id"]), F.format_string(f"{name}_%0{digits}d", "number")).alias("sample_id"), F.coalesce(F.get_json_object(s, "$.question"), F.lit("")).alias("question"),
        F.coalesce(F.get_json_object(s, "$.answer"), F.lit("")).alias("answer"), F.array().cast("array<string>").alias("answer_aliases"), F.lit(dataset).cast("string").alias("source_dataset"), split.alias("split"),
        context_list(F.get_json_object(s, "$.context"), titles).alias("documents"))


def two_wiki(objects: DataFrame) -> DataFrame:
    """Samples whose context is [[title, [sentence]]], with supporting facts [[title, sentence]]."""
    return _with_context(objects, "2wiki", 4, None)


def hotpot(objects: DataFrame) -> DataFrame:
    """Samples whose context is parallel lists (or pairs, or objects); a file's name tells its split."""
    return _with_context(objects, "hotpot", 6, "hotpotqa")


def split_of(path: Column) -> Column:
    """The split that a file's name tells."""
    low = F.lower(F.substring_index(path, "/", -1))
    return F.when(low.contains("validation") | low.contains("dev"), "validation").when(low.contains("train"), "train").otherwise("")


def detect_format(path: str, first_keys: set[str] = frozenset()) -> str:
    """The layout of a sample file, by its name and then by the members of its first sample."""
    if path.endswith(".parquet") or any(c in path.rsplit("/", 1)[-1] for c in "*?[]"):
        return "hotpot_parquet"
    if path.endswith(".jsonl"):
        return "canonical_jsonl"
    return "2wiki_json" if {"context", "supporting_facts"} <= first_keys else "canonical_json"


def load_samples(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """The samples of a file, a glob or a folder of Parquet files, in whichever of the layouts ``kind`` names or they have."""
    objects = None
    if kind == "auto":
        kind = detect_format(path)
        if kind == "canonical_json":
            objects = read_objects(spark, path)
            first = sample_objects(objects).filter("number = 1").select(F.json_object_keys("s")).collect()
            kind = detect_format(path, set(first[0][0] or ()) if first else frozenset())
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of the layouts {', '.join(FORMATS)}")
    if kind == "hotpot_parquet":
        rows = spark.read.parquet(path)
        return hotpot(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), split_of(F.input_file_name()).alias("split")))
    objects = objects or read_objects(spark, path)
    return two_wiki(objects) if kind == "2wiki_json" else samples(objects)


def parse_spec(spec: str) -> tuple[str, str, str, str]:
    """(name, path, format, split) of ``path``, ``name:path``, ``name:path:format`` or ``name:path:format:split``.

    A colon before // is part of the path, as in hdfs://host:8020/folder.
    """
    parts = [p.replace("\0", ":") for p in re.sub(r":(?=//)|(?<=//)([^/:]*):(?=\d+(?:/|$))", lambda m: f"{m.group(1) or ''}\0", spec).split(":")]
    if len(parts) == 1:
        parts = [re.sub(r"\.\w+$", "", parts[0].rstrip("/").rsplit("/", 1)[-1]), parts[0]]
    name, path, kind, *split = [*parts, "auto"][: max(3, len(parts))]
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name.strip()).strip("_.-") or "dataset", path, kind or "auto", ":".join(split)


def of_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of a split; dev and validation are one."""
    low = split.lower()
    names = ["dev", "valid", "validation"] if low in ("dev", "valid", "validation") else [low]
    return rows.filter(F.lower("split").isin(names)) if low else rows


def union_specs(spark: SparkSession, specs: list[str]) -> DataFrame:
    """Samples of several specifications (``parse_spec``), with each one's name as source_dataset."""
    parts = []
    for name, path, kind, split in map(parse_spec, specs):
        parts.append(of_split(load_samples(spark, path, kind), split).withColumn("source_dataset", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def queries(objects: DataFrame, text: str | None = None) -> DataFrame:
    """query, sub_questions of a payload: the text given, else its question or query, with the questions of its decomposition."""
    parts = F.filter(F.transform(_array(F.get_json_object("value", "$.question_decomposition")), lambda x: F.coalesce(F.get_json_object(x, "$.question"), F.when(~F.ltrim(x).startswith("{"), x))), lambda x: x.isNotNull())
    asked = F.lit(text) if text else _first(F.col("value"), ["question", "query"])
    return objects.filter(F.ltrim("value").startswith("{") if not text else F.lit(True)).select(asked.alias("query"), F.coalesce(parts, F.array().cast("array<string>")).alias("sub_questions")).filter("query is not null")


def dataset_name(rows: DataFrame, path: str) -> str:
    """The most frequent dataset name of the rows, or what the file's name says."""
    best = rows.filter(F.trim(F.coalesce("source_dataset", F.lit(""))) != "").groupBy("source_dataset").count().orderBy(F.desc("count"), "source_dataset").limit(1).collect()
    return best[0][0] if best else DATASET_SUFFIX.sub("", re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1]))


#: The file that stands beside the tables of an index once all of them are there.
COMPLETE = "complete.json"


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """Every index table as Parquet, partitioned by corpus, with the number of nodes of each layer in ``summary``.

    Only the corpora in ``index`` are replaced. One that has lost all rows of some table loses that table's partition.
    """
    layers = index["nodes"].groupBy("corpus_id").agg(*[F.count_if(F.col("node_type") == k).alias(f"{k}_nodes") for k in ("chunk", "sentence", "entity")])
    counts = layers.join(index["facts"].groupBy("corpus_id").agg(F.count("*").alias("facts")), "corpus_id", "left").join(index["edges"].groupBy("corpus_id").agg(F.count("*").alias("edges")), "corpus_id", "left").na.fill(0)
    spark = counts.sparkSession
    _delete(spark, f"{path}/{COMPLETE}")
    corpora = stored(counts)
    for name, rows in {**index, "summary": corpora}.items():
        kept = stored(rows)
        gone = [r[0] for r in corpora.select("corpus_id").join(kept.select("corpus_id").distinct(), "corpus_id", "left_anti").collect()]
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id").parquet(f"{path}/{name}")
        for corpus in gone:
            part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(corpus)
            _delete(spark, f"{path}/{name}/corpus_id={part}")
    write_json(spark, f"{path}/{COMPLETE}", sorted(index))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def read_index(spark: SparkSession, path: str, names: tuple[str, ...] = ("chunks", "sentences", "mentions", "entities", "facts", "edges", "nodes")) -> dict[str, DataFrame]:
    """The tables that ``write_index`` wrote; a filter on corpus_id reads only those partitions."""
    return {n: spark.read.schema(spark.read.parquet(f"{path}/{n}").schema).option("basePath", f"{path}/{n}").parquet(f"{path}/{n}").withColumn("corpus_id", F.col("corpus_id").cast("string")) for n in names}


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small object of the driver (a manifest, settings) as one JSON file."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    """What ``write_json`` wrote, or None if there is no such file."""
    fs, at = _file_system(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(at) else None


def write_manifest(spark: SparkSession, path: str, **members) -> None:
    """The files of a run's manifest, one for each member (config, sampled_queries, corpus_manifest, mode_consistency ...)."""
    for name, value in members.items():
        write_json(spark, f"{path}/{name}.json", value)


def index_is_current(spark: SparkSession, path: str, manifest: dict, keys: tuple[str, ...] = ()) -> bool:
    """Whether an index at ``path`` is complete and was built as ``manifest`` says, on the members ``keys`` (or all)."""
    fs, at = _file_system(spark, f"{path}/{COMPLETE}")
    kept = read_json(spark, f"{path}/manifest.json")
    return bool(fs.exists(at) and kept is not None and all(kept.get(k) == manifest.get(k) for k in keys or manifest))


def union_header(parts: list[DataFrame]) -> DataFrame:
    """Tables of different columns as one, with every column in the order in which it is first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_metrics(rows: DataFrame, path: str, order: list[str]) -> None:
    """Metrics as JSON Lines and as CSV: columns in ``order``, then the ``edge_`` columns sorted."""
    edges = sorted(c for c in rows.columns if c.startswith("edge_") and c not in order)
    told = stored(rows.select(*[c for c in order if c in rows.columns], *edges))
    write_rows(told, f"{path}/metrics_json", "json", "overwrite")
    write_rows(told, f"{path}/metrics_csv", "csv", "overwrite")


def write_rows(rows: DataFrame, path: str, kind: str = "json", mode: str = "append") -> None:
    """Results as JSON Lines, CSV with a header, or Parquet."""
    writer = rows.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
