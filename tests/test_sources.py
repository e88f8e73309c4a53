"""Loaders, sinks and the growing index."""

import json

from lodestrand.operators import graph
from lodestrand.sources import payloads
from lodestrand.sources.tables import table
from lodestrand.streaming import incremental


def test_documents(spark, tmp_path):
    items = ["plain text", ["Pair", ["one", "two"]], {"name": "N", "contents": "body", "idx": 7, "is_supporting": True}, {"id": "S", "sentences": ["a", "b"]}, {"text": "  "}]
    for value in (items, {"passages": items}, {"docs": items, "question": "q"}):
        (tmp_path / "c.json").write_text(json.dumps(value))
        got = [(r.title, r.text, r.idx) for r in payloads.documents(payloads.read_objects(spark, str(tmp_path / "c.json"))).orderBy("document_index").collect()]
        assert got == [("doc_0", "plain text", None), ("Pair", "one two", None), ("N", "body", "7"), ("S", "a b", None)]


def test_samples(spark, tmp_path):
    rows = [{"_id": "x", "query": "q?", "answers": ["A", "B"], "split": "dev"}, {"question": "r?", "gold_answer": "G", "dataset": "d"}]
    (tmp_path / "s.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    for name in ("s.json", "s.jsonl"):
        got = payloads.samples(payloads.read_objects(spark, str(tmp_path / name))).orderBy("question").collect()
        assert [(r.question, r.answer, r.answer_aliases, r.split) for r in got] == [("q?", "A", ["B"], "dev"), ("r?", "G", [], None)] and got[0].sample_id == "x"
    assert payloads.detect_format("a.jsonl") == "canonical_jsonl" and payloads.detect_format("a.json", {"context", "supporting_facts"}) == "2wiki_json"
    assert payloads.dataset_name(payloads.samples(payloads.read_objects(spark, str(tmp_path / "s.jsonl"))), "x/hotpot_dev.json") == "d"


def test_sample_numbers(spark, tmp_path):
    """Samples without an id are numbered in a row, over however many partitions."""
    for i in range(3):
        (tmp_path / f"p{i}.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}{k}?", "answer": "a"}) for k in range(4)))
    parts = [payloads.read_objects(spark, str(tmp_path / f"p{i}.jsonl")) for i in range(3)]
    got = payloads.samples(parts[0].union(parts[1]).union(parts[2])).collect()
    assert sorted((r.sample_id, r.question) for r in got) == [(f"sample_{4 * i + k + 1:04d}", f"q{i}{k}?") for i in range(3) for k in range(4)]


def test_layouts(spark, tmp_path):
    """The same two questions in every layout give the same documents."""
    context = [["Ada", ["She wrote.", "She read."]], ["Bob", ["He ran."]]]
    want = [("0", "Ada", "She wrote. She read.", True), ("1", "Bob", "He ran.", False)]
    wiki = [{"_id": "w", "question": "q?", "answer": "A", "context": context, "supporting_facts": [["Ada", 0]]}, {"question": "r?", "context": [], "supporting_facts": []}]
    (tmp_path / "w.json").write_text(json.dumps(wiki))
    got = payloads.load_samples(spark, str(tmp_path / "w.json")).orderBy("question").collect()
    assert [tuple(d) for d in got[0].documents] == want and got[0].sample_id == "w" and (got[1].sample_id, got[1].documents, got[1].answer) == ("2wiki_0002", [], "")
    schema = "id string, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
    rows = spark.createDataFrame([("h", "q?", "A", (["Ada", "Bob"], [["She wrote.", "She read."], ["He ran."]]), (["Ada"], [0]))], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "h-validation.parquet"))
    import glob
    import shutil

    (tmp_path / "hotpot").mkdir()
    shutil.copy(glob.glob(f"{tmp_path}/h-validation.parquet/*.parquet")[0], tmp_path / "hotpot" / "validation-0.parquet")
    shutil.copy(glob.glob(f"{tmp_path}/h-validation.parquet/*.parquet")[0], tmp_path / "hotpot" / "train-0.parquet")
    got = payloads.load_samples(spark, str(tmp_path / "hotpot" / "*.parquet")).collect()
    assert {r.split for r in got} == {"validation", "train"} and all([tuple(d) for d in r.documents] == want and r.source_dataset == "hotpotqa" for r in got)
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "m", "question": "q?", "answer": "A", "dataset": "m", "split": "dev", "paragraphs": [{"idx": 4, "title": "Ada", "paragraph_text": "She wrote.", "is_supporting": True}]}))
    got = payloads.load_samples(spark, str(tmp_path / "m.jsonl"), "musique_jsonl").collect()
    assert [tuple(d) for d in got[0].documents] == [("4", "Ada", "She wrote.", True)]
    both = payloads.union_specs(spark, [f"one:{tmp_path}/w.json:2wiki_json", f"two:file://{tmp_path}/m.jsonl::validation", f"none:{tmp_path}/m.jsonl:auto:train"])
    assert sorted((r.source_dataset, r.sample_id) for r in both.collect()) == [("one", "2wiki_0002"), ("one", "w"), ("two", "m")]
    assert payloads.parse_spec("a:hdfs://n:8020/d/x.json:2wiki_json:dev") == ("a", "hdfs://n:8020/d/x.json", "2wiki_json", "dev") and payloads.parse_spec("d/x_dev.json") == ("x_dev", "d/x_dev.json", "auto", "")


def test_queries(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"question": "Who?", "question_decomposition": [{"question": "a?"}, "b?"]}))
    objects = payloads.read_objects(spark, str(tmp_path / "q.json"))
    assert tuple(payloads.queries(objects).first()) == ("Who?", ["a?", "b?"]) and payloads.queries(objects, "given").first().query == "given"


def test_two_corpora(spark, data, tmp_path):
    """Indexing one corpus leaves the others at the same path alone, and replaces all of its own."""
    docs = table(spark, data, "documents")
    names = [r[0] for r in docs.filter("corpus_id is not null").select("corpus_id").distinct().orderBy("corpus_id").limit(2).collect()]
    path = str(tmp_path / "i")
    for n in names:
        payloads.write_index(graph.build(docs.filter(docs.corpus_id == n)), path)
    back = payloads.read_index(spark, path)
    assert {r[0] for r in back["chunks"].select("corpus_id").distinct().collect()} == set(names)
    before = back["nodes"].filter(back["nodes"].corpus_id == names[1]).count()
    bare = spark.createDataFrame([(names[0], 1, 0, "t", "nothing that is named here.")], "corpus_id string, doc_id long, document_index int, title string, text string")
    payloads.write_index(graph.build(bare), path)
    back = payloads.read_index(spark, path)
    assert back["facts"].filter(back["facts"].corpus_id == names[0]).count() == 0 and back["chunks"].filter(back["chunks"].corpus_id == names[0]).count() == 1
    assert back["nodes"].filter(back["nodes"].corpus_id == names[1]).count() == before
    payloads.write_manifest(spark, path, manifest={"corpus": names, "threshold": 0.8})
    assert payloads.index_is_current(spark, path, {"corpus": names, "threshold": 0.7}, ("corpus",)) and not payloads.index_is_current(spark, path, {"threshold": 0.7}) and not payloads.index_is_current(spark, str(tmp_path / "none"), {})


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "variant string, edge_b int"), spark.createDataFrame([("y", 2, 0.5)], "variant string, edge_a int, f1 double")
    both = payloads.union_header([a, b])
    assert both.columns == ["variant", "edge_b", "edge_a", "f1"]
    payloads.write_metrics(both, str(tmp_path / "m"), ["variant", "em", "f1"])
    assert spark.read.csv(str(tmp_path / "m/metrics_csv"), header=True).columns == ["variant", "f1", "edge_a", "edge_b"] and spark.read.json(str(tmp_path / "m/metrics_json")).count() == 2


def test_shared_folder(spark):
    """Off one machine a shared folder must be named."""
    import pytest

    from lodestrand import runtime

    class Empty:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(dict)
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(Empty)})())})()

    class Session:
        sparkContext = Context()

    assert runtime._is_local(spark) and not runtime._is_local(Session())
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
    Context.getConf = staticmethod(lambda: {"spark.checkpoint.dir": "hdfs://shared"})
    assert runtime.shared_dir(Session()) == "hdfs://shared"
    assert runtime.tables_dir(spark).endswith(f"/tables/{spark.sparkContext.applicationId}")


def test_index_round_trip(spark, data, tmp_path):
    index = graph.build(table(spark, data, "documents"))
    payloads.write_index({k: v for k, v in index.items() if k != "mentions"}, str(tmp_path / "i"))
    back = payloads.read_index(spark, str(tmp_path / "i"), ("edges", "nodes"))
    assert all(back[k].count() == index[k].count() for k in back)


def test_growing_index(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    docs.repartition(3).write.option("maxRecordsPerFile", 20).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    incremental.grow_index(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    grown, whole = incremental.grown_index(spark, str(tmp_path / "out")), graph.build(docs)
    assert all(grown[k].count() == whole[k].count() for k in ("sentences", "facts", "entities", "edges", "nodes"))
