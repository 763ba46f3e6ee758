import json

from pyspark.sql import functions as F

from lexforge.operators import evaluation
from lexforge.sources import notes, sinks
from lexforge.streaming import watch


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.md").write_text(text)


def test_notes_of_files(spark, tmp_path):
    put(tmp_path, full="---\nid: mi-nota\ntags: [Uno, dos , '']\npriority: 99\n---\n# Hola\ntexto", bare="sin nada", comma="---\ntags: A, b\npriority: x\n---\nc", block="---\ntags:\n  - Xy\n  - z\n---\n\nd", empty="---\n---\ne")
    (tmp_path / "other.txt").write_text("no")
    got = {r.id: (r.title, r.tags, r.priority, r.content) for r in notes.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"mi-nota": ("Hola", ["uno", "dos"], 10, "# Hola\ntexto"), "bare": ("bare", [], 5, "sin nada"), "comma": ("comma", ["a", "b"], 5, "c"), "block": ("block", ["xy", "z"], 5, "d"), "empty": ("empty", [], 5, "e")}
    loose = {r.id: (r.tags, r.priority) for r in notes.read_notes(spark, str(tmp_path), strict=False).collect()}
    assert loose["mi-nota"] == (["uno", "dos"], 99) and loose["comma"] == ([], 5)


def test_catalogues_override(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    put(a, s="---\nname: s\ndescription: first\n---\nx", only="body text")
    put(b, s="---\nname: s\ndescription: second\n---\ny")
    got = {r.name: (r.description, r.origin) for r in notes.read_catalogue(spark, [str(a), str(b)]).collect()}
    assert got == {"s": ("second", str(b)), "only": ("body text", str(a))}
    tools = tmp_path / "tools"
    for name in ("t1", "_hidden"):
        (tools / name).mkdir(parents=True)
        (tools / name / "meta.md").write_text("---\ntags: [X]\n---\nDoes things")
    assert [(r.name, r.description, r.tags) for r in notes.read_tools(spark, str(tools)).collect()] == [("t1", "Does things", ["x"])]


def test_query_sets_and_judge_caches(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "q1", "query": "a", "relevant_chunk_ids": ["x"]}]}))
    assert [(r.id, r.relevant) for r in notes.read_queries(spark, str(tmp_path / "q.json")).collect()] == [("q1", ["x"])]
    assert notes.read_queries(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"h": {"faithfulness": 1.0, "answer_relevancy": 0.5, "context_precision": 0.2, "context_recall": 0.1}}))
    (tmp_path / "bad.json").write_text("{")
    assert [tuple(r) for r in notes.read_judge_cache(spark, str(tmp_path / "c.json")).collect()] == [("h", 1.0, 0.5, 0.2, 0.1)]
    assert notes.read_judge_cache(spark, str(tmp_path / "bad.json")).count() == 0


def test_chunk_tables_replace_one_strategy(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunk = lambda *rows: spark.createDataFrame(rows, "id string, strategy string")
    sinks.save_chunks(chunk(("a", "x"), ("b", "y")), path)
    sinks.replace_strategy(chunk(("c", "y")), path)
    assert sorted((r.id, r.strategy) for r in sinks.load_chunks(spark, path).collect()) == [("a", "x"), ("c", "y")]
    assert [r.id for r in sinks.load_chunks(spark, path, "y").collect()] == ["c"]


def test_reports(spark, tmp_path):
    means = "mean_latency_ms double, mean_context_tokens double, mean_score double, mean_precision double, mean_recall double, mean_e_tok double"
    summary = spark.createDataFrame([("a", 1.0, 5.0, 0.5, 0.1, 0.2, 9.0), ("b", 2.0, 4.0, 0.25, 0.1, 0.1, 8.0)], "run string, " + means)
    text = evaluation.comparison_markdown(evaluation.compare(summary))
    assert "| a | 9 | **1** | 5 | **0.5** | **0.1** | **0.2** |" in text and "| b | **8** |" in text
    sinks.write_summary_json(summary, str(tmp_path / "s"))
    assert {json.loads(r.value)["run"] for r in spark.read.text(str(tmp_path / "s")).collect()} == {"a", "b"}


def test_means_that_differ_in_their_last_bits_are_equally_good(spark):
    names = list(evaluation.BEST)
    means = lambda run, x: spark.range(1).select(F.lit(run).alias("run"), *[F.lit(x).alias(c) for c in names])
    got = {r.run: [r[f"best_{c}"] for c in names] for r in evaluation.compare(means("a", 0.1 + 0.2).union(means("b", 0.3)).union(means("c", 0.30001))).collect()}
    assert got == {"a": [True] * 3 + [False] * 3, "b": [True] * 3 + [False] * 3, "c": [False] * 3 + [True] * 3}


def test_notes_as_a_stream(spark, tmp_path):
    inbox, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    inbox.mkdir()
    put(inbox, a="one")
    watch.follow(watch.note_stream(spark, str(inbox)), table, check).awaitTermination()
    put(inbox, b="---\nid: a\n---\ntwo", c="three")
    watch.follow(watch.note_stream(spark, str(inbox)), table, check).awaitTermination()
    assert {(r.id, r.content) for r in watch.current(spark, table).collect()} == {("a", "two"), ("c", "three")}


def test_cache_over_a_query_stream(spark, tmp_path):
    schema = "session long, seq long, words array<string>, results array<string>"
    for n, rows in enumerate(([(1, 1, ["cat"], ["a"])], [(1, 2, ["cat"], ["b"]), (2, 1, ["cat"], ["c"])])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        q = watch.cached_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.session, r.seq): (r.hit, r.served) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (False, ["a"]), (1, 2): (True, ["a"]), (2, 1): (False, ["c"])}
