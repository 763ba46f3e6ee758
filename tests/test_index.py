import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import vector as vx
from lexforge.operators import chunking, index
from lexforge.operators.cache import Session
from lexforge.plans import experiment, registry, strategies

CHUNKS = "id string, note_id string, content string, tags array<string>, strategy string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, i.split("::")[0], c, ["t"], "naive") for i, c in rows], CHUNKS)


def cat_and_dog(texts):
    """Cannot encode what names neither."""
    return np.array([[1.0, 0.0] if "cat" in t else [0.0, 1.0] if "dog" in t else [np.nan, 0.0] for t in texts])


def vectors(df):
    return {r.chunk_id: [round(x, 5) for x in r.vector] for r in df.collect()}


def test_only_chunks_without_vectors_are_encoded(spark):
    c = chunks(spark, [("a::0", "cat"), ("b::0", "dog"), ("c::0", None), ("d::0", "bird")])
    old = spark.createDataFrame([("a::0", [0.5, 0.5], 2), ("z::0", [0.1, 0.1], 2)], "chunk_id string, vector array<float>, dim int")
    assert vectors(index.update(old, c, cat_and_dog)) == {"a::0": [0.5, 0.5], "z::0": [0.1, 0.1], "b::0": [0.0, 1.0]}
    assert vectors(index.update(old, c, cat_and_dog, force=True)) == {"a::0": [1.0, 0.0], "z::0": [0.1, 0.1], "b::0": [0.0, 1.0]}
    assert vectors(index.load(old, c)) == {"a::0": [0.5, 0.5]}
    assert index.build(c.limit(0), cat_and_dog).count() == 0


def test_vectors_have_the_shape_of_their_units(spark):
    d = spark.createDataFrame([(1, [["cat", "dog"], []]), (2, [["bird"], ["dog", None]]), (3, []), (4, None)], "k int, u array<array<string>>")
    got = {r.k: r.v for r in index.with_unit_vectors(d, "u", "v", cat_and_dog).collect()}
    assert got == {1: [[[1.0, 0.0], [0.0, 1.0]], []], 2: [[None], [[0.0, 1.0], None]], 3: [], 4: None}
    m = index.hashed_encoder(["one two", "two one two", "", "x"])
    assert np.allclose(m[0], m[1]) and np.isclose(np.linalg.norm(m[0]), 1) and not m[2:].any()


def test_plugins_equal_the_table_form(spark):
    text = "The cat sat. The cat ran. A dog barked at length in the yard. The dog slept there all day. The cat ate. The cat drank milk."
    n = spark.createDataFrame([("n", text), ("one", "Only cat."), ("none", " ")], "note_id string, content string")
    encoder = index.hashed_encoder
    u = n.select("note_id", F.posexplode(chunking.sentences(F.col("content"))).alias("pos", "unit")).withColumn("vector", index.encoded(F.col("unit"), encoder).cast("array<double>"))
    for stages, table in (
        ([("convolution", {"threshold": 0.6})], chunking.convolution(u, vx.kernel("gaussian", 5), 0.6)),
        ([("document", {}), ("semantic", {"threshold": 0.2})], chunking.semantic(u, 0.2)),
    ):
        got = {r.note_id: (r.fragments, [tuple(b) for b in r.stages[-1].boundaries]) for r in registry.with_stages(n, stages, encoder).collect()}
        want = {r.note_id: (r.fragments, [tuple(b) for b in r.boundaries]) for r in table.collect()}
        assert {k: v for k, v in got.items() if v[0]} == want and got["none"] == ([], []) and len(got["n"][0]) > 1
        assert len(got["n"][1]) == len(got["n"][0]) - 1
    assert registry.name([("structural", {}), ("convolution", {"size": 3})]) == "structural → convolution(gaussian,3)"


def test_semantic_keeps_a_least_number_of_sentences(spark):
    n = spark.createDataFrame([("n", "A cat. A dog. A cat. A dog. A cat.")], "note_id string, content string")
    got = lambda least: registry.run(n, [("semantic", {"threshold": 0.5, "min_sentences": least})], cat_and_dog).first().fragments
    assert got(1) == ["A cat.", "A dog.", "A cat.", "A dog.", "A cat."] and got(2) == ["A cat. A dog.", "A cat. A dog.", "A cat."]


def test_without_an_encoder(spark):
    n = spark.createDataFrame([("n", "one\n\ntwo\n\n")], "note_id string, content string")
    assert registry.run(n, [("convolution", {})]).first().fragments == ["one", "two"]
    with pytest.raises(RuntimeError):
        registry.run(n, [("semantic", {})])


def test_boundaries_move_by_the_fragments_before(spark):
    n = spark.createDataFrame([("n", "A cat is here today, as ever.\n\nThe cat is still there, I see. Now a dog has come along, at last.")], "note_id string, content string")
    r = registry.with_stages(n, [("paragraphs", {}), ("convolution", {"kernel": "box", "size": 1})], cat_and_dog).first()
    assert r.fragments == ["A cat is here today, as ever.", "The cat is still there, I see.", "Now a dog has come along, at last."]
    assert [(s.chunker, s.n_input, s.n_output) for s in r.stages] == [("paragraphs", 1, 2), ("convolution", 2, 3)]
    assert [(b.position, b.confidence, b.reason) for b in r.stages[1].boundaries] == [(len(r.fragments[0]) + len(r.fragments[1]), 1.0, "kernel_valley(depth=0.000)")]


def corpus(spark):
    rows = [("c%02d::0" % k, w) for k, w in enumerate(["red fox", "red hen", "blue whale", "blue jay", "green frog", "red green", "whale song", ""])]
    asked = ["the red fox", "blue songs", "a red hen", "frog", "nothing known", "blue whale"]
    return chunks(spark, rows), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), rows, asked


def searched(rows, text, k=2, threshold=0.1):
    q = index.hashed_encoder([text])[0].astype(np.float32).astype(float)
    m = index.hashed_encoder([f"{i} t {c}" for i, c in rows]).astype(np.float32).astype(float)
    best = sorted((-float((v * q).sum()), i) for v, (i, _) in zip(m, rows) if float((v * q).sum()) >= threshold)
    return [i for _, i in best[:k]]


def test_strategies_equal_search_and_replay(spark):
    c, q, rows, asked = corpus(spark)
    none = spark.createDataFrame([], "chunk_id string, vector array<float>, dim int")
    part = index.build(c.where("id < 'c03'"), index.hashed_encoder)  # the rest is encoded on the fly
    for held in (none, part):
        got = {}
        for r in registry.get_strategy("embeddings")(q, c, held, index.hashed_encoder, 2, threshold=0.1, chunking="naive").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {k: x for k, t in enumerate(asked) if (x := searched(rows, t))}
    assert registry.get_strategy("embeddings")(q, c, none, index.hashed_encoder, chunking="other").count() == 0
    for exact in (False, True):
        session, want = Session(50, 3, exact), {}
        for k, t in enumerate(asked):
            hit, served = session.ask([w for w in t.split() if len(w) > 1], lambda t=t: searched(rows, t))
            if served:
                want[k] = (hit, served)
        got = {}
        for r in registry.get_strategy("splay")(q, c, part, index.hashed_encoder, 2, threshold=0.1, exact=exact).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, (r.cache_hit, []))[1].append(r.chunk_id)
        assert got == want and any(h for h, _ in got.values()) != exact
    with pytest.raises(KeyError):
        registry.get_strategy("none")


def test_matrix_compares_chunkers_and_strategies(spark):
    n = spark.createDataFrame([("a", "red fox. red hen runs.", ["t"], 5), ("b", "blue whale. whale song.", ["t"], 5)], "id string, content string, tags array<string>, priority int")
    q = spark.createDataFrame([(1, "red hen", ["a::"]), (2, "whale", ["b::"]), (3, "red", ["a::"])], "query_id int, query string, relevant array<string>")
    runs = [{"name": f"{s}-{t}", "stages": [(s, {})], "strategy": t, "top_k": 1} for s in ("document", "sentences") for t in ("embeddings", "splay")]
    from lexforge.operators import evaluation

    r = experiment.run_matrix(n, q, runs, index.hashed_encoder, scorer=evaluation.overlap_scorer).cache()
    got = {(x.run, x.query_id): x for x in r.collect()}
    assert got["document-embeddings", 1].contents == ["red fox. red hen runs."] and got["sentences-embeddings", 2].retrieved[0].startswith("b::")
    assert got["sentences-splay", 3].cache_hit and got["sentences-splay", 3].contents == got["sentences-splay", 1].contents
    compared = experiment.experiment(r.withColumn("latency_ms", F.lit(0.0)))
    assert compared.count() == len({k for k, _ in got}) and compared.where("best_mean_score").count() > 0
    assert evaluation.ir_metrics(r.where("run = 'document-embeddings'"), 1).where("recall = 1").count() >= 2


def test_added_notes_are_stored_and_cut(spark):
    from lexforge.operators import store

    new = spark.createDataFrame([("n", "# Title\nhello\n## Part\nbody", ["Big", "small"], 7)], "id string, content string, tags array<string>, priority int")
    notes = spark.createDataFrame([], "id string, title string, content string, tags array<string>, priority int, content_hash string, created_at string, updated_at string")
    old = store.with_chunk_facts(spark.createDataFrame([("n::part", "n", "Part", "older", "sections", 1), ("m::x", "m", "X", "x", "sections", 0)], "id string, note_id string, title string, content string, strategy string, order int"))
    after, cut = experiment.add_notes(new, notes, old, F.lit("now"))
    assert [(r.title, r.tags, r.created_at) for r in after.collect()] == [("Title", ["big", "small"], "now")]
    assert {r.id: r.content for r in cut.collect()} == {"m::x": "x", "n::introduccion": "# Title\nhello", "n::part": "body"}


def test_listed_tools(spark, tmp_path):
    from lexforge.sources import notes as src

    for name, tags in (("one", "[A, b]"), ("two", "x, y"), ("_off", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.md").write_text(f"---\nname: tool {name}\ntags: {tags}\n---\nDoes {name}.")
    get = lambda: {r.name: (r.tags, r.description) for r in src.read_tools(spark, str(tmp_path)).collect()}
    assert get() == {"tool one": (["a", "b"], "Does one."), "tool two": ([], "Does two.")}
    (tmp_path / "_registry.json").write_text('{"tools": ["two", {"path": "_off"}, {"name": "gone"}, 7]}')
    assert set(get()) == {"tool two", "tool _off"}
    (tmp_path / "_registry.json").write_text("broken")
    assert get() == {}


def test_long_paragraphs_are_split_where_their_windows_differ(spark):
    cats, dogs = "cat " * 60, "dog " * 60
    body = f"short cat\n\n{cats}{dogs}\n\n" + "cat " * 50
    n = spark.createDataFrame([("n", f"## A\n{body}"), ("m", "## B\n" + "cat " * 90)], "note_id string, content string")
    got = {}
    for r in chunking.section_chunks(n, 30, cat_and_dog, window_tokens=10, stride_tokens=10, threshold=0.5).orderBy("note_id", "order").collect():
        got.setdefault(r.note_id, []).append((r.title, r.content))
    # windows of 40 characters: cats end at 240
    assert got == {"m": [("B", ("cat " * 90).strip())], "n": [("A (parte 1)", "short cat"), ("A (parte 2)", cats.strip()), ("A (parte 3)", dogs.strip()), ("A (parte 4)", ("cat " * 50).strip())]}
    assert {r.content for r in chunking.section_chunks(n, 30).where("note_id = 'n'").collect()} == {"short cat", (cats + dogs).strip(), ("cat " * 50).strip()}
