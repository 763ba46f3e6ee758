import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx
from lexforge.operators import cache, chunking, evaluation, graph, retrieval, store
from lexforge.plans import registry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def sections(spark, text):
    return [(s.title, s.level, s.body) for s in one(spark, chunking.sections(F.col("t")), t=text)]


def test_sections_keep_and_lose_what_they_should(spark):
    assert sections(spark, "") == [("introduccion", 0, "")]
    assert sections(spark, "# top\nintro\n## A\none\n### B\ntwo") == [("introduccion", 0, "# top\nintro"), ("A", 2, "one"), ("B", 3, "two")]
    assert sections(spark, "## A\n## B\nx") == [("B", 2, "x")]
    assert sections(spark, "a\n```bash\nls\n```\nb\n---\nc") == [("introduccion", 0, "a"), ("codigo bash", 0, "ls"), ("continuacion", 0, "b"), ("continuacion", 0, "c")]
    assert sections(spark, "a\n```\n```\n## H\nb") == [("introduccion", 0, "a"), ("codigo", 0, ""), ("H", 2, "b")]
    assert sections(spark, "a\n```\n## not a header\nlost") == [("introduccion", 0, "a")]


def test_section_chunks_merge_split_and_fall_back(spark):
    rows = [("n", "## A\nbody\n### B\nmore"), ("m", "## A\n" + "\n\n".join("p" * 40 for _ in range(3))), ("e", "  ")]
    got = [(r.chunk_id, r.title, r.content) for r in chunking.section_chunks(spark.createDataFrame(rows, "note_id string, content string"), 20).orderBy("note_id", "order").collect()]
    assert got == [("e::introduccion", "introduccion", ""), ("m::a-parte-1", "A (parte 1)", "p" * 40 + "\n\n" + "p" * 40), ("m::a-parte-2", "A (parte 2)", "p" * 40), ("n::a", "A", "body\n\n### B\nmore")]


def test_structural_drops_short_fragments(spark):
    got = one(spark, chunking.structural(F.col("t"), 512, 20), t="## A\nshort\n## B\nlong enough to be kept here")
    assert [(x.content, x.level) for x in got] == [("long enough to be kept here", 2)]


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_naive_equals_greedy_filling(spark, limit):
    rng = random.Random(limit)
    text = "  ".join("x" * rng.randint(1, 15) + rng.choice(["", "\n", "é", "😀"]) for _ in range(80))
    out, used = [], 0
    for w in text.split():
        if out and used + len(w) + 1 <= limit * 4:
            out[-1].append(w)
            used += len(w) + 1
        else:
            out.append([w])
            used = len(w) + 1
    assert one(spark, chunking.naive(F.col("t"), limit), t=text) == [" ".join(x) for x in out]
    assert one(spark, chunking.naive_boundaries(F.col("t"), limit), t=text) == np.cumsum([len(x) for x in out])[:-1].tolist()
    assert one(spark, chunking.naive(F.col("t"), limit), t=" ") == []


@pytest.mark.parametrize("weights", [vx.kernel("gaussian", 5), vx.kernel("edge_detect", 4), vx.kernel("custom", weights=[1, 2, 3])])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_convolution_equals_numpy(spark, weights, n):
    signal = np.random.default_rng(n).random(n).tolist()
    got = one(spark, vx.convolve_same(F.col("s"), weights), s=signal)
    assert np.allclose(got, np.convolve(signal, weights, "same"))


def test_valleys_and_kernels(spark):
    for signal, threshold, want in (([0.8, 0.8, 0.2, 0.8, 0.8], 0.5, [2]), ([0.9, 0.2, 0.9, 0.9, 0.1, 0.9], 0.5, [1, 4]), ([0.5] * 4, 0.5, [])):
        assert one(spark, vx.valleys(F.col("s"), threshold), s=signal) == want
    assert abs(sum(vx.kernel("gaussian", 7)) - 1) < 1e-9 and vx.kernel("box", 4) == [0.25] * 4
    with pytest.raises(ValueError):
        vx.kernel("wavelet")


def test_text_functions(spark):
    assert one(spark, tx.slugify(F.col("t")), t="  Más Código: v2  ") == "ms-cdigo-v2"
    assert one(spark, tx.slugify(F.col("t")), t="¿¡!?") == "sin-titulo"
    assert one(spark, tx.normalize(F.col("t")), t="ÁÉÍ ñandú é") == "aei nandu e"
    assert one(spark, tx.tokens(F.col("t")), t="él está aquí, y 42") == ["él", "está", "aquí", "42"]
    assert [one(spark, tx.parse_score(F.col("t")), t=t) for t in ("score: 0.75!", "7", "-2", "none", "")] == [0.75, 1.0, 0.0, 0.0, 0.0]
    a, b = (one(spark, tx.context_hash(F.col("q"), F.col("c")), q=q, c=c) for q, c in (("A  b", ["x", "y  z"]), ("a b", ["y z", "x"])))
    assert a == b


def test_budget_passes_over_what_does_not_fit(spark):
    items = F.array(*[F.struct(F.lit(n).alias("tokens")) for n in (5, 9, 3, 2)])
    assert [x.tokens for x in one(spark, retrieval.within_budget(items, 10), t="")] == [5, 3, 2]


def test_ir_metrics_hand_made(spark):
    rows = [("a", ["x::1", "y", "z"], ["x", "z"]), ("b", ["q"], ["x"]), ("c", [], ["x"]), ("d", ["x"], [])]
    got = {r.query_id: r for r in evaluation.ir_metrics(spark.createDataFrame(rows, "query_id string, retrieved array<string>, relevant array<string>"), 3).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].mrr) == (2 / 3, 1.0, 1.0)
    assert abs(got["a"].ndcg - (1 + 1 / 2) / (1 + 1 / np.log2(3))) < 1e-9
    assert all(got[k].recall == got[k].ndcg == got[k].mrr == 0 for k in "bcd")


def test_splay_tree_is_a_bounded_search_tree():
    rng, tree, held = random.Random(2), cache.SplayTree(8), {}
    for _ in range(3000):
        k = f"k{rng.randint(0, 30):02d}"
        what = rng.random()
        if what < 0.5:
            before = set(tree.keys())
            tree.insert(k, k + "!")
            gone = (before | {k}) - set(tree.keys())
            assert len(gone) <= 1 and (len(before | {k}) <= 8) == (not gone)
            held[k] = True
            for g in gone:
                held.pop(g)
        elif what < 0.8:
            value, _ = tree.search(k)
            assert value == (k + "!" if k in held else None)
            if value:
                assert tree.root[0] == k
        else:
            assert tree.delete(k) == (held.pop(k, None) is not None)
        assert tree.keys() == sorted(held) and tree.size == len(held)
    assert len(tree.peek(3)) <= 3


def test_cache_serves_what_shares_a_word(spark):
    rows = [(1, 1, ["red", "cat"], ["a"]), (1, 2, ["cat"], ["b"]), (1, 3, ["dog"], ["c"]), (2, 1, ["cat"], ["d"]), (1, 4, [], ["e"])]
    log = spark.createDataFrame(rows, "session long, seq long, words array<string>, results array<string>")
    got = {(r.session, r.seq): (r.hit, r.served) for r in cache.simulate(log).collect()}
    assert got == {(1, 1): (False, ["a"]), (1, 2): (True, ["a"]), (1, 3): (False, ["c"]), (2, 1): (False, ["d"]), (1, 4): (False, ["e"])}


def test_graph_order_and_cycles(spark):
    rows = [(1, "t1", ["t2"], "pending"), (1, "t2", ["t3"], "pending"), (1, "t3", [], "completed"), (2, "a", ["b"], "pending"), (2, "b", ["c"], "pending"), (2, "c", ["a"], "failed"), (3, "x", ["lost", "y", "y"], "pending"), (3, "y", [], "pending")]
    t = spark.createDataFrame(rows, "graph long, id string, depends_on array<string>, status string")
    got = {(r.graph, r.id): (r.place, r.level, r.in_cycle) for r in graph.order(t).collect()}
    assert [got[1, k] for k in ("t3", "t2", "t1")] == [(0, 0, False), (1, 1, False), (2, 2, False)]
    assert all(got[2, k] == (None, None, True) for k in "abc")
    assert got[3, "x"][:2] == (1, 1)
    assert [tuple(r) for r in graph.missing(t).collect()] == [(3, "x", "lost")]
    assert [(r.graph, r.id) for r in graph.next_task(graph.ready(t).join(graph.order(t), ["graph", "id"])).orderBy("graph").collect() if r.graph == 1] == [(1, "t2")]


def test_upsert_keeps_creation(spark):
    schema = "id string, title string, content string, tags array<string>, priority int, content_hash string, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "A", "x", [], 5, "h", "then", "then")], schema)
    new = spark.createDataFrame([("a", "A", "y", [], 5), ("b", "B", "z", [], 5)], "id string, title string, content string, tags array<string>, priority int")
    got = {r.id: (r.content, r.created_at, r.updated_at) for r in store.upsert_notes(old, new, F.lit("now")).collect()}
    assert got == {"a": ("y", "then", "now"), "b": ("z", "now", "now")}


def test_registry(spark):
    assert {"document", "naive", "structural"} <= set(registry.list_chunkers())
    with pytest.raises(KeyError):
        registry.get_chunker("nothing")
    notes = spark.createDataFrame([("n", "aa bb. cc dd. ee")], "note_id string, content string")
    out = registry.run(notes, [("sentences", {}), ("naive", {"max_tokens": 1})]).withColumn("b", registry.boundaries(F.col("fragments"))).first()
    assert out.fragments == ["aa", "bb.", "cc", "dd.", "ee"] and out.b == [2, 5, 7, 10]
