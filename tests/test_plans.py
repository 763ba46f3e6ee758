"""What plans must not do: join, shuffle or work out again what isn't needed."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import index
from lexforge.plans import experiment, queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signals_leave_texts_and_double_vectors_out_of_shuffles(spark):
    for f in (queries.sim_signal, queries.conv_signal):
        assert not [x for x in plan(f(spark, DATA)).splitlines() if "unit#" in x and any(k in x for k in ("Project", "Join", "Window", "Aggregate"))]
    for f in (queries.sim_signal, queries.conv_signal, queries.chunk_convolution, queries.chunk_semantic):
        assert "cast(embedding" not in plan(f(spark, DATA))


def test_chunks_keep_the_facts_of_their_note_without_a_join(spark):
    n = spark.createDataFrame([("n", "a b", ["t"], 5)], "id string, content string, tags array<string>, priority int")
    made = experiment.chunked(n, [("document", {})])
    assert "Join" not in plan(made) and [(r.id, r.note_id, r.tags, r.priority) for r in made.collect()] == [("n::a-b-0", "n", ["t"], 5)]


def test_text_functions_scan_a_text_once(spark):
    d = spark.createDataFrame([(1, "É İ ﬁ 𝅘𝅥𝅮 á"), (2, "Plain!"), (3, None), (4, "!?")], "k int, t string")
    assert plan(d.select(tx.slugify(F.col("t")).alias("x"))).count("regexp_replace(") == 2
    assert "RLIKE" not in plan(d.select(tx.normalize(F.col("t"))))
    got = {r.k: (r.n, r.s) for r in d.select("k", tx.normalize(F.col("t")).alias("n"), tx.slugify(F.col("t")).alias("s")).collect()}
    assert got[2] == ("plain!", "plain") and got[3] == (None, None) and got[4] == ("!?", "sin-titulo") and got[1][0].startswith("e i fi ") and got[1][0].endswith(" a")


def test_encoder_equals_a_word_at_a_time(spark):
    texts = ["", "x", "Émile ÿŸ ß émile", "İstanbul naïve", "中文 字 ab_c 12²½", "\x85a\xa0bc", "“it’s” it", *["w%d w%d" % (k, k % 7) for k in range(index.BLOCK_TEXTS + 5)]]
    want = np.zeros((len(texts), index.DIM))
    for row, t in zip(want, texts):
        for w in set(index._WORD.findall(t.lower())):
            row += 2.0 * np.frombuffer(hashlib.sha256(w.encode()).digest(), np.uint8) - 255
    norm = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert (index.hashed_encoder(texts) == np.divide(want, norm, out=want, where=norm > 0)).all()
