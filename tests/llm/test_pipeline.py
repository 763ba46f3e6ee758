import random
import re

import corpus_pipeline as C
from lexforge.llm import packing, secrets
from tests.llm.test_simhash import brute as near
from tests.llm.test_suffix import brute as repeats
from tests.llm.test_packing import least_cost, pieces, plain
from tests.llm.util import SCHEMA


def corpus():
    rng = random.Random(8)
    words = ["w%03d" % k for k in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = text(70)
    rows = [(k, f"cookie notice of this site\n{text(90)}\n{shared if k % 7 == 3 else text(20)}", "en", "host", 0) for k in range(40)]
    rows += [(100, rows[5][1], "en", "other", 0), (101, "cookie notice of this site\nw", "en", "host", 0), (102, f'{text(60)} token = "f3ef4d6b2755a36d7d9c"', "de", "x", 0), (103, shared, "en", "y", 0), (104, None, None, None, None), (None, text(30), "en", "z", 0)]
    return rows


def test_pipeline_equals_its_stages_done_by_hand(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    # 1 boilerplate: the notice is on 41 documents of its host
    clean = {}
    for d, t, _, host, _ in rows:
        if t is not None and host == "host":
            kept = [x for x in t.split("\n") if x != "cookie notice of this site"]
            if len("\n".join(kept)) < 0.3 * len(t):
                continue
            t = "\n".join(kept)
        clean[d] = t
    assert 101 not in clean
    # 2 near duplicates
    ids = [d for d, t in clean.items() if t and d is not None]
    gone = {ids[a] for a, r in near([clean[d] for d in ids]) if a != r}
    kept = {d: t for d, t in clean.items() if d not in gone}
    assert 100 in gone
    # 3 repeated passages
    again = repeats([(d, t) for d, t in kept.items() if t and d is not None], 50)
    assert {10, 17, 103} <= set(again)
    for d, at in again.items():
        kept[d] = "".join(w for k, w in enumerate(re.findall(r"\S+\s*", kept[d])) if k not in at)
    # 4 secrets
    for d, t in list(kept.items()):
        if t:
            for a, b, _, _, s in reversed(secrets.findings(t)):
                kept[d] = kept[d][:a] + "[SECRET]" + kept[d][b:] if s else kept[d]
    # 5 packing: all text that is left, in order, in the cheapest windows
    got.sort(key=lambda r: (r.shard, r.window, r.seq))
    text, windows, encoding = {}, {}, plain()
    for r in got:
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
        windows.setdefault(r.window, []).append(r)
    assert text == {d: t for d, t in kept.items() if t and t.split()} and {r.shard for r in got} == {0}
    order = sorted(text, key=lambda d: (d is not None, d or 0))
    assert list(dict.fromkeys(r.doc_id for r in got)) == order
    size, kind = [], []
    for d in order:
        a, c = pieces(text[d], encoding, packing.CAPACITY)
        size += a
        kind += c
    cost = sum(parts[0].padding + {"document": 0, "sentence": packing.CUT_COST}[parts[0].ends_with] for parts in windows.values())
    assert cost == least_cost(size, kind, packing.CAPACITY, packing.CUT_COST)
    for parts in windows.values():
        assert sum(r.tokens for r in parts) == parts[0].window_tokens == packing.CAPACITY - parts[0].padding
        assert sum(len(encoding.encode_ordinary(r.text)) for r in parts) >= parts[0].window_tokens


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert len(C.STAGES) == 5
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
