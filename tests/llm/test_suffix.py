import random

import numpy as np
import pytest

from lexforge.llm import induced as I
from lexforge.llm import suffix as S


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_order(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for x, y in zip(order, order[1:]):
        d = 0
        while t[x + d] == t[y + d]:
            d += 1
        common.append(d)
    return order, common


@pytest.mark.parametrize(("block", "memory"), [(1, 0), (3, 0), (7, 200), (1000, 1 << 20)])
def test_suffix_array_equals_brute_force(tmp_path, block, memory):
    rng = random.Random(block)
    for trial in range(60):
        t = [rng.choice([1, 1, 1, 2]) if trial % 3 == 0 else rng.randint(1, 4) for _ in range(rng.randint(0, 50))] + [0]
        store = I.Store(f"file://{tmp_path}", memory)
        text = I.Spool(store)
        for k in range(0, len(t), block):
            text.append(np.array(t[k : k + block]))
        pos, lcp = I.suffix_array(text, block, store)
        assert (pos.read().tolist(), lcp.read().tolist()) == brute_order(t)
        store.close()
    assert not any(tmp_path.iterdir())  # files on disk are taken away


def test_anchors_cover_every_window_and_depend_on_it_alone():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 400, dtype=np.uint64)
    words[250:330] = words[20:100]
    row = np.repeat([0, 1], 200)
    anchor, _, r, s, e = S.anchors(words, row, 10, 3)
    covered = {}
    for a, q, lo, hi in zip(anchor.tolist(), r.tolist(), s.tolist(), e.tolist()):
        assert (row[lo:hi] == q).all()
        for k in range(lo, hi - 9):
            assert k not in covered
            covered[k] = a
    assert len(covered) == 2 * 191
    assert all(covered[k] == covered[k + 230] for k in range(20, 91))


def corpus():
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randint(0, 300)
    passages = [" ".join(word() for _ in range(rng.randint(6, 30))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), word() + " \n" + word()]
        texts.append("  ".join(parts))
    texts += [texts[3], texts[3], "", "a b", "x " * 200, "x " * 90]
    return texts


def brute(rows, m):
    """doc -> words that lie in an m-window that also stands in an earlier document."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - m + 1):
            seen.setdefault(tuple(w[k : k + m]), set()).add(d)
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - m + 1):
            if min(seen[tuple(w[k : k + m])]) < d:
                out.setdefault(d, set()).update(range(k, k + m))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 300, "block": 16, "memory": 100}, {"hot_rows": 2}])
def test_repeats_equal_brute_force(spark, options):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = {}
    for x in S.repeats(docs, 8, 3, **options).collect():
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
        assert x.first_doc < x.doc_id
    assert got == brute(rows, 8) and len(got) > 10


def test_open_groups_go_on_over_batches():
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 5), 0, k, k + 9, True) for k in range(60))
    import pyarrow as pa

    def run(step):
        out = []
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + step])], [*"abcdefg"]) for k in range(0, len(rows), step)]
        for b in S._settle(iter(batches)):
            out += [tuple(r.values()) for r in b.to_pylist()]
        assert len(out) == len(set(out))
        return set(out)

    assert run(60) == run(1) == run(7)


def test_cut_words_and_drop(spark):
    assert S.cut_words("a b  c\nd", [(1, 3)]) == "a d"
    long = " ".join("p%d" % k for k in range(60))
    rows = [(1, long, "en", "s", 0), (2, "start here " + long + " end", "en", "s", 0), (3, long, "en", "s", 0), (4, None, None, None, None), (None, long, "en", "s", 7), (5, "", "en", "s", 0), (3, long, "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", version int, s string")
    kept = S.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.text or "", x.n_chars or 0) for x in kept.collect()) == sorted([(1, long, 0), (2, "start here end", 14), (4, "", 0), (-1, long, 7), (5, "", 0)])
    assert S.repeats(docs.limit(0)).count() == 0 and S.drop_repeats(docs.limit(0)).count() == 0


def repeated_inside():
    """Documents that hold one paragraph many times over, before and after one that holds it once; 5 has two texts."""
    rng = random.Random(9)
    p = " ".join("p%d" % rng.randint(0, 99) for _ in range(60))
    other = lambda k: " ".join("o%d" % rng.randint(0, 999) for _ in range(k))
    ten = " ".join([p] * 10)
    return [(2, other(9) + " " + p + " " + other(9)), (5, ten), (5, "q " + ten + " " + other(5)), (7, ten + " " + other(20)), (8, other(70))]


@pytest.mark.parametrize("options", [{}, {"shard_words": 300, "block": 16, "memory": 100}, {"hot_rows": 2}])
def test_paragraph_repeated_inside_a_document(spark, options):
    rows = repeated_inside()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    version = {r.v: (r.doc_id, r.text) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) v").collect()}
    found = S.repeats(docs, 50, 8, **options).collect()
    got, where = {}, {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(d)
    for x in found:
        got.setdefault(version[x.version], set()).update(range(x.start_word, x.end_word))
        w = version[x.version][1].split()
        assert x.first_doc == min(min(where[tuple(w[k : k + 50])]) for k in range(x.start_word, x.end_word - 49))
    want = {}
    for d, t in rows:
        others = [r for r in rows if r[0] != d]
        if d in (b := brute([*others, (d, t)], 50)):
            want[d, t] = b[d]
    assert got == want and len(got) == 3
