import random

import numpy as np
import pytest

from lexforge.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%03d" % k for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(n)]
    for k in range(0, n, 4):  # near copies
        words = texts[k].split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    return texts + texts[:5]


def brute(texts):
    from tests.llm.util import arrays

    fp, count = S.fingerprints(*arrays([t.lower() for t in texts]))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if count[i] and count[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= S.MAX_DISTANCE:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    roots = [find(i) for i in range(len(texts))]
    return {(i, r) for i, r in enumerate(roots) if roots.count(r) > 1}


def links(texts):
    """For each text the number of others within the distance."""
    from tests.llm.util import arrays

    fp, count = S.fingerprints(*arrays([t.lower() for t in texts]))
    return [sum(1 for j in range(len(texts)) if j != i and count[i] and count[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= S.MAX_DISTANCE) for i in range(len(texts))]


@pytest.mark.parametrize("options", [{}, {"r": 3}, {"list_rows": 3}])
def test_equals_brute_force(spark, options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    rows = S.near_groups(docs, **options).collect()
    got, n = {tuple(x)[:2] for x in rows}, links(texts)
    assert got == brute(texts) and len(got) > 10
    assert all(x.n_links == n[x.doc_id] for x in rows) and max(n) > 1


@pytest.mark.parametrize("sides", [False, True])
def test_long_posting_list_counts_all_links(sides):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    fp = np.repeat(base[None], 700, axis=0)
    for _ in range(7):
        fp[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 700).astype(np.uint64)
    fp[350:, 1] ^= np.uint64(2**40 - 1)
    side = np.repeat([1, 2], [300, 400]) if sides else np.zeros(700, int)
    docs = rng.integers(1, 4, 700)
    i, j, n = S.posting_pairs(np.zeros(700, np.uint64), side, fp, docs, np.zeros(700, int), np.zeros(1 << 16, int), 13)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= 13
    np.fill_diagonal(near, False)
    if sides:
        near &= side[:, None] != side[None]
    assert (n == near @ docs).all() and n.any()
    parent = list(range(700))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert len(i) < 700 and near[i, j].all()
    for a, b in zip(i.tolist(), j.tolist()):
        parent[find(a)] = find(b)
    for a, b in zip(*np.nonzero(near)):
        assert find(a) == find(b)


@pytest.mark.parametrize(("distance", "r"), [(13, 2), (12, 2), (12, 3), (3, 4), (15, 1)])
def test_covering_holds_every_shared_set(distance, r):
    rng = random.Random(0)
    family = [set(x) for x in S.covering(distance, r)]
    for _ in range(300):
        shared = set(rng.sample(range(16), 16 - distance))
        assert any(x <= shared for x in family)


def test_edges_and_odd_rows(spark):
    rows = [(1, "same words here now", "en", "s", 1), (1, "same words here now", "en", "s", 1), (2, "same words here now", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "same words here now", "en", "s", 0), (5, "... !!", "en", "s", 0), (6, "x " * 50000, "en", "s", 100000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", group_id int, hi string")
    assert {tuple(x) for x in S.near_groups(docs).collect()} == {(1, 1, 1), (2, 1, 1)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.text or "") for x in kept.collect()) == sorted([(1, "same words here now"), (3, ""), (4, ""), (-1, "same words here now"), (5, "... !!"), (6, "x " * 50000)])
    assert S.near_groups(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0
