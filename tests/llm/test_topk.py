import numpy as np
import pytest

from lexforge.llm import topk as T
from tests.compare import from_spark, from_sql

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, distance string"


def brute(rows, k, every=1):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = set()
    for a in (a for a in range(len(rows)) if ids[a] % every == 0):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (d[b], ids[b]))[:k]
        out |= {(ids[a], n + 1, ids[b], round(float(d[b]), 6)) for n, b in enumerate(order)}
    return out


def test_query_equals_sql(spark):
    assert from_spark(T.op10_topk(spark, "/root/testdata/sf0.001")) == from_sql("select * from (" + T.sql() + ")", "/root/testdata/sf0.001")


@pytest.mark.parametrize(("every", "options"), [(1, {}), (1, {"block_rows": 16, "cell_rows": 40, "group_rows": 1, "chunk_queries": 50}), (2, {"block_rows": 7, "cell_rows": 7, "group_rows": 30}), (100, {})])
def test_equals_brute_force_with_ties(spark, every, options):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 5))
    x = np.round(centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.1, 1)
    x[20:40] = x[3]
    rows = [(int(k) * 3, v.tolist(), 1, 2, "a") for k, v in enumerate(x)]
    got = {tuple(r) for r in T.top_k(spark.createDataFrame(rows, SCHEMA), 4, every, **options).collect()}
    assert got == brute(rows, 4, every) and got


def test_odd_rows(spark):
    good = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]
    rows = good + [(1, [0.0, 1.0]), (2, [5.0, 5.0]), (None, [0.0, 0.0]), (4, None), (5, []), (6, [0.0, None]), (7, [1.0, 2.0, 3.0]), (8, [float("nan"), 1.0])]
    d = spark.createDataFrame([(*r, None, 1, "x") for r in rows], SCHEMA)
    assert {tuple(r) for r in T.top_k(d, every=1).collect()} == brute(good, 10)
    assert T.top_k(d.limit(0)).count() == 0 and T.top_k(d.where("vec_id = 3"), every=1).count() == 0


def test_bounds_exclude_most_of_a_clustered_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).repeat(100, axis=0) * 5 + rng.normal(size=(4000, 8)) * 0.05
    d = spark.createDataFrame([(k, v.tolist(), 1, 2, "a") for k, v in enumerate(x)], SCHEMA)
    work = T.candidates(d, 5, 10, block_rows=128, cell_rows=100, group_rows=256, count=True).collect()
    seen = sum(r.distance for r in work)
    assert seen < 0.2 * 400 * 4000
    assert {tuple(r) for r in T.top_k(d, 5, 10, block_rows=128, cell_rows=100, group_rows=256).collect()} == brute([(k, v.tolist()) for k, v in enumerate(x)], 5, 10)
