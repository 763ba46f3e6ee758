import random

import pytest
import tiktoken

from lexforge.llm import bpe as B
from tests.llm.util import odd

MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def reference(path):
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks={t: k for k, t in enumerate(B.read_ranks(B._raw(path)))}, special_tokens={})


@pytest.mark.parametrize("path", [B.VOCABULARY, MULTI])
def test_equals_tiktoken_on_random_texts(path):
    encode, work, rng = reference(path), B.Encoder(B.vocabulary(B._raw(path)), 2000), random.Random(0)
    for _ in range(300):
        texts = ["".join(rng.choices("aeéthingsu  \n\t'll.,0123日本x😀", k=rng.randint(0, 40))) for _ in range(4)] + [None]
        flat, size = work(texts)
        at = 0
        for t, n in zip(texts, size):
            assert flat[at : at + n].tolist() == ([] if t is None else encode.encode_ordinary(t))
            at += n


def test_query_equals_tiktoken_and_comes_back(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, encode = B.op6_bpe(spark, "/root/testdata/sf0.001"), reference(B.VOCABULARY)
    assert {(r.doc_id, tuple(r.tokens), r.n_tokens) for r in out.collect()} == {(r.doc_id, tuple(x := encode.encode_ordinary(r.text)), len(x)) for r in d.collect()}
    assert {tuple(r) for r in B.decode(out).collect()} == {(r.doc_id, r.text) for r in d.collect()}


def test_odd_rows(spark):
    d = odd(spark)
    out = B.encode(d)
    assert sorted((r.doc_id or -1, r.n_tokens if r.n_tokens is not None else -1) for r in out.collect() if r.doc_id not in (4, 5)) == [(-1, 4), (1, 3), (1, 3), (2, -1), (3, 0)]
    assert sorted(str(r.text) for r in B.decode(out).collect()) == sorted(str(r.text) for r in d.collect())
    assert B.encode(d.limit(0)).count() == 0 and B.decode(B.encode(d.limit(0))).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, tokens array<int>")).collect()
