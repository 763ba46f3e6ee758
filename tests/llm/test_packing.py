import random
import re
from itertools import combinations

import numpy as np
import pytest
import tiktoken

from lexforge.llm import bpe
from lexforge.llm import packing as P
from tests.llm.util import arrays, odd, table


def cost(size, kind, cuts, capacity, cut_cost, split_cost):
    total, at = 0, 0
    for j in cuts:
        n = sum(size[at:j])
        if n > capacity:
            return None
        total += capacity - n + (0, cut_cost, split_cost)[{1: 0, 0: 1, 2: 2}[kind[j - 1]]]
        at = j
    return total


def test_pack_is_optimal():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 9)
        size, kind = [rng.randint(1, 10) for _ in range(n)], [rng.choice([0, 0, 1, 2]) for _ in range(n - 1)] + [1]
        found = P.pack(size, kind, 10, 4, 9)
        assert [a for a, _, _ in found] == [0, *(b + 1 for _, b, _ in found[:-1])] and found[-1][1] == n - 1
        got = cost(size, kind, [b + 1 for _, b, _ in found], 10, 4, 9)
        options = (cost(size, kind, [*c, n], 10, 4, 9) for k in range(n) for c in combinations(range(1, n), k))
        assert got == min(x for x in options if x is not None)


def plain(path=bpe.VOCABULARY):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(bpe._raw(path)))}, special_tokens={})


def sentences(text):
    """Texts of the sentences, by a pattern over characters."""
    blank = r"[\x00-\x20\x7f]"
    cuts = [m.end() for m in re.finditer(rf"[.!?](?={blank})|[^\x00-\x20\x7f](?=[\x00-\x09\x0b-\x20\x7f]*\n)|[。！？｡]", text)]
    last = max((m.end() for m in re.finditer(r"[^\x00-\x20\x7f]", text)), default=0)
    if not last:
        return []
    cuts = [0, *(c for c in dict.fromkeys(cuts) if c < last), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def pieces(text, encoding, capacity):
    """(tokens, kind) of sentences that fit."""
    ids = encoding.encode_ordinary(text)
    ends = np.cumsum([len(encoding.decode_single_token_bytes(t)) for t in ids]).tolist()
    out, at, done = [], 0, 0
    for s in sentences(text):
        at += len(s.encode())
        if at in ends:
            n = ends.index(at) + 1
            out.append(n - done)
            done = n
    assert max(out, default=0) <= capacity
    return out, [0] * (len(out) - 1) + [1] if out else []


def least_cost(size, kind, capacity, cut_cost):
    best = [0] + [10**9] * len(size)
    for j in range(1, len(size) + 1):
        for i in range(j):
            if sum(size[i:j]) <= capacity:
                best[j] = min(best[j], best[i] + capacity - sum(size[i:j]) + {1: 0, 0: cut_cost}[kind[j - 1]])
    return best[-1]


def test_sentences_and_long_ones():
    text = "One two. Three!\nfour five  \n"
    ends, row = P.sentence_ends(*arrays([text, "", "  ", "six", "日本。語"]))
    base = len(text) + 2
    assert (ends.tolist(), row.tolist()) == ([8, 15, 28, base + 3, base + 12, base + 15], [0, 0, 0, 3, 4, 4])
    count, encoding = P.counter(bpe._raw(bpe.VOCABULARY)), plain()
    for t in ("word " * 50, "日本語" * 40, "x" * 300, "é😀" * 30 + ". end"):
        data, off = arrays([t])
        size, end, kind, row = P.items(data, off, np.cumsum(count.width[count(t)]), 7)
        assert size.max() <= 7 and size.sum() == len(encoding.encode_ordinary(t)) and end[-1] == len(data)
        assert kind[-1] == 1 and 2 in kind and "".join(data[a:b].tobytes().decode() for a, b in zip([0, *end[:-1]], end)) == t


@pytest.mark.parametrize("shard_tokens", [10**6, 300])
def test_windows_are_optimal_and_rebuild_the_texts(spark, shard_tokens):
    rng, encoding = random.Random(5), plain()
    rows = [(k * 10**12 - 5, " ".join("w" + rng.choice(["", "", ".", "\n", " x"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    out = sorted(P.windows(table(spark, rows), 40, 3, 20, shard_tokens=shard_tokens).collect(), key=lambda r: (r.shard, r.window, r.seq))
    docs = [r.doc_id for r in out]
    assert docs == sorted(docs) and all(r.window_tokens + r.padding == 40 and 0 < r.tokens <= 40 for r in out)
    text, total, shards = {}, {}, {}
    for r in out:
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        shards.setdefault(r.shard, {})[r.doc_id] = 1
    assert text == {k: t for k, t in rows if t.split()}
    assert total == {k: len(encoding.encode_ordinary(t)) for k, t in rows if t.split()}
    before, starts = 0, {}
    for k, t in rows:
        if t.split():
            starts.setdefault(before // shard_tokens, []).append(k)
            before += total[k]
    assert [list(s) for s in shards.values()] == list(starts.values()) and (len(starts) > 3) == (shard_tokens == 300)
    for shard, part in shards.items():
        size, kind = [], []
        for k in part:
            a, c = pieces(text[k], encoding, 40)
            size += a
            kind += c
        ends = {r.window: (r.padding, r.ends_with) for r in out if r.shard == shard}
        assert sum(p + {"document": 0, "sentence": 3, "split": 20}[e] for p, e in ends.values()) == least_cost(size, kind, 40, 3)


def test_counter_equals_the_plain_encoder():
    rng, count, encoding = random.Random(7), P.counter(bpe._raw(bpe.VOCABULARY)), plain()
    for _ in range(500):
        t = "".join(rng.choices(["a", "é", "the", " ", "\n", "\u00a0", "'ll", "'", "7", "!", "\x1c", "日"], k=rng.randint(0, 12)))
        assert count(t).tolist() == encoding.encode_ordinary(t), repr(t)


def test_query_has_all_tokens_of_operator_6(spark):
    data = "/root/testdata/sf0.001"
    want = {r.doc_id: r.n_tokens for r in bpe.op6_bpe(spark, data).collect() if r.n_tokens}
    text, got = {}, {}
    for r in sorted(P.op7_packing(spark, data).collect(), key=lambda r: (r.shard, r.window, r.seq)):
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
        assert r.window_tokens <= P.CAPACITY
    assert got == want
    assert text == {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.doc_id in text}


def test_odd_rows(spark):
    d = odd(spark)
    out = sorted(P.windows(d).collect(), key=lambda r: (r.shard, r.window, r.seq))
    assert {r.doc_id for r in out} == {None, 1, 4} and out[0].doc_id is None
    assert "".join(r.text for r in out if r.doc_id == 4) == "word " * 60_000 and {r.ends_with for r in out[1:-1]} >= {"split"}
    assert [r.text for r in out if r.doc_id == 1] == ["plain words here"] * 2
    assert P.windows(d.limit(0)).count() == 0
    blank = table(spark, [(1, " " * 300_000 + "a" + "\n" * 300_000), (2, "x" * 400_000), (3, "\x00\x1f")])
    assert sum(len(r.text) for r in P.windows(blank).collect()) == 600_001 + 400_000
