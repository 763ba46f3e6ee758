"""Operator 6, BPE encoding and decoding by prefix-sharing trie traversal.

The byte-pair encoding of a word is settled by one state per prefix: the last token of the
prefix's own encoding. The last token of a longer prefix is the one token that ends there and may
follow the last token of the prefix before it (no merge of lower rank crosses their border). So the
distinct words of a partition go into a byte trie, one depth-first walk gives every node its state
from its ancestors' states, and prefixes that words share are worked out once. A word's tokens are
read off by stepping back from its node.

Words are cut by the vocabulary's pretokenisation pattern. Nothing is shuffled: every worker
keeps the trie of the words it has met, and starts a new one when it passes max_nodes, which changes
the work but not the result. The driver reads the vocabulary (its path is a parameter) and broadcasts
its bytes, whose size does not depend on the corpus.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import textbuf as tb
from lexforge.llm.common import documents, frugal, small_batches

VOCABULARY, MAX_NODES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 1_000_000
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by rank, from base64 lines 'token rank'."""
    pairs = [line.split() for line in raw.splitlines() if line]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Vocabulary:
    """Tokens, the two parts each was last merged from, and the merge of each such pair."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.parts: list[tuple[int, int]] = []
        self.merge: dict[tuple[int, int], int] = {}
        for k, t in enumerate(tokens):
            if len(t) == 1:
                self.parts.append((k, k))
                continue
            parts = self._merged(t, k)
            if len(parts) != 2:
                raise ValueError(f"token {k} is not a merge of two tokens of lower rank")
            self.parts.append((parts[0], parts[1]))
            self.merge[parts[0], parts[1]] = k
        self._fits: dict[tuple[int, int], bool] = {}
        self.reach: dict[bytes, int] = {}  # by its last three bytes (all it has, if fewer): the longest token that ends so
        for t in tokens:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 2), len(t))

    def _merged(self, word: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under below."""
        parts = [self.rank[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """May right follow left: no merge crosses their border before each is complete."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._check(left, right)
        return known

    def _check(self, a: int, b: int) -> bool:
        # undo the later of the two tokens' last merges; whatever stands at the border then may not merge earlier than what was undone
        limit = len(self.tokens)
        while True:
            if self.merge.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(read_ranks(raw))


_SPLIT = regex.compile(PATTERN)


class Trie:
    """Distinct words as a byte trie, kept in flat arrays.

    Words are inserted in sorted order, which is the depth-first order of their nodes, and a node's
    state (its last token, and the node where that token starts) is set when it is made: its
    ancestors have theirs by then.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.last, self.from_node = array("i", [-1]), array("i", [-1])
        self.index: dict[str, int] = {}  # word -> its number
        self.flat, self.at = array("i"), array("q", [0])  # tokens of the words, one after another

    def add(self, words: list[str]) -> None:
        """Number and encode words that are not there yet."""
        child, last, from_node, rank, fits, reach, flat = self.child, self.last, self.from_node, self.v.rank, self.v.fits, self.v.reach, self.flat
        for w, word in sorted((w.encode(), w) for w in words):
            node, path = 0, [0]
            for d, c in enumerate(w):
                step = child.get(node << 8 | c)
                if step is None:
                    step = child[node << 8 | c] = len(last)
                    end = d + 1
                    for start in range(max(0, end - reach.get(w[max(0, d - 2) : end], 2)), end):
                        token = rank.get(w[start:end])
                        if token is not None and (start == 0 or fits(last[path[start]], token)):
                            last.append(token)
                            from_node.append(path[start])
                            break
                node = step
                path.append(node)
            out = []
            while node:
                out.append(last[node])
                node = from_node[node]
            flat.extend(out[::-1])
            self.at.append(len(flat))
            self.index[word] = len(self.at) - 2


class Encoder:
    """Texts to tokens, with the trie of all words met so far; when it passes max_nodes a new one is begun."""

    def __init__(self, v: Vocabulary, max_nodes: int = MAX_NODES) -> None:
        self.v, self.max_nodes, self.trie = v, max_nodes, Trie(v)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in one array, and how many each text has; a null counts as empty."""
        if len(self.trie.last) > self.max_nodes:
            self.trie = Trie(self.v)
        cut = [_SPLIT.findall(t) if t else [] for t in texts]
        index = self.trie.index
        new = {w for c in cut for w in c if w not in index}
        if new:
            self.trie.add(list(new))
        words = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        at = np.array(self.trie.at)
        first, size = at[words], at[words + 1] - at[words]
        ends = np.cumsum(size)
        flat = np.array(self.trie.flat)[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(c) for c in cut])
        return flat.astype(np.int32), np.diff(np.r_[0, np.r_[0, ends][last]]).astype(np.int32)


_KEPT: dict[tuple[int, int], Encoder] = {}


def encoder(raw: bytes, max_nodes: int) -> Encoder:
    """This worker's encoder: later tasks find the words of earlier ones."""
    key = (hash(raw), max_nodes)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(vocabulary(raw), max_nodes)
    return _KEPT[key]


def _raw(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(docs: DataFrame, path: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, tokens array<int>, n_tokens: the text of every row as tokens.

    Null text gives null tokens and null n_tokens, an empty text no tokens and 0. Null and repeated
    ids are kept row by row; texts of any length are taken whole; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_raw(path))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(shared.value, max_nodes)
        for b in batches:
            _, off = tb.buffers(b.column(1))
            for lo, hi in tb.slices(off):
                texts = b.column(1).slice(lo, hi - lo)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                flat, size = work(texts.to_pylist())
                at = np.zeros(len(size) + 1, dtype=np.int32)
                np.cumsum(size, out=at[1:])
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), tokens, pa.array(size, pa.int32(), mask=null)], ["doc_id", "tokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of a table doc_id, tokens. Null tokens give null text; bytes that are no UTF-8 become U+FFFD; an unknown token is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(_raw(path))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(shared.value).tokens
        width = np.array([len(t) for t in table], dtype=np.int64)
        flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        first = np.cumsum(np.r_[0, width[:-1]])
        for b in batches:
            texts = []
            for row in b.column(1):
                if not row.is_valid:
                    texts.append(None)
                    continue
                ids = row.values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
                    raise ValueError("a token is not in the vocabulary")
                n = width[ids]
                at = np.repeat(first[ids] - np.cumsum(np.r_[0, n[:-1]]) if len(ids) else first[:0], n) + np.arange(n.sum())
                texts.append(flat[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
