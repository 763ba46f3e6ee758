"""Operator 7, order-preserving packing by dynamic programming.

Documents keep their order (doc_id). Each is cut into sentences; a shard of consecutive
documents is a run of sentences with a number of tokens each, those of operator 6's vocabulary. Windows of at most capacity
tokens are cut at document ends (free), sentence ends (cut_cost, a document is truncated) or
inside a sentence that is longer than a window (split_cost). The cost of a window is its
padding plus the cost of its cut; the last window of a shard pays its padding too. With
f(j) = capacity - S(j) + cost(j) + min over feasible i of (f(i) + S(i)), where S are prefix sums
and i is feasible if S(j) - S(i) <= capacity, the minimum slides, so a monotone queue gives every
transition in amortised constant time.

A text is encoded whole, and all its tokens are counted; sentences end where a token ends, so their tokens add up to the
text's. The windows come with their text: that of the rows of a document, in order, is the document.

A shard begins at each document in which the count of all tokens before it passes another multiple of
shard_tokens. The counts come from a range-partitioned table of ids and numbers of tokens, so
neither the spread of the ids nor Spark's partitioning matters. Text is shuffled once, to its shard. The
starts of the shards, MAX_SHARDS at most (shards grow beyond that), are broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm import bpe
from lexforge.llm import textbuf as tb
from lexforge.llm.common import documents, frugal, give_back, small_batches, written

CAPACITY, CUT_COST, SPLIT_COST, SHARD_TOKENS, MAX_SHARDS = 2048, 64, 512, 1 << 18, 1 << 20
SCHEMA = "shard long, window int, seq int, doc_id long, first_sentence int, last_sentence int, tokens int, window_tokens int, padding int, ends_with string, text string"
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_WIDE_ENDS = [tuple(c.encode()) for c in "。！？｡"]
_TWO_BLANKS = re.compile(r"\s\s")


class Counter:
    """Tokens of texts in a vocabulary, those of bpe.encode, and the bytes of each token."""

    def __init__(self, raw: bytes) -> None:
        tokens = bpe.read_ranks(raw)
        self.raw, self.width = raw, np.array([len(t) for t in tokens], dtype=np.int64)
        # where no blank follows another one, the look-ahead makes no difference and only costs time
        self.quick = self._encoding(bpe.PATTERN.replace(r"|\s+(?!\S)", ""))
        self._whole: tiktoken.Encoding | None = None

    def _encoding(self, pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(self.raw))}, special_tokens={})

    @property
    def whole(self) -> tiktoken.Encoding:
        self._whole = self._whole or self._encoding(bpe.PATTERN)
        return self._whole

    def __call__(self, text: str) -> np.ndarray:
        try:
            return (self.whole if _TWO_BLANKS.search(text) else self.quick).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack does not hold a run of blanks as long as that
            return bpe.encoder(self.raw, bpe.MAX_NODES)([text])[0]


@lru_cache(maxsize=1)
def counter(raw: bytes) -> Counter:
    return Counter(raw)


def sentence_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sentences of each text end, in bytes, and their texts' rows. A sentence ends with a word that ends in . ! or ?, after a wide full stop, before a newline, or with its text, whose last sentence has what blanks follow; a text without words has none."""
    start, end, row = tb.word_spans(data, offsets, tb.SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = _END[data[end - 1]].copy()
    newlines = np.flatnonzero(data == 10)
    last[:-1] |= np.searchsorted(newlines, start[1:]) > np.searchsorted(newlines, end[:-1])
    final = np.r_[row[1:] != row[:-1], True]
    inside = end[last & ~final]
    for wide in _WIDE_ENDS:
        at = np.flatnonzero(data == wide[0])
        at = at[at + 3 <= len(data)]
        inside = np.r_[inside, at[(data[at + 1] == wide[1]) & (data[at + 2] == wide[2])] + 3]
    with_words = np.unique(row)
    inside = np.unique(inside)
    of = np.searchsorted(offsets, inside, side="left") - 1
    keep = inside < end[final][np.minimum(np.searchsorted(with_words, of), len(with_words) - 1)]
    ends, rows = np.r_[inside[keep], offsets[with_words + 1]], np.r_[of[keep], with_words]
    order = np.lexsort((ends, rows))
    return ends[order], rows[order]


def items(data: np.ndarray, offsets: np.ndarray, token_ends: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, end in bytes, kind, row) of the pieces of texts whose tokens end at token_ends: kind 1 at a text's end, 0 at another sentence's end, 2 inside a sentence. Sentences over capacity fall into pieces as long as fit."""
    ends, row = sentence_ends(data, offsets)
    at = np.searchsorted(token_ends, ends)
    real = token_ends[np.minimum(at, len(token_ends) - 1)] == ends if len(ends) else np.zeros(0, bool)
    ends, row, upto = ends[real], row[real], at[real] + 1
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    begin = np.where(first, np.searchsorted(token_ends, offsets[row], side="right"), np.r_[0, upto[:-1]])
    kind = np.where(np.r_[first[1:], True] if len(row) else first, 1, 0)
    size = upto - begin
    long = np.flatnonzero(size > capacity)
    if len(long):
        places, new_size, new_end = [], [], []
        for k in long.tolist():
            lo = int(begin[k])
            while upto[k] - lo > capacity:
                hi = lo + capacity
                while data[token_ends[hi - 1]] & 0xC0 == 0x80:  # not inside a character
                    hi -= 1
                places.append(k)
                new_size.append(hi - lo)
                new_end.append(token_ends[hi - 1])
                lo = hi
            size[k] = upto[k] - lo
        size, ends, kind, row = np.insert(size, places, new_size), np.insert(ends, places, new_end), np.insert(kind, places, 2), np.insert(row, places, row[places])
    return size, ends, kind, row


def measured(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, version, text, n, size, end, kind of each row that has a word: its tokens, and those of its pieces (see items)."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe._raw(path))
    schema = "doc_id long, version long, text string, n long, size array<int>, end array<int>, kind array<int>"

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = counter(shared.value)
        for b in batches:
            data, off = tb.buffers(b.column(2))
            for lo, hi in tb.slices(off):
                part, offsets = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                tokens = [encode(t) for t in b.column(2).slice(lo, hi - lo).to_pylist() if t]
                size, end, kind, row = items(part, offsets, np.cumsum(encode.width[np.concatenate(tokens)]) if tokens else np.zeros(0, np.int64), capacity)
                rows, at = np.unique(row, return_index=True)
                if not len(rows):
                    continue
                lists = pa.array(np.r_[at, len(row)].astype(np.int32))
                columns = [x.take(pa.array(rows + lo)) for x in b.columns]
                arrays = [pa.ListArray.from_arrays(lists, pa.array(x.astype(np.int32))) for x in (size, end - offsets[row], kind)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(size, at), pa.int64()), *arrays], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where("text is not null").mapInArrow(scan, schema)


def pack(lens: list[int], kinds: list[int], capacity: int, cut_cost: int, split_cost: int) -> list[tuple[int, int, int]]:
    """The cheapest windows over pieces: (first, last, kind of cut). Ties take the longest last window."""
    cost = [0 if e == 1 else (cut_cost if e == 0 else split_cost) for e in kinds]
    came = [0]
    total = 0
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value f(i) + S(i), S(i), i; values ascend
    for j, n in enumerate(lens, 1):
        total += n
        while total - queue[0][1] > capacity:
            queue.popleft()
        value, _, i = queue[0]
        came.append(i)
        v = capacity + cost[j - 1] + value
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, total, j))
    cuts, j = [], len(lens)
    while j > 0:
        cuts.append((came[j], j - 1, kinds[j - 1]))
        j = came[j]
    return cuts[::-1]


def shard_starts(rows: DataFrame, shard_tokens: int) -> list[tuple]:
    """Keys (id is there, id, version, row) of the first document of each shard, ascending; rows is written."""
    keys = ("doc_id", "version", "row")
    ranged = written(rows.select(*keys, "n").repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "order")
    totals = sorted((r[0], r[1]) for r in ranged.groupBy("part").agg(F.sum("n")).collect())  # one for each partition
    if not totals:
        return []
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    size = max(shard_tokens, -(-before[-1] // MAX_SHARDS))
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, before long")
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    shard = F.floor((F.col("before") + up_to - F.col("n")) / size)
    key = F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "version", "row")
    starts = ranged.join(F.broadcast(offsets), "part").select(shard.alias("shard"), key.alias("key")).groupBy("shard").agg(F.min("key").alias("key"))
    return sorted(tuple(r.key) for r in starts.collect())  # MAX_SHARDS at most


def windows(docs: DataFrame, capacity: int = CAPACITY, cut_cost: int = CUT_COST, split_cost: int = SPLIT_COST, shard_tokens: int = SHARD_TOKENS, path: str = bpe.VOCABULARY) -> DataFrame:
    """One row for each part of a document in a window, in the order of shard, window, seq: see SCHEMA. text is the part's text.

    Sentences are numbered from 0; a sentence longer than a window appears in several, its parts
    in order, with its tokens in each. Null ids come first. Rows that
    repeat a doc_id are packed one after another, in the order of their texts' hashes. Null texts and those without words appear
    nowhere; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    kinds = ("sentence", "document", "split")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = written(measured(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "measured")
    starts = docs.sparkSession.sparkContext.broadcast(shard_starts(rows, shard_tokens))

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in (0, 1, 2)))
            shard = [bisect_right(starts.value, (d is not None, d or 0, v, r)) - 1 for d, v, r in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns], ["shard", *b.schema.names])

    def run(table: pa.Table) -> pa.Table:
        give_back()  # what the shard before took
        shard = table.column("shard")[0].as_py()
        order = sorted(range(table.num_rows), key=[(d is not None, d or 0, v, r) for d, v, r in zip(*(table.column(c).to_pylist() for c in ("doc_id", "version", "row")))].__getitem__)
        table = table.take(pa.array(order)).combine_chunks()
        ids, texts = table.column("doc_id").to_pylist(), table.column("text")
        sizes, ends, marks = (table.column(c).combine_chunks() for c in ("size", "end", "kind"))
        size, end, kind = (x.flatten().to_pylist() for x in (sizes, ends, marks))
        counts = np.diff(sizes.offsets.to_numpy())
        doc = np.repeat(np.arange(len(ids)), counts).tolist()
        first = np.repeat(np.cumsum(counts) - counts, counts).tolist()
        # sentences before each piece, of its document
        done = np.cumsum(np.r_[0, np.asarray(kind[:-1]) != 2]) if kind else np.zeros(0, int)
        sentence = (done - done[first]).tolist() if kind else []
        out: list[list] = [[] for _ in names]
        raw, held = b"", -1
        for w, (i, j, cut) in enumerate(pack(size, kind, capacity, cut_cost, split_cost)):
            filled, seq, k = sum(size[i : j + 1]), 0, i
            while k <= j:
                m = k
                while m < j and doc[m + 1] == doc[k]:
                    m += 1
                if held != doc[k]:
                    held, raw = doc[k], texts[doc[k]].as_py().encode()
                text = raw[0 if k == first[k] else end[k - 1] : end[m]].decode()
                for column, value in zip(out, (shard, w, seq, ids[doc[k]], sentence[k], sentence[m], sum(size[k : m + 1]), filled, capacity - filled, kinds[cut], text)):
                    column.append(value)
                seq, k = seq + 1, m + 1
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    columns = "doc_id long, version long, row long, text string, size array<int>, end array<int>, kind array<int>"
    dealt = rows.select(*[x.split()[0] for x in columns.split(", ")]).mapInArrow(deal, "shard long, " + columns)
    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(documents(spark, sf_dir))
