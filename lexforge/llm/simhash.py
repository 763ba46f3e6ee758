"""Operator 1, SimHash near-duplicates: byte-position inverted index with count filtering.

A document's features are its words (lower case, split at white space and ASCII punctuation; in a
script without blanks what stands between two punctuation marks is a word),
weighted by the square root of their count. Its 128-bit SimHash is 16 bytes in 16 positions. Two
fingerprints within max_distance bits agree in at least T = 16 - max_distance byte positions, as
each differing bit spoils one byte at most. The inverted index is keyed by (positions, bytes at
them) for r positions at a time: the 16 positions are dealt into g = (T - 1) // (r - 1) groups and
all r-subsets inside a group are indexed, so by the pigeonhole any T shared positions hold an
indexed subset: no pair is missed. Inside a posting list the shared positional bytes of each pair
are tallied, pairs under T are dropped, the others verified by their Hamming distance. r is chosen
from the number of fingerprints and the chance of agreement at each position, counted over all of them
(bytes are far from uniform within a language): it grows so that posting lists stay short; the
result is the same for every r.

Equal fingerprints are merged first into classes. A pair of classes shares several lists; it counts in the one
with the least subset of all its shared bytes, so links are counted without a table of pairs, each exactly once. From
the pairs of a batch of lists only a spanning forest goes on, so a group of thousands of near copies costs about
its own size, and near duplicates are the connected components of the forests. A posting list of
over list_rows classes is dealt into parts of about that size by hash, and every two parts meet in a
group of their own, so no task holds a long list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import textbuf as tb
from lexforge.llm.common import connected_components, documents, frugal, small_batches, small_side, written

BYTES, MAX_DISTANCE, LIST_ROWS, SHORT = 16, 13, 4096, 256
_LOW = np.uint64(0x0101010101010101)
_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LANES = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], dtype=np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints and the number of words of each text."""
    n = len(offsets) - 1
    start, end, row = tb.word_spans(data, offsets, tb.PUNCT)
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, 2), dtype=np.uint64)
    if not len(start):
        return out, count
    h = tb.hash_spans(data, start, end)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    at = np.flatnonzero(new)
    tf = np.diff(np.r_[at, len(h)])
    h, row = h[at], row[at]
    weight = np.rint(np.sqrt(tf) * 4).astype(np.int64)
    # features of one weight of one document are counted together, in byte lanes of at most 255
    order = np.lexsort((weight, row))
    h, row, weight = h[order], row[order], weight[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (weight[1:] != weight[:-1])]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(h)])
    index = np.arange(len(h)) - np.repeat(at, size)
    runs = np.flatnonzero(index % 255 == 0)
    run_row, run_weight, run_size = row[runs], weight[runs], np.diff(np.r_[runs, len(h)])
    sums = np.zeros((n, 128), dtype=np.int64)
    firsts = np.flatnonzero(np.r_[True, run_row[1:] != run_row[:-1]])
    for half, salt in enumerate((0, 0x5DEECE66D)):
        b = tb.mix(h ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8)
        lanes = np.add.reduceat(_LANES[b], runs, axis=0)
        ones = lanes.view(np.uint8).reshape(len(runs), 64).astype(np.int64)
        votes = (2 * ones - run_size[:, None]) * run_weight[:, None]
        sums[run_row[firsts], 64 * half : 64 * half + 64] = np.add.reduceat(votes, firsts, axis=0)
    bits = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).reshape(n, 2), count


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): one row for each row with an id and a word; null, empty and wordless texts have no fingerprint."""

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.utf8_lower(b.column(1))
            wide = pc.match_substring_regex(texts, _BLANK)
            if pc.any(wide).as_py():
                texts = pc.if_else(wide, pc.replace_substring_regex(texts, _BLANK, " "), texts)
            data, off = tb.buffers(texts)
            for lo, hi in tb.slices(off):
                fp, count = fingerprints(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ok = count > 0
                ids = b.column(0).slice(lo, hi - lo).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp[ok, 0].view(np.int64)), pa.array(fp[ok, 1].view(np.int64))], ["doc_id", "hi", "lo"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, hi long, lo long")


def covering(max_distance: int, r: int) -> list[tuple[int, ...]]:
    """r-subsets of the byte positions of which any BYTES - max_distance positions hold one."""
    shared = BYTES - max_distance
    groups = max(1, (shared - 1) // (r - 1)) if r > 1 else BYTES
    return [c for g in range(groups) for c in combinations(range(g, BYTES, groups), r)]


def collisions(prints: DataFrame) -> np.ndarray:
    """For each byte position the chance that two fingerprints agree there."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = _bytes(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1))
            n = np.stack([np.bincount(parts[:, p], minlength=256) for p in range(BYTES)])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.ravel()[at], pa.int64())], ["slot", "n"])

    out = np.zeros(BYTES * 256)
    for slot, n in prints.select("hi", "lo").mapInArrow(count, "slot int, n long").groupBy("slot").sum("n").collect():
        out[slot] = n
    share = out.reshape(BYTES, 256) / max(1, out[:256].sum())
    return (share * share).sum(axis=1)


def subset_size(n: int, agree: np.ndarray, max_distance: int) -> int:
    """The positions a key (any number gives the same pairs) for the least work: n postings for each subset, at 1 us, and the pairs that meet in the lists, at 10 ns."""

    def work(r: int) -> float:
        subsets = covering(max_distance, r)
        meet = sum(float(np.prod(agree[list(s)])) for s in subsets)
        return n * len(subsets) * 1e-6 + n * n / 2 * meet * 1e-8

    return min(range(min(2, BYTES - max_distance), min(6, BYTES - max_distance) + 1), key=work)


def _bytes(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), BYTES)


def matches(x: np.ndarray, y: np.ndarray, max_distance: int) -> np.ndarray:
    """For which differences (x, y: the two halves' XOR) the fingerprints are near: tally of shared positional bytes, then Hamming distance."""
    differ = np.zeros(x.shape, np.uint8)
    for half in (x, y):
        z = half | half >> np.uint64(4)
        z |= z >> np.uint64(2)
        z |= z >> np.uint64(1)
        z &= _LOW
        differ += np.bitwise_count(z)
    at = np.flatnonzero(differ.ravel() <= max_distance)  # at least BYTES - max_distance bytes are shared
    x, y = x.ravel()[at], y.ravel()[at]
    return at[np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= max_distance]


def least_subset(subsets: list[tuple[int, ...]]) -> np.ndarray:
    """For each set of shared positions, as 16 bits, the number of the first subset inside it, or -1."""
    every = np.arange(1 << BYTES)
    out = np.full(1 << BYTES, -1, dtype=np.int32)
    for number in range(len(subsets) - 1, -1, -1):
        mask = sum(1 << p for p in subsets[number])
        out[every & mask == mask] = number
    return out


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs, fewer than there are ends, that connect the same ends."""
    if len(i) < 2:
        return i, j
    ends, flat = np.unique(np.r_[i, j], return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    root, kept = np.arange(len(ends)), []
    number = np.arange(len(i))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y, number = a[open_], b[open_], x[open_], y[open_], number[open_]
        if not len(a):
            break
        high, one = np.unique(np.maximum(x, y), return_index=True)
        kept.append(number[one])
        root[high] = np.minimum(x, y)[one]
        while (up := root[root]).tolist() != root.tolist():
            root = up
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[kept], j[kept]


def posting_pairs(key: np.ndarray, side: np.ndarray, fp: np.ndarray, docs: np.ndarray, numbers: np.ndarray, least: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n) of runs of equal keys: index pairs that connect the near classes, and for each the documents of the classes near it.

    side 0 meets all of its run, side 1 only side 2. numbers is the subset of each row's list; pairs whose least subset is
    another one are left to that list.
    """
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[at, len(key)])
    links = np.zeros(len(key), dtype=np.int64)
    x, y = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(i: np.ndarray, j: np.ndarray) -> None:
        shared = np.packbits(_bytes(fp[i] ^ fp[j]) == 0, axis=1, bitorder="little").view(np.uint16)[:, 0]
        own = least[shared] == numbers[i]
        i, j = i[own], j[own]
        np.add.at(links, i, docs[j])
        np.add.at(links, j, docs[i])
        left.append(i)
        right.append(j)
        if sum(map(len, left)) > 1 << 20:
            i, j = forest(np.concatenate(left), np.concatenate(right))
            left[:], right[:] = [i], [j]

    whole = (size > SHORT) | (side[at] > 0)
    for s, n in zip(at[whole].tolist(), size[whole].tolist()):
        cross = side[s] > 0
        cut = int(np.searchsorted(side[s : s + n], 2)) if cross else n
        step = max(1, (1 << 18) // n)
        for lo in range(0, cut, step):
            hi = min(lo + step, cut)
            first = cut if cross else lo + 1
            if first >= n:
                continue
            hit = matches(x[s + lo : s + hi, None] ^ x[None, s + first : s + n], y[s + lo : s + hi, None] ^ y[None, s + first : s + n], max_distance)
            i, j = np.divmod(hit, n - first)
            i, j = i + s + lo, j + s + first
            later = j > i
            if later.any():
                take(i[later], j[later])
    run = np.repeat(np.arange(len(at)), size)
    short = ~whole[run]
    for d in range(1, int(size[~whole].max(initial=1))):
        i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:])) if d < len(key) else np.zeros(0, int)
        if not len(i):
            break
        i = i[matches(x[i] ^ x[i + d], y[i] ^ y[i + d], max_distance)]
        if len(i):
            take(i, i + d)
    return *forest(np.concatenate(left), np.concatenate(right)), links


def near_classes(classes: DataFrame, max_distance: int, r: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b, n) over distinct fingerprints (rep, hi, lo, docs): edges that join exactly those linked by distances within max_distance (n null), and for each rep (b null) n documents of other classes within it, in parts to be summed."""
    subsets = covering(max_distance, r)
    least = least_subset(subsets)
    posting = "key long, rep long, hi long, lo long, docs long"

    @frugal
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = _bytes(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1))
            for number, subset in enumerate(subsets):
                key = np.full(len(parts), number, dtype=np.uint64)
                for p in subset:
                    key = key << np.uint64(8) | parts[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], ["key", "rep", "hi", "lo", "docs"])

    @frugal
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, part, side, rep, hi, lo, docs = cols
            run = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            i, j, n = posting_pairs(run, side, np.stack([hi, lo], axis=1).view(np.uint64), docs, (key.view(np.uint64) >> np.uint64(8 * r)).astype(np.int64), least, max_distance)
            at = np.flatnonzero(n)
            who, back = np.unique(rep[at], return_inverse=True)
            total = np.bincount(back, n[at], len(who)).astype(np.int64)
            none = np.zeros(len(i) + len(who), dtype=bool)
            none[: len(i)] = True
            return pa.RecordBatch.from_arrays([pa.array(np.r_[rep[i], who]), pa.array(np.r_[rep[j], who], mask=~none), pa.array(np.r_[rep[i], total], mask=none)], ["a", "b", "n"])

        held: list[list[np.ndarray]] = []
        count, enough = 0, 1 << 15
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(7)])
            count += b.num_rows
            if count < enough:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last list may go on in the next batch
            if whole:
                yield found([x[:whole] for x in cols])
            held = [[x[whole:] for x in cols]]
            count = len(cols[0]) - whole
            enough = count + (1 << 15)
        if count:
            yield found([np.concatenate(x) for x in zip(*held)])

    posted = classes.select("rep", "hi", "lo", "docs").mapInArrow(post, posting)
    hot = written(posted.groupBy("key").count().where(F.col("count") > list_rows).select("key", F.ceil(F.col("count") / list_rows).alias("parts")), "hot")
    columns = ("rep", "hi", "lo", "docs")
    if hot.isEmpty():
        dealt = posted.select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), *columns)
    else:
        joined = posted.join(small_side(hot), "key", "left").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.coalesce("parts", F.lit(1).cast("long"))))
        met = joined.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
        part = F.least("own", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        dealt = met.select("key", part.alias("part"), side.alias("side"), *columns)
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(link, "a long, b long, n long")


def near_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, r: int | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc_id, group_id, n_links) of every document in a group of two or more; group_id is the least doc_id of its group, n_links the number of other documents within max_distance of its own fingerprint.

    Documents without words, with null text or null id are in no group. Rows that repeat a
    doc_id count once; if one id comes with different texts, all of them link its groups, and its n_links is the sum
    over its fingerprints. Ties cannot arise: groups are components. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    prints = written(with_fingerprints(docs).distinct(), "prints")
    classes = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    size = subset_size(classes.count(), collisions(classes), max_distance) if r is None else r
    near = written(near_classes(classes, max_distance, size, list_rows), "links")
    several = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    of = prints.join(several, "doc_id").join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select("doc_id", "rep")
    same = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    roots = connected_components(near.where("b is not null").select("a", "b").union(same), "near").withColumnRenamed("node", "rep")
    counts = near.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    placed = classes.join(roots, "rep", "left").where("root is not null or docs > 1").join(counts, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    told = placed.join(least, "root").select("hi", "lo", "group_id", (F.coalesce("n", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return prints.join(told, ["hi", "lo"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.sum("n_links").alias("n_links"))


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the least doc_id. Rows equal in all columns are one document; documents without words or id stay."""
    groups = near_groups(docs, max_distance).where("doc_id <> group_id").select(F.col("doc_id").alias("__lx_gone"))
    gone = written(groups, "gone")
    left = docs.join(small_side(gone), docs["doc_id"] == F.col("__lx_gone"), "left_anti")
    again = written(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__lx_again")), "again")
    rows = again.count()
    if not rows:
        return left
    side = small_side(again)
    single = left.join(side, left["doc_id"] == F.col("__lx_again"), "left_anti")
    return single.union(left.join(side, left["doc_id"] == F.col("__lx_again"), "left_semi").dropDuplicates())


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
