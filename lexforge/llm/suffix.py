"""Operator 9, exact repeats between documents by suffix arrays.

A passage of at least min_words white-space separated words that two documents share is kept in the
document of the least doc_id and is a repeat in every other. Any common run of min_words words has
the same least hash among its GRAM-word windows in both documents (its anchor), so windows meet
under the hash of their anchor: for each anchor a document gives the stretch of words that all its
min_words-windows with that anchor cover, 70 words on average.

Stretches that are equal as wholes are settled at once: all but the first document's are repeats.
What the sort finds in the one copy it gets of them holds for every other, in the same document too.
Of each different stretch under one anchor one copy goes to a shard chosen by the anchor; there the
stretches, each ended by a symbol of its own, are concatenated and sorted by external induced sorting
(lexforge.llm.induced), and runs of suffixes with common prefixes of min_words and more give the
windows that also stand in an earlier document. Nothing else can match, so the result is exact, and
no pair of documents is ever formed.

Anchors are first counted with partial sums, and only those that come up again are shuffled, by anchor and stretch.
A stretch with more than hot_rows copies is settled by a partial minimum and a join with that one row, and an anchor with more than
hot_rows different stretches (a licence that a third of all documents hold, each in its own
surroundings) is not sorted in one place: its windows are compared by their hashes, again with partial minima. So no
task gets all rows of a hot anchor.

What is shuffled: the counts of anchors (one for about 22 words), each anchor of less than hot_rows rows once to meet its count, 48 bytes for each one
that comes up again, and the text of documents that need a suffix sort. The number of shards follows the number of words to sort; a shard far beyond
block_words or memory is sorted from disk, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm import induced
from lexforge.llm import textbuf as tb
from lexforge.llm.common import documents, frugal, shared_dir, small_batches, small_side, written

MIN_WORDS, GRAM, SHARD_WORDS, BLOCK_WORDS, MEMORY, HOT_ROWS = 50, 8, 1 << 20, 1 << 18, 128 << 20, 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ANCHOR = "anchor long, stretch long, doc_id long, version long, lo int, hi int"


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values."""
    n, cur, span = len(h) - w + 1, h, 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def anchors(words: np.ndarray, row: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the stretch, row, first word, end word): runs of min_words-windows with one anchor. Words count from the start of the array."""
    n = len(words) - min_words + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    g = words[: len(words) - gram + 1].copy()
    for j in range(1, gram):
        g = tb.mix(g * tb._C1 + words[j : len(words) - gram + 1 + j])
    least = _least(g, min_words - gram + 1)
    inside = row[:n] == row[min_words - 1 :]
    start = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | (inside[1:] != inside[:-1])])
    end = np.r_[start[1:], n]
    keep = inside[start]
    start, end = start[keep], end[keep] - 1 + min_words
    power = np.cumprod(np.full(len(words), _ODD, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(words), _INVERSE, np.uint64), dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(tb.mix(words) * power, dtype=np.uint64)]
    stretch = tb.mix((total[end] - total[start]) * back[start] ^ tb.mix((end - start).astype(np.uint64)))
    return least[start], stretch, row[start], start, end


def _identified(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def _words(b: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row of each word, number of the first word of each row) of slices of a batch."""
    data, off = tb.buffers(b.column(b.schema.get_field_index(column)))
    for lo, hi in tb.slices(off):
        part = data[off[lo] : off[hi]]
        start, end, row = tb.word_spans(part, off[lo : hi + 1] - off[lo], tb.SPACE)
        yield lo, tb.hash_spans(part, start, end), row, np.searchsorted(row, np.arange(hi - lo + 1))


def _stretches(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, version = (b.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for lo, words, row, first in _words(b):
                anchor, stretch, r, s, e = anchors(words, row, min_words, gram)
                columns = (anchor.view(np.int64), stretch.view(np.int64), doc[lo + r], version[lo + r], (s - first[r]).astype(np.int32), (e - first[r]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _ANCHOR.split(", ")])

    return docs.mapInArrow(scan, _ANCHOR)


_FOUND = "sort boolean, anchor long, doc_id long, version long, lo int, hi int, first_doc long, first_version long, first_lo int"


@frugal
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (anchor, stretch, doc_id, version, lo, hi, active) sorted in that order: the first copy of each stretch of an active anchor (sort true), and the further copies of every stretch, in the first one's document too (sort false)."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    opened: list[np.ndarray] | None = None  # the first row of the stretch that is still open

    def rows(sort: bool, c: list[np.ndarray], first: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c[0]), sort)), pa.array(c[0]), *(pa.array(x) for x in c[2:6]), *(pa.array(x) for x in first)], names)

    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        carried = 0
        if opened is not None:
            c, carried = [np.concatenate(x) for x in zip(opened, c)], 1
        new = np.r_[True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]
        at = np.flatnonzero(new)
        first = [x[at][np.cumsum(new) - 1] for x in c[2:5]]
        # a row given twice is no copy of itself
        copy = (c[2] != first[0]) | (c[3] != first[1]) | (c[4] != first[2])
        give = new & c[6].astype(bool)
        give[:carried] = False
        for sort, those in ((False, copy), (True, give)):
            if those.any():
                yield rows(sort, [x[those] for x in c], [x[those] for x in first])
        opened = [x[[at[-1]]] for x in c]


def _meeting(anchored: DataFrame, hot_rows: int) -> DataFrame:
    """_FOUND of all stretches: what _settle() gives, without a task that gets all rows of a hot anchor or stretch."""
    n = F.count("*").alias("n")
    ends = anchored.groupBy("anchor").agg(n, F.min("stretch").alias("s0"), F.max("stretch").alias("s1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("n > 1")
    shared = written(ends.select("anchor", "n", F.expr("s0 <> s1 and d0 <> d1").alias("active")), "shared")
    # the few anchors with many rows meet theirs where these are; the rest are merged by anchor, at every size alike
    crowd = small_side(shared.where(F.col("n") > hot_rows))
    dense = anchored.join(crowd, "anchor")
    sparse = anchored.join(crowd.select("anchor"), "anchor", "left_anti").join(shared.where(F.col("n") <= hot_rows).hint("merge"), "anchor")
    again = sparse.unionByName(dense)
    columns = ("anchor", "stretch", "doc_id", "version", "lo", "hi", "active")
    hot = written(dense.groupBy("anchor", "stretch").agg(n, F.min(F.struct("doc_id", "version", "lo", "hi", "active")).alias("first")).where(F.col("n") > hot_rows).select("anchor", "stretch", "first"), "hot")
    if hot.isEmpty():
        rest, more = again, None
    else:
        one = small_side(hot)
        rest = again.join(one, ["anchor", "stretch"], "left_anti")
        copies = again.join(one, ["anchor", "stretch"]).where("doc_id <> first.doc_id or version <> first.version or lo <> first.lo").select(F.lit(False).alias("sort"), "anchor", "doc_id", "version", "lo", "hi", "first.doc_id", "first.version", "first.lo")
        firsts = hot.where("first.active").select(F.lit(True).alias("sort"), "anchor", "first.doc_id", "first.version", "first.lo", "first.hi", "first.doc_id", "first.version", "first.lo")
        more = copies.union(firsts)
    settled = rest.select(*columns).repartition("anchor", "stretch").sortWithinPartitions("anchor", "stretch", "doc_id", "version", "lo").mapInArrow(_settle, _FOUND)
    return settled if more is None else settled.union(more)


def _shard(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(anchor, doc_id, words binary, lo, version) of the stretches to sort."""
    per_doc = jobs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("jobs"))
    ids = written(jobs.select("doc_id").distinct(), "sortable")
    need = docs.join(small_side(ids), "doc_id", "left_semi")
    joined = need.join(per_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "jobs")

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, version = (b.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            jobs = b.column(3)
            ends = jobs.offsets.to_numpy()
            flat = [jobs.values.field(c).to_numpy(zero_copy_only=False) for c in range(3)]
            for lo, words, _, first in _words(b):
                out: list[list] = [[], [], [], [], []]
                for r in range(len(first) - 1):
                    own = words[first[r] : first[r + 1]]
                    for j in range(ends[lo + r], ends[lo + r + 1]):
                        s, e = int(flat[1][j]), int(flat[2][j])
                        for column, x in zip(out, (int(flat[0][j]), int(doc[lo + r]), int(version[lo + r]), s, own[s:e].tobytes())):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "doc_id", "version", "lo", "words"])

    return joined.dropDuplicates(["doc_id", "version"]).mapInArrow(cut, "anchor long, doc_id long, version long, lo int, words binary")


def _by_hash(stretches: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, lo, s, e, f of the windows of _shard()'s stretches that also stand in an earlier document, by the hashes of windows."""

    @frugal
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, version, lo, words = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "version", "lo", "words"))
            length = np.array([len(w) // 8 for w in words.to_pylist()], dtype=np.int64)
            flat = np.frombuffer(b"".join(words.to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(length)), length)
            n = len(flat) - min_words + 1
            if n < 1:
                continue
            at = np.flatnonzero(row[:n] == row[min_words - 1 :])
            h = flat[: len(flat)].copy()
            span, size = h, 1  # hashes of runs of size words, doubled, then joined
            while size * 2 <= min_words:
                span = tb.mix(span[: len(span) - size] * tb._C1 + span[size:])
                size *= 2
            h = tb.mix(span[: n] * tb._C2 + span[min_words - size : min_words - size + n])[at]
            r = row[at]
            begin = np.cumsum(length) - length
            start = (lo.to_numpy(zero_copy_only=False)[r] + at - begin[r]).astype(np.int32)
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), doc.take(take), version.take(take), lo.take(take), pa.array(start)], ["window", "doc_id", "version", "lo", "s"])

    each = stretches.mapInArrow(hashes, "window long, doc_id long, version long, lo int, s int")
    first = written(each.groupBy("window").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("last")).where("f < last").select("window", "f"), "first")
    return each.join(small_side(first), "window").where("doc_id > f").select("doc_id", "version", "lo", "s", (F.col("s") + min_words).alias("e"), "f")


def sort_stretches(stretches: Iterator[tuple[int, int, int, np.ndarray]], folder: str, min_words: int, block: int, memory: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, version, first word of the stretch, first word, first document) of each window of min_words words that also stands in an earlier document of the shard."""
    store = induced.Store(folder, memory)
    try:
        raw, known = induced.Spool(store), np.zeros(0, np.int64)
        docs, versions, lows, sizes, held, count = [], [], [], [], [], 0
        fresh = []

        def flush() -> None:
            nonlocal known, held, fresh, count
            if held:
                part = np.concatenate(held)
                raw.append(part)
                fresh.append(np.unique(part))
                known = np.unique(np.concatenate([known, *fresh]))
                held, fresh, count = [], [], 0

        for doc, version, lo, words in stretches:
            docs.append(doc)
            versions.append(version)
            lows.append(lo)
            sizes.append(len(words))
            held.append(words.view(np.int64))
            count += len(words)
            if count >= block:
                flush()
        flush()
        total = len(sizes)
        if total < 2:
            return
        size = np.array(sizes, dtype=np.int64)
        doc, version, low = np.array(docs, np.int64), np.array(versions, np.int64), np.array(lows, np.int64)
        # the text: words by rank above the end symbols, of which each stretch has its own, the last the least
        text, at, ends = induced.Spool(store), 0, np.cumsum(size)
        w = 0
        while w < total:
            stop = min(total, max(w + 1, int(np.searchsorted(ends, at + block, side="right"))))
            part = raw.read(at, int(ends[stop - 1]))
            text.append(np.insert(np.searchsorted(known, part) + total, ends[w:stop] - at, total - 1 - np.arange(w, stop)))
            at, w = int(ends[stop - 1]), stop
        raw.drop()
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        pos, lcp = induced.suffix_array(text, block, store)
        rest_p, rest_l = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(pos), block):
            b = min(len(pos), a + block)
            p, l = np.concatenate([rest_p, pos.read(a, b)]), np.concatenate([rest_l, lcp.read(a, b)])
            heads = np.flatnonzero(l < min_words)
            cut = len(p) if b == len(pos) else int(heads[-1]) if len(heads) else 0  # a run may go on
            rest_p, rest_l = p[cut:], l[cut:]
            p, l = p[:cut], l[:cut]
            if not len(p):
                continue
            run = np.cumsum(l < min_words)
            alone = np.bincount(run)[run] < 2
            p, run = p[~alone], run[~alone]
            if not len(p):
                continue
            owner = np.searchsorted(begin, p, side="right") - 1
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            first = np.repeat(np.minimum.reduceat(doc[owner], starts), np.diff(np.r_[starts, len(p)]))
            late = doc[owner] > first
            if not late.any():
                continue
            o = owner[late]
            yield doc[o], version[o], low[o], low[o] + p[late] - begin[o], first[late]
    finally:
        store.close()


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, block: int = BLOCK_WORDS, memory: int = MEMORY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, version, start_word, end_word, first_doc: the maximal stretches of each document whose every min_words-window stands in an earlier document.

    Documents are told apart by doc_id; first_doc is the least id any of the windows stands in.
    version is xxhash64 of the text, for ids that come with several texts; rows that repeat both are
    one. Repeats inside one document don't count. Null ids, null texts and texts of fewer than
    min_words words share nothing. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    spec = _identified(docs)
    found = written(_meeting(written(_stretches(spec, min_words, gram), "anchors"), hot_rows), "stretches")
    jobs = found.where("sort").select("anchor", "doc_id", "version", "lo", "hi").distinct()
    crowded = written(jobs.groupBy("anchor").count().where(F.col("count") > hot_rows).select("anchor"), "crowded")
    words = found.where("sort").agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()[0]
    copies = found.where("not sort")
    whole = copies.where("doc_id > first_doc").select("doc_id", "version", F.col("lo").alias("s"), F.col("hi").alias("e"), F.col("first_doc").alias("f"))
    windows = whole
    if words:
        folder = shared_dir(spark) + "/lexforge-suffixes"

        @frugal
        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def stretches() -> Iterator[tuple[int, int, int, np.ndarray]]:
                for b in batches:
                    yield from ((d, v, lo, np.frombuffer(w, np.uint64)) for d, v, lo, w in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "lo", "words"))))

            for d, v, lo, s, f in sort_stretches(stretches(), folder, min_words, block, memory):
                # windows of one stretch side by side make one
                order = np.lexsort((s, lo, v, d))
                d, v, lo, s, f = d[order], v[order], lo[order], s[order], f[order]
                at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (s[1:] - s[:-1] > 1)]) if len(d) else np.zeros(0, int)
                last = np.r_[at[1:], len(d)] - 1
                least = np.minimum.reduceat(f, at) if len(at) else f
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(v[at]), pa.array(lo[at], pa.int32()), pa.array(s[at], pa.int32()), pa.array(s[last] + min_words, pa.int32()), pa.array(least)], ["doc_id", "version", "lo", "s", "e", "f"])

        shards = max(1, -(-words // shard_words))
        alone = crowded.isEmpty()
        calm = jobs if alone else jobs.join(small_side(crowded), "anchor", "left_anti")
        late = _shard(spec, calm).repartition(shards, "anchor").mapInArrow(sort, "doc_id long, version long, lo int, s int, e int, f long")
        if not alone:
            late = late.union(_by_hash(_shard(spec, jobs.join(small_side(crowded), "anchor", "left_semi")), min_words))
        late = written(late, "windows")
        of = late.select(F.col("doc_id").alias("first_doc"), F.col("version").alias("first_version"), F.col("lo").alias("first_lo"), "s", "e", "f")
        again = copies.join(of, ["first_doc", "first_version", "first_lo"]).select("doc_id", "version", (F.col("s") - F.col("first_lo") + F.col("lo")).alias("s"), (F.col("e") - F.col("first_lo") + F.col("lo")).alias("e"), "f")
        windows = whole.union(late.drop("lo")).union(again)
    own = Window.partitionBy("doc_id", "version")
    before = F.max("e").over(own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    # stretches that touch without a window across their border are two repeats
    marked = windows.withColumn("new", F.when(before.isNull() | (F.col("s") > before - min_words + 1), 1).otherwise(0))
    numbered = marked.withColumn("part", F.sum("new").over(own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "version", "part").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("f").alias("first_doc"))
    return merged.select("doc_id", "version", "start_word", "end_word", "first_doc")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; what stood between its words stays with the word before."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, _, _ = tb.word_spans(data, np.array([0, len(data)]), tb.SPACE)
    ends = np.append(start, len(data))
    keep = np.ones(len(data), dtype=bool)
    for s, e in spans:
        keep[ends[s] : ends[min(e, len(start))]] = False
    return data[keep].tobytes().decode()


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, **options: int) -> DataFrame:
    """docs without the repeats; documents of which no word is left go. n_chars (if there) is that of the new text.

    Documents without repeats, and rows with null ids or texts, stay as they are. Rows that repeat a
    doc_id are each cut by their own text's spans.
    """
    spans = written(repeats(docs, min_words, **options).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__lx_spans")), "repeats")
    side = small_side(spans.select(F.col("doc_id").alias("__lx_id"), F.col("version").alias("__lx_version"), "__lx_spans"))
    keyed = docs.withColumn("__lx_text_id", F.xxhash64("text"))
    joined = keyed.join(side, (docs["doc_id"] == F.col("__lx_id")) & (F.col("__lx_text_id") == F.col("__lx_version")), "left")

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts, spans = b.column(names.index("text")), b.column(names.index("__lx_spans"))
            at = np.flatnonzero(~spans.is_null().to_numpy(zero_copy_only=False))
            if len(at):
                texts = texts.to_pylist()
                for k in at.tolist():
                    texts[k] = cut_words(texts[k], [(x["start_word"], x["end_word"]) for x in spans[k].as_py()])
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else b.column(i) for i, n in enumerate(names)], names=names)

    wide = joined.select(*[docs[c] for c in docs.columns], "__lx_spans")
    out = wide.mapInArrow(cut, wide.schema).where("__lx_spans is null or text rlike '[^\\\\x00-\\\\x20\\\\x7f]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__lx_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).select("doc_id", "start_word", "end_word", F.col("first_doc").alias("first_doc_id"))
