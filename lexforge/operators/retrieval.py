"""Retrieval: by vectors, by tags, and the token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx

BROADCAST_BYTES, BLOCK_QUERIES, SLACK = 32 << 20, 4096, 1e-9
_PAIRS = "query_id {}, chunk_id {}, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _score(q: np.ndarray, x: np.ndarray, threshold: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, dot product) of the pairs of at least threshold; with k of those that may be among a query's k best."""
    rough = q @ x.T
    least = np.full(len(q), threshold)
    if k is not None and rough.shape[1] > k:
        least = np.maximum(least, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
    i, j = np.nonzero(rough >= (least - SLACK)[:, None])
    exact = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        exact[at] = (q[i[at]] * x[j[at]]).sum(axis=1)
    keep = exact >= threshold
    return i[keep], j[keep], exact[keep]


def scores(queries: DataFrame, vectors: DataFrame, threshold: float = 0.0, n_queries: int | None = None, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs with a dot product of at least threshold (vectors are unit vectors); with k only pairs that may be among a query's k best.

    queries has query_id, query_vector; vectors has chunk_id, vector; null vectors, and those of another length than the queries', are left out. Every pair is scored,
    as exact search does, a matrix product a batch: the queries are broadcast if all of them take at most
    BROADCAST_BYTES, else blocks of both tables meet. n_queries, if known, spares counting.
    """
    q = queries.select("query_id", vx.as_double(F.col("query_vector")).alias("vector")).where("vector is not null")
    v = vectors.select("chunk_id", vx.as_double(F.col("vector")).alias("vector")).where("vector is not null")
    schema = _PAIRS.format(q.schema["query_id"].dataType.simpleString(), v.schema["chunk_id"].dataType.simpleString())
    first = q.first()
    if first is None:
        return q.sparkSession.createDataFrame([], schema)
    dim = len(first["vector"])
    q, v = q.where(F.size("vector") == dim), v.where(F.size("vector") == dim)
    count = q.count() if n_queries is None else n_queries

    def found(ids: pa.Array, matrix: np.ndarray, chunk: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        i, j, d = _score(matrix, x, threshold, k)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), chunk.take(pa.array(j)), pa.array(d)], ["query_id", "chunk_id", "score"])

    if count * (dim + 4) * 8 <= BROADCAST_BYTES:
        held = q.toArrow().combine_chunks()
        shared = q.sparkSession.sparkContext.broadcast((pa.concat_arrays(held.column(0).chunks), _matrix(pa.concat_arrays(held.column(1).chunks))))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for b in batches:
                if b.num_rows:
                    yield found(ids, matrix, b.column(0), _matrix(b.column(1)))

        return v.mapInArrow(each, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_arrays([left.column(0).combine_chunks().slice(0, 0), right.column(0).combine_chunks().slice(0, 0), pa.array([], pa.float64())], ["query_id", "chunk_id", "score"])]
        x = right.combine_chunks().to_batches()
        for a in left.to_batches(max_chunksize=512):
            out += [found(a.column(0), _matrix(a.column(1)), b.column(0), _matrix(b.column(1))) for b in x]
        return pa.Table.from_batches(out)

    rows, columns = -(-count // BLOCK_QUERIES), max(1, -(-v.count() // (4 * BLOCK_QUERIES)))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    place = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).alias(name)
    left = q.select(place("query_id", rows, "row"), spread(columns, "column"), "query_id", "vector")
    right = v.select(spread(rows, "row"), place("chunk_id", columns, "column"), "chunk_id", "vector")
    meet = lambda a, b: both(a.select(["query_id", "vector"]), b.select(["chunk_id", "vector"]))
    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(meet, schema)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def tag_search(queries: DataFrame, items: DataFrame, k: int, by_priority: bool = True) -> DataFrame:
    """(query_id, item_id, matches, rank): items by the number of query words among their tags, then priority, then id.

    queries has query_id, query; items has item_id, tags, priority. A query without words gets the items of highest
    priority (or the first ones). Queries with the same words have the same answer, and of items with the same tags only the first k can be
    in any: so different sets of words meet different sets of tags, in an equi-join by word, and what is shuffled follows the number of sets.
    """
    order = [*([F.desc("priority")] if by_priority else []), F.col("item_id")]
    asked = queries.select("query_id", F.array_sort(F.array_distinct(tx.tokens(tx.normalize(F.col("query"))))).alias("words"))
    sets = asked.select("words").distinct()
    tagged = items.select("item_id", "priority", F.array_sort(F.array_distinct(tx.normalize_each(F.coalesce("tags", F.array().cast("array<string>"))))).alias("tags"))
    first = tagged.withColumn("n", F.row_number().over(Window.partitionBy("tags").orderBy(*order))).where(F.col("n") <= k).drop("n")
    kinds = tagged.select("tags").distinct().select("tags", F.explode("tags").alias("word"))
    hits = sets.select("words", F.explode("words").alias("word")).join(kinds, "word").groupBy("words", "tags").agg(F.count("*").cast("int").alias("matches"))
    found = hits.join(first, "tags").select("words", "item_id", "matches", "priority")
    best = items.select("item_id", "priority").orderBy(*order).limit(k)
    wordless = sets.where(F.size("words") == 0).crossJoin(F.broadcast(best)).select("words", "item_id", F.lit(0).alias("matches"), "priority")
    rank = F.row_number().over(Window.partitionBy("words").orderBy(F.desc("matches"), *order))
    ranked = found.unionByName(wordless).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return asked.join(ranked, "words").select("query_id", "item_id", "matches", "rank")


def notes_by_tags(notes: DataFrame, tags: list[str], k: int) -> DataFrame:
    """Notes with any of the tags, by the number of them, then priority, then id. No tags find nothing."""
    wanted = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    count = F.size(F.array_intersect("tags", wanted))
    return notes.withColumn("match_count", count).where("match_count > 0").orderBy(F.desc("match_count"), F.desc("priority"), "id").limit(k)


def within_budget(items: Column, budget: int) -> Column:
    """Greedy first fit: of an array of structs (tokens, ...) in order, those that still fit; what does not fit is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["tokens"] <= budget
        return F.struct(
            F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).cast("long").alias("used"),
            (s["n"] + 1).alias("n"),
            F.when(fits, F.array_append(s["kept"], s["n"])).otherwise(s["kept"]).alias("kept"),
        )

    return F.transform(F.aggregate(items, start, step, lambda s: s["kept"]), lambda i: F.get(items, i))


def apply_budget(retrieved: DataFrame, budget: int) -> DataFrame:
    """(query_id, chunk_id, tokens, priority, rank) cut to a token budget for each query, by priority, then as they came (rank). place is the order in which they were taken."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("rank"), F.col("chunk_id"), F.col("tokens"))))
    kept = retrieved.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.posexplode(within_budget(F.col("r"), budget)).alias("place", "x"))
    return kept.select("query_id", "x.chunk_id", "x.tokens", "place")
