"""Retrieval strategies by name: (queries, chunks, index, encoder, top_k, options) -> query_id, rank, chunk_id, score, cache_hit.

queries has query_id, query; chunks has id, tags, content, strategy; index has chunk_id, vector, dim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import cache, index, retrieval, store
from lexforge.plans.registry import register_strategy


def prepared(chunks: DataFrame, vectors: DataFrame, encoder: index.Encoder, chunking: str | None = None) -> DataFrame:
    """(chunk_id, vector) of the chunks of one way of chunking (or of all); those without a vector are encoded on the fly. Write index.update() to keep them."""
    mine = chunks if chunking is None else chunks.where(F.col("strategy") == chunking)
    # load(update()) without a second pass over all chunks: those just encoded are among them
    fresh = index.build(store.chunks_without_embeddings(mine, vectors), encoder)
    return index.load(vectors, mine).unionByName(fresh.select("chunk_id", "vector"))


@register_strategy("embeddings")
def embeddings(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, encoder: index.Encoder, top_k: int = 5, threshold: float = 0.0, chunking: str | None = None) -> DataFrame:
    """Exact search by dot product: the top_k chunks of at least threshold; ties by chunk_id."""
    asked = queries.select("query_id", index.encoded(F.col("query"), encoder).alias("query_vector"))
    found = retrieval.scores(asked, prepared(chunks, vectors, encoder, chunking), threshold, k=top_k)
    return retrieval.top_k(found, top_k).select("query_id", "rank", "chunk_id", "score", F.lit(False).alias("cache_hit"))


@register_strategy("splay")
def splay(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, encoder: index.Encoder, top_k: int = 5, threshold: float = 0.0, chunking: str | None = None, capacity: int = 50, peek: int = 3, exact: bool = False) -> DataFrame:
    """What the cache holds for a query that shares a word with one of its top entries (or, exact, repeats it), else exact search, whose result is cached.

    queries may have seq (its order; else query_id) and session (a cache each; else one for all, whose log is replayed in one task, as each answer depends on those before).
    """
    found = embeddings(queries, chunks, vectors, encoder, top_k, threshold, chunking)
    item = F.struct("rank", "chunk_id", "score")
    lists = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.to_json(x)).alias("results"))
    session = F.col("session") if "session" in queries.columns else F.lit(0)
    seq = F.col("seq") if "seq" in queries.columns else F.col("query_id")
    log = queries.select("query_id", session.cast("long").alias("session"), seq.cast("long").alias("seq"), tx.tokens(F.lower("query")).alias("words")).join(lists, "query_id", "left")
    log = log.withColumn("results", F.coalesce("results", F.array().cast("array<string>")))
    played = cache.simulate(log, capacity, peek, exact).join(log.select("query_id", "session", "seq"), ["session", "seq"])
    kind = f"rank int, chunk_id {found.schema['chunk_id'].dataType.simpleString()}, score double"
    return played.select("query_id", "hit", F.explode("served").alias("x")).select("query_id", F.from_json("x", kind).alias("x"), "hit").select("query_id", "x.rank", "x.chunk_id", "x.score", F.col("hit").alias("cache_hit")).where(F.col("rank") <= top_k)
