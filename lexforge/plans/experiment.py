"""Whole runs: synchronise notes into the store, retrieve for a prompt, compare configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import chunking, evaluation, retrieval, store
from lexforge.operators.index import Encoder
from lexforge.plans import registry, strategies  # noqa: F401  (strategies registers itself)


def synchronise(seen: DataFrame, notes: DataFrame, chunks: DataFrame, stages: list[tuple[str, dict]], now: Column, delete_removed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, chunks, status) after taking in seen (id, title, content, tags, priority): only new and modified notes are chunked again."""
    strategy = registry.name(stages)
    status = store.classify(seen, notes, chunks, strategy)
    work = seen.join(status.where("status in ('new', 'modified')").select("id"), "id", "left_semi")
    full = work.withColumns({"content_hash": F.lit(None).cast("string"), "created_at": F.lit(None).cast(notes.schema["created_at"].dataType), "updated_at": F.lit(None).cast(notes.schema["updated_at"].dataType)})
    after = store.upsert_notes(notes, full.drop("created_at", "updated_at", "content_hash"), now)
    fragments = registry.run(work.select(F.col("id").alias("note_id"), "content"), stages)
    rows = fragments.select("note_id", F.posexplode("fragments").alias("order", "content"))
    fresh = store.with_chunk_facts(
        rows.select(F.concat_ws("::", "note_id", F.col("order").cast("string"), F.lit(strategy)).alias("id"), "note_id", tx.fragment_title(F.col("content"), F.col("note_id")).alias("title"), "content", F.lit(strategy).alias("strategy"), "order")
    )
    changed = work.join(notes.select("id", F.col("content_hash").alias("__h")), "id").where(F.col("__h") != tx.content_hash(F.col("content"))).select(F.col("id").alias("note_id"))
    again = work.select(F.col("id").alias("note_id"), F.lit(strategy).alias("strategy"))
    kept = chunks.join(changed, "note_id", "left_anti").join(again, ["note_id", "strategy"], "left_anti").select(*chunks.columns)
    if delete_removed:
        gone = status.where("status = 'stale'").select("id")
        after = after.join(gone, "id", "left_anti")
        kept = kept.join(gone.withColumnRenamed("id", "note_id"), "note_id", "left_anti").select(*chunks.columns)
    return after, kept.unionByName(fresh.select(*chunks.columns)), status


def prompt_context(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 5, threshold: float = 0.5, budget: int = 2048) -> DataFrame:
    """query_id and the context text: top-k chunks within half the token budget, by priority, then relevance."""
    found = retrieval.top_k(retrieval.scores(queries, vectors, threshold, k=k), k)
    rows = found.join(chunks.select(F.col("id").alias("chunk_id"), "title", "content", "priority"), "chunk_id").withColumn("tokens", tx.token_estimate(F.col("content")))
    kept = retrieval.apply_budget(rows.select("query_id", "chunk_id", "tokens", "priority", "rank"), budget // 2).select("query_id", "chunk_id", "place")
    items = rows.join(kept, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("title").alias("heading"), F.col("content").alias("body")))).alias("x"))
    return items.select("query_id", tx.format_prompt(F.col("x"), "Context").alias("context"))


def experiment(results: DataFrame) -> DataFrame:
    """Runs compared: (run, query_id, contents, score, ..., latency_ms, cache_hit, from_cache) to one row a run with its bests."""
    facts = evaluation.performance(results.withColumn("query_id", F.struct("run", "query_id"))).select("query_id.run", "query_id.query_id", "context_tokens", "e_tok")
    return evaluation.compare(evaluation.aggregate(results.join(facts, ["run", "query_id"])))


def chunked(notes: DataFrame, stages: list[tuple[str, dict]], encoder: Encoder | None = None) -> DataFrame:
    """Chunks (id, note_id, title, content, order, strategy, tags, priority) of notes (id, content, tags, priority) by a pipeline of chunkers."""
    facts = ("tags", "priority")
    made = registry.run(notes.select(F.col("id").alias("note_id"), "content", *facts), stages, encoder, facts)
    return chunking.adapt(made, facts).withColumnRenamed("chunk_id", "id").withColumn("strategy", F.lit(registry.name(stages)))


def run_matrix(notes: DataFrame, queries: DataFrame, runs: list[dict], encoder: Encoder, index: DataFrame | None = None, judge_cache: DataFrame | None = None, scorer=None) -> DataFrame:
    """Chunkers x strategies over one set of queries (query_id, query, relevant): one row for each run and query that found something.

    A run is {name, stages, strategy, top_k (5), options}; notes are chunked once for each of its different pipelines, and only
    chunks without a vector in index are encoded. run, query_id, query, retrieved (ids in order), contents, relevant, cache_hit, and, with a
    judge_cache or a scorer, its scores. experiment() compares the runs; ir_metrics() takes retrieved and relevant.
    """
    made: dict[str, DataFrame] = {}
    out = None
    for r in runs:
        strategy = registry.name(r["stages"])
        key = repr(r["stages"])
        if key not in made:
            made[key] = chunked(notes, r["stages"], encoder)
        chunks = made[key]
        held = index if index is not None else notes.sparkSession.createDataFrame([], "chunk_id string, vector array<float>, dim int")
        found = registry.get_strategy(r["strategy"])(queries, chunks, held, encoder, r.get("top_k", 5), chunking=strategy, **r.get("options", {}))
        rows = found.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
        got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("r"), F.bool_or("cache_hit").alias("cache_hit"))
        one = got.select(F.lit(r["name"]).alias("run"), "query_id", F.col("r.chunk_id").alias("retrieved"), F.col("r.content").alias("contents"), "cache_hit").join(queries.select("query_id", "query", "relevant"), "query_id")
        out = one if out is None else out.unionByName(one)
    if judge_cache is None and scorer is None:
        return out
    cache = judge_cache if judge_cache is not None else notes.sparkSession.createDataFrame([], "hash string, faithfulness double, answer_relevancy double, context_precision double, context_recall double")
    keyed = out.withColumn("query_id", F.struct("run", "query_id"))
    scores = evaluation.judged(keyed.select("query_id", "query", F.col("contents").alias("contexts")), cache, scorer)
    mean = (F.col("faithfulness") + F.col("answer_relevancy") + F.col("context_precision") + F.col("context_recall")) / 4
    return out.join(scores.select("query_id.run", "query_id.query_id", "faithfulness", "answer_relevancy", "context_precision", "context_recall", "from_cache", mean.alias("score")), ["run", "query_id"])


def add_notes(new: DataFrame, notes: DataFrame, chunks: DataFrame, now: Column, max_tokens: int = 512) -> tuple[DataFrame, DataFrame]:
    """(notes, chunks) with new notes (id, content, tags, priority) put in and cut by sections; tags in lower case, titles from the text. Older chunks of the same ids are replaced, others stay."""
    title = tx.note_title(F.col("content"), F.col("id"))
    full = new.select("id", title.alias("title"), "content", F.transform("tags", lambda t: F.lower(t)).alias("tags"), "priority")
    after = store.upsert_notes(notes, full, now)
    cut = chunking.section_chunks(new.select(F.col("id").alias("note_id"), "content"), max_tokens).withColumnRenamed("chunk_id", "id")
    rows = store.with_chunk_facts(store.latest(cut, ["id"], "order").withColumn("strategy", F.lit("sections")))
    return after, store.upsert(chunks, rows.select(*chunks.columns), ["id"])
