"""The note store: notes, chunks, embeddings and links as tables, every change a new table.

notes(id, title, content, tags, priority, content_hash, created_at, updated_at),
chunks(id, note_id, title, content, strategy, order, content_hash, token_estimate),
embeddings(chunk_id, vector, dim), links(src, tgt, similarity, link_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by the column order (unique within a key)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of old with its keys; both have the same columns, and new has a key once."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def upsert_notes(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Upsert that keeps created_at of known notes and computes the content hash."""
    known = old.select("id", F.col("created_at").alias("__created"))
    fresh = new.join(known, "id", "left").withColumns({"content_hash": tx.content_hash(F.col("content")), "created_at": F.coalesce("__created", now), "updated_at": now})
    return upsert(old, fresh.select(*old.columns), ["id"])


def with_chunk_facts(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"content_hash": tx.content_hash(F.col("content")), "token_estimate": tx.token_estimate(F.col("content"))})


def with_dim(embeddings: DataFrame) -> DataFrame:
    return embeddings.withColumns({"vector": F.col("vector").cast("array<float>"), "dim": F.size("vector")})


def needs_update(seen: DataFrame, notes: DataFrame, chunks: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    """seen (id, content) with needs_update: unknown, or other content, or (for a strategy) no chunk of it."""
    out = seen.join(notes.select("id", F.col("content_hash").alias("__hash")), "id", "left")
    stale = F.col("__hash").isNull() | (F.col("__hash") != tx.content_hash(F.col("content")))
    if strategy is not None:
        have = chunks.where(F.col("strategy") == strategy).select(F.col("note_id").alias("id"), F.lit(True).alias("__have")).distinct()
        out = out.join(have, "id", "left")
        stale = stale | F.col("__have").isNull()
    return out.select(*seen.columns, stale.alias("needs_update"))


def classify(seen: DataFrame, notes: DataFrame, chunks: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    """id and status of each note on either side: new, modified, unchanged or stale."""
    judged = needs_update(seen, notes, chunks, strategy).select("id", "needs_update")
    both = judged.join(notes.select("id", F.lit(True).alias("__known")), "id", "full")
    status = F.when(F.col("needs_update").isNull(), "stale").when(F.col("__known").isNull(), "new").when(F.col("needs_update"), "modified").otherwise("unchanged")
    return both.select("id", status.alias("status"))


def sync_report(status: DataFrame) -> DataFrame:
    return status.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "modified", "unchanged", "stale")])


def delete_notes(gone: DataFrame, notes: DataFrame, chunks: DataFrame, embeddings: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Deletes notes (ids in gone) with all that hangs on them."""
    ids = gone.select("id")
    dead = chunks.join(ids.withColumnRenamed("id", "note_id"), "note_id", "left_semi").select("id")
    return (notes.join(ids, "id", "left_anti"), *delete_chunks(dead, chunks, embeddings, links))


def delete_chunks(dead: DataFrame, chunks: DataFrame, embeddings: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        chunks.join(dead, "id", "left_anti"),
        embeddings.join(dead.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti"),
        links.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "tgt"), "tgt", "left_anti").select(*links.columns),
    )


def embeddings_of(embeddings: DataFrame, chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    if strategy is not None:
        chunks = chunks.where(F.col("strategy") == strategy)
    return embeddings.join(chunks.withColumnRenamed("id", "chunk_id").select("chunk_id", "note_id", "order"), "chunk_id")


def chunks_without_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def chunks_with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_semi")


def links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, similarity, link_type) of links at either end of the given ids; a loop counts once."""
    out = links.select(F.col("src").alias("id"), F.col("tgt").alias("other"), "similarity", "link_type")
    into = links.where("src <> tgt").select(F.col("tgt").alias("id"), F.col("src").alias("other"), "similarity", "link_type")
    return out.union(into).join(ids, "id", "left_semi")


def linked_chunks(links: DataFrame, ids: DataFrame, chunks: DataFrame) -> DataFrame:
    return links_of(links, ids).join(chunks.select(F.col("id").alias("other"), "title", "content"), "other").select("id", "other", "title", "similarity", "link_type")


def delete_links_of_notes(links: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    own = chunks.join(gone.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return links.join(own.select(F.col("id").alias("src")), "src", "left_anti").join(own.select(F.col("id").alias("tgt")), "tgt", "left_anti").select(*links.columns)


def stats(**tables: DataFrame) -> DataFrame:
    rows = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def titles_per_note(chunks: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("order", "title")))
    return chunks.groupBy("note_id").agg(F.array_join(F.transform(rows, lambda x: x["title"]), ", ").alias("titles"), F.count("*").alias("n_chunks"))


def detect_changes(seen: DataFrame, chunks: DataFrame) -> DataFrame:
    """new, modified or unchanged for each seen note against the hash of its first stored chunk."""
    first = chunks.groupBy("note_id").agg(F.min_by("content_hash", "order").alias("__hash")).withColumnRenamed("note_id", "id")
    joined = seen.join(first, "id", "left")
    state = F.when(F.col("__hash").isNull(), "new").when(F.col("__hash") != tx.content_hash(F.col("content")), "modified").otherwise("unchanged")
    return joined.select("id", state.alias("state"))


def vacuum(table: DataFrame, path: str, files: int) -> DataFrame:
    """Rewrites a table into so many files at path."""
    table.repartition(files).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Any SQL over the tables."""
    return spark.sql(query, **tables)
