"""Structured Streaming: notes taken in as their files arrive, and the cache kept per session over a query stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexforge.operators import cache, store
from lexforge.sources import notes


def note_stream(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """id, title, tags, priority, content of each *.md file that comes into a folder."""
    files = spark.readStream.schema("value string").text(folder, wholetext=True, pathGlobFilter="*.md")
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1), r"\.[^.]*$", "")
    return notes.parse_notes(files.select(stem.alias("stem"), F.col("value").alias("raw")), strict)


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of notes, with its number, to a Parquet table, in a folder of its own so that a repeated batch writes the same; current() has the last version of each note."""

    def take(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    return store.latest(spark.read.parquet(table), ["id"], "batch").drop("batch")


def cached_stream(log: DataFrame, capacity: int = 50, peek: int = 3, exact: bool = False) -> DataFrame:
    """session, seq, hit, served for a stream of (session, seq, words, results); a session keeps up to capacity entries.

    State is the list of (key, results) in the order of their last use, replayed into a tree for each
    batch of the session: entries, not tree shape, survive between batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = cache.Session(capacity, peek, exact)
        for k, v in zip(*(state.get if state.exists else ([], []))):
            session.tree.insert(k, list(v))
        out, used = [], {}
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            hit, served = session.ask(r.words, lambda r=r: list(r.results))
            used[" ".join(sorted(set(r.words)))] = len(out)
            out.append((key[0], r.seq, hit, served))
        keys = sorted(session.tree.keys(), key=lambda k: used.get(k, -1))
        state.update((keys, [list(session.tree._find(k)[0][1]) for k in keys]))
        yield pd.DataFrame(out, columns=["session", "seq", "hit", "served"])

    return log.groupBy("session").applyInPandasWithState(step, "session long, seq long, hit boolean, served array<string>", "keys array<string>, held array<array<string>>", "append", GroupStateTimeout.NoTimeout)
