"""The vector index: encoders of texts, and the table of vectors kept in step with the chunks.

An encoder is a function of a list of texts that returns a matrix of floats, a unit vector a row (a
row of NaN: it cannot encode that text). It runs in Arrow batches on the executors, so whatever it
needs (a model's path) travels with it. Vectors are kept as float, as the store keeps them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions import text as tx
from lexforge.operators import store

Encoder = Callable[[list[str]], np.ndarray]
DIM, BLOCK_TEXTS = 32, 10_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{Mn}_]{2,}")
#: Latin-1 with a blank for what is in no word
_LATIN = bytes(k if regex.match(r"[\p{L}\p{N}\p{Mn}_]", chr(k)) else 32 for k in range(256))


def _different_words(text: str) -> set:
    """The different words of a text in lower case, as str, or as Latin-1 bytes where the text can be so; one of a single character may be among them."""
    low = text.lower()
    try:
        return set(low.encode("latin-1").translate(_LATIN).split())
    except UnicodeEncodeError:
        return set(_WORD.findall(low))


def _digest(word: str | bytes) -> bytes:
    """32 bytes of a word; null for a word of one character."""
    if len(word) < 2:
        return b""
    return hashlib.sha256(word if isinstance(word, bytes) and word.isascii() else (word.decode("latin-1") if isinstance(word, bytes) else word).encode()).digest()


def hashed_encoder(texts: list[str]) -> np.ndarray:
    """A stand-in for a model: the sum of a fixed random vector for each different word, of length 1; a text without words has the null vector."""
    out = np.zeros((len(texts), DIM))
    for lo in range(0, len(texts), BLOCK_TEXTS):
        out[lo : lo + BLOCK_TEXTS] = _sums(texts[lo : lo + BLOCK_TEXTS])
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def _sums(texts: list[str]) -> np.ndarray:
    """The sums of the words' vectors, a row a text: words are numbered as they come, their vectors gathered and added at once."""
    number: defaultdict[str | bytes, int] = defaultdict(count().__next__)
    places, sizes = [], []
    for text in texts:
        words = _different_words(text)
        sizes.append(len(words))
        places.extend(map(number.__getitem__, words))
    out = np.zeros((len(texts), DIM), np.int64)
    if places:
        digests = list(map(_digest, number))
        long = np.array([len(d) > 0 for d in digests])
        vectors = np.zeros((len(digests), DIM), np.int16)
        vectors[long] = 2 * np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIM).astype(np.int16) - 255
        sizes = np.array(sizes)
        starts = np.cumsum(sizes) - sizes
        filled = sizes > 0
        at = np.fromiter(places, np.int64, len(places))
        out[filled] = np.add.reduceat(vectors[at], starts[filled], axis=0, dtype=np.int64)
    return out


def _vectors(texts: pa.Array, encoder: Encoder) -> pa.Array:
    """list<float> of texts; null where there is no text or no vector."""
    matrix = np.asarray(encoder(texts.drop_null().to_pylist()), dtype=np.float32) if len(texts) > texts.null_count else np.zeros((0, 0), np.float32)
    good = ~np.isnan(matrix).any(axis=1)
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    there[np.flatnonzero(there)[~good]] = False
    starts = np.cumsum(np.r_[0, there]) * matrix.shape[1]
    offsets = pa.array(starts.astype(np.int32), mask=np.r_[~there, False])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix[good].ravel()))


def encoded(text: Column, encoder: Encoder) -> Column:
    """The vector of a text column, null for null."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return _vectors(texts, encoder)

    return run(text)


def with_unit_vectors(frame: DataFrame, units: str, name: str, encoder: Encoder) -> DataFrame:
    """frame with the vectors of all units of a column of arrays of arrays of texts (the units of each fragment), in the same shape.

    A step of its own in the plan, as the optimiser may move a function's call into a lambda, where it could not run.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index(units))
            groups = rows.flatten()
            inner = pa.ListArray.from_arrays(_offsets(groups), _vectors(groups.flatten(), encoder))
            made = pa.ListArray.from_arrays(_offsets(rows), inner)
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return frame.mapInArrow(run, schema)


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    return pa.array(np.cumsum(np.r_[0, sizes]).astype(np.int32), mask=np.r_[~lists.is_valid().to_numpy(zero_copy_only=False), False])


def build(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """(chunk_id, vector, dim) of chunks (id, tags, content); chunks that cannot be encoded are left out."""
    text = tx.embedding_text(F.col("id"), F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("content", F.lit("")))
    return store.with_dim(chunks.select(F.col("id").alias("chunk_id"), encoded(text, encoder).alias("vector")).where("vector is not null"))


def update(index: DataFrame, chunks: DataFrame, encoder: Encoder, force: bool = False) -> DataFrame:
    """The index with the vectors of those chunks that had none, or (force) of all of them anew; other vectors stay. Nothing else is encoded."""
    ids = chunks.select(F.col("id").alias("chunk_id"))
    work = chunks if force else store.chunks_without_embeddings(chunks, index)
    kept = index.join(ids, "chunk_id", "left_anti") if force else index
    columns = ["chunk_id", "vector", "dim"]
    return kept.select(*columns).unionByName(build(work, encoder).select(*columns))


def load(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, vector) of the chunks that have a vector; the others are passed over."""
    return index.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "vector")
