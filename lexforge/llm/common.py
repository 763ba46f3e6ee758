"""Shared plumbing: the shared folder, written tables, size-checked joins, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexforge.llm import textbuf as tb

BROADCAST_BYTES, BATCH_ROWS = 16 << 20, 1000
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local session gets a temporary one, and a cluster an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given.rsplit("/", 1)[0]
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexforge-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session have at most BATCH_ROWS rows from here on, as texts may be long; a lower number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Returns freed memory to the system: a worker that is kept for later tasks would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def frugal(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work, whose task gives its memory back when it ends."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the folders that written() made from mark since up to mark until. Nothing that reads them may run later."""
    for path in _WRITTEN[since:until]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[since:until]


def _width(kind: T.DataType, c: Column) -> Column:
    """About the bytes of one value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = len(kind.elementType.fields) + 2 if isinstance(kind.elementType, T.StructType) else 1
        return F.when(c.isNull(), 0).otherwise(F.size(c)) * 8 * each + 24
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """About the bytes of all rows, from the widths of all values, counted. df should be a written table."""
    each = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0]


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most limit bytes, else as it is, for a shuffled join. df should be a written table: it is counted."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b): root is the least node of its component.

    Alternates large-star and small-star steps, so the rounds grow with the logarithm of the
    longest path; each round ends in a written table. Null ends and loops are dropped.
    """
    pairs = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(),
        name,
    )
    for _ in range(max_rounds):
        mark = written_so_far()
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        a, b = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for x in (pairs, after))
        pairs = after
        release(edges.sparkSession, mark - 1, mark)
        if a == b:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scan_texts(docs: DataFrame, added: str, scan: Callable[[list[str | None]], list[list]], gate: str, column: str = "text") -> DataFrame:
    """docs with columns computed from one text column, in Arrow batches of about a megabyte of text.

    added is a DDL string; scan gets the texts and returns one list for each added column, in
    which an added column named as the text column replaces it. Only texts that match the RE2
    pattern gate are sent to scan; for the rest (nulls too) it is called once with None, whose
    row they all get, except that the text column keeps its value. Columns of docs that bear an
    added name are replaced, all others pass through.
    """
    small_batches(docs.sparkSession)
    new = T._parse_datatype_string(added)
    names = [f.name for f in new.fields]
    kept = [f for f in docs.schema.fields if f.name not in names or f.name == column]
    schema = T.StructType(kept + [f for f in new.fields if f.name != column])
    types = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {n: v[0] for n, v in zip(names, scan([None]))}
        for whole in batches:
            _, offsets = tb.buffers(whole.column(whole.schema.get_field_index(column)))
            for lo, hi in tb.slices(offsets):
                b = whole.slice(lo, hi - lo)
                texts = b.column(b.schema.get_field_index(column))
                hit = pc.fill_null(pc.match_substring_regex(texts, gate), False)
                at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
                found = dict(zip(names, scan(texts.take(pa.array(at)).to_pylist()))) if len(at) else {}
                where = np.full(len(b), len(at), dtype=np.int64)
                where[at] = np.arange(len(at))
                made = {}
                for n in names:
                    if n == column:
                        if len(at):
                            changed = pa.array([*found[n], None], types[n])
                            texts = pc.if_else(hit, changed.take(pa.array(where)), texts)
                    else:
                        made[n] = pa.array([*found.get(n, []), none[n]], types[n]).take(pa.array(where))
                columns = [texts if f.name == column else b.column(b.schema.get_field_index(f.name)) for f in kept] + [made[n] for n in names if n != column]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*[docs[f.name] for f in kept]).mapInArrow(run, schema)
