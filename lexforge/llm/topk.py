"""Operator 10, exact top-k by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance r to it, and the table is range
partitioned and sorted by that key: a block is a run of at most block_rows vectors of one pivot's
cell, an annulus from r_min to r_max. The queries are the rows whose id is divisible by every,
against all rows. A query's own block gives a first bound tau, the distance of its k-th neighbour
there. By the triangle inequality a vector x of cell c
has |d(q, c) - r(x)| <= d(q, x), and as x is nearest to c, (d(q, c) - d(q, own)) / 2 <= d(q, x) as
well. So a query visits another block only if its annulus reaches into [d(q, c) - tau, d(q, c) + tau], and
inside it only the part of the sorted annulus within that window, from the nearest rings outwards,
with tau falling on the way, from block to block too. The result is exact whatever the pivots are.

Pivots come from a few rounds of k-means over a sample; cell_rows and max_pivots bound its size
and change the speed only. Neighbouring blocks make a group of about group_rows vectors, and a query
goes once to each group of which it can't exclude every block, in chunks of about chunk_queries queries, so
that a task holds one group and one chunk. The directory of blocks has at most MAX_BLOCKS entries and
one for each cell, as blocks grow with the table beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import written

K, EVERY, BLOCK_ROWS, CELL_ROWS, MAX_PIVOTS, SAMPLE_PER_PIVOT, SLACK = 10, 100, 4096, 512, 1024, 8, 1e-9
GROUP_ROWS, CHUNK_QUERIES, MAX_BLOCKS = 1 << 15, 1 << 13, 1 << 18
_BLOCK = "block long, cell int, r_min double, r_max double, ids binary, r binary, vectors binary"


def clean(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, vector array<double>) written, and the number of dimensions. See top_k for what is left out."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<double>").alias("vector"))
    v = v.where("id is not null and vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    sizes = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return v, 0
    dim = sizes[0]["n"]
    return written(v.where(F.size("vector") == dim).groupBy("id").agg(F.min("vector").alias("vector")), "vectors"), dim


def choose_pivots(table: DataFrame, n: int, cell_rows: int, max_pivots: int) -> np.ndarray:
    count = max(1, min(max_pivots, -(-n // cell_rows)))
    rows = table.orderBy(F.xxhash64("id"), "id").limit(count * SAMPLE_PER_PIVOT).select("vector").collect()
    sample = np.array([r[0] for r in rows])
    pivots = sample[:count].copy()
    for _ in range(8):
        near = squares(sample, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            own = sample[near == p]
            if len(own):
                pivots[p] = own.mean(axis=0)
    return pivots


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, tau: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, neighbour number, distance) of up to k nearest x within tau of each query, ties by id; itself is no neighbour."""
    d2 = squares(q, x)
    d2[q_ids[:, None] == x_ids[None]] = np.inf
    limit = tau * tau
    if d2.shape[1] > k:
        limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
    limit = limit * (1 + SLACK) + SLACK
    i, j = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
    dist = np.empty(len(i))
    for lo in range(0, len(i), 1 << 17):
        hi = lo + (1 << 17)
        dist[lo:hi] = np.sqrt(((q[i[lo:hi]] - x[j[lo:hi]]) ** 2).sum(axis=1))
    return nearest(i, j, dist, x_ids, k)


def nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query number i among (i, neighbour number j, d), ties by id."""
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


def search(q: np.ndarray, q_ids: np.ndarray, to_pivot: np.ndarray, tau: np.ndarray, x: np.ndarray, x_ids: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """best() over a block sorted by r, by annuli: queries in order of their distance to the pivot, a step of rings at a time outwards. Last comes the number of distances worked out."""
    order = np.argsort(to_pivot, kind="stable")
    out, seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for s in range(0, len(order), 256):
        at = order[s : s + 256]
        t = tau[at].copy()
        near = to_pivot[at]
        found_d = np.full((len(at), 0), np.inf)
        left = right = int(np.searchsorted(r, np.median(near)))
        while True:
            # rings still open for some query of the group
            low = int(np.searchsorted(r, (near - t).min() * (1 - SLACK) - SLACK))
            high = int(np.searchsorted(r, (near + t).max() * (1 + SLACK) + SLACK, side="right"))
            a, b = max(low, left - 512), min(high, right + 512)
            spans = [(lo, hi) for lo, hi in ((min(a, left), left), (right, max(b, right))) if lo < hi]
            if not spans:
                break
            for lo, hi in spans:
                seen += len(at) * (hi - lo)
                i, j, d = best(q[at], q_ids[at], x[lo:hi], x_ids[lo:hi], t, k)
                out.append((at[i], j + lo, d))
                mine = np.full((len(at), k), np.inf)
                mine[i, np.arange(len(i)) - np.searchsorted(i, i)] = d
                found_d = np.sort(np.concatenate([found_d, mine], axis=1), axis=1)[:, :k]
            left, right = min(a, left), max(b, right)
            t = np.minimum(t, found_d[:, k - 1]) if found_d.shape[1] >= k else t
    return *nearest(*(np.concatenate(c) for c in zip(*out)), x_ids, k), seen


def _unpack(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["r"]), np.frombuffer(row["vectors"]).reshape(-1, dim)


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["vec_id", "neighbor_id", "distance"])


def candidates(vectors: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, group_rows: int = GROUP_ROWS, chunk_queries: int = CHUNK_QUERIES, count: bool = False) -> DataFrame | None:
    """vec_id, neighbor_id, distance: for each query the k nearest of every group it visits; None if there are no two vectors.

    With count, instead for each visit the number of its queries (vec_id), the rows of its group
    (neighbor_id) and the distances it worked out (distance).
    """
    spark = vectors.sparkSession
    table, dim = clean(vectors)
    n = table.count() if dim else 0
    if n < 2:
        return None
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    shared = spark.sparkContext.broadcast(choose_pivots(table, n, cell_rows, max_pivots))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cell = squares(x, pivots).argmin(axis=1)
            r = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(r), *b.columns], ["cell", "r", "id", "vector"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, made = TaskContext.get().partitionId() << 32, [], 0

        def emit(rows: tuple) -> pa.RecordBatch:
            nonlocal made
            cell, r, ids, x = rows
            made += 1
            return pa.RecordBatch.from_pylist([{"block": base + made, "cell": int(cell[0]), "r_min": float(r[0]), "r_max": float(r[-1]), "ids": ids.tobytes(), "r": r.tobytes(), "vectors": x.tobytes()}], schema=pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("r_min", pa.float64()), ("r_max", pa.float64()), ("ids", pa.binary()), ("r", pa.binary()), ("vectors", pa.binary())]))

        for b in batches:
            cell, r, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            new = (cell, r, ids, b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            held = [np.concatenate(p) for p in zip(held, new)] if held else list(new)
            at, size = 0, len(held[0])
            while at < size:
                end = min(at + block_rows, int(np.searchsorted(held[0], held[0][at], side="right")))
                if end == size and end - at < block_rows:
                    break  # the cell may go on in the next batch
                yield emit(tuple(p[at:end] for p in held))
                at = end
            held = [p[at:] for p in held]
        if held and len(held[0]):
            yield emit(tuple(held))

    keyed = table.mapInArrow(key, "cell int, r double, id long, vector array<double>")
    blocks = written(keyed.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id").mapInArrow(gather, _BLOCK), "blocks")
    rows = blocks.select("cell", "r_min", "block", "r_max", (F.length("ids") / 8).cast("long")).collect()  # one for each block: see MAX_BLOCKS
    cell, r_min, name, r_max, size = (np.array(c) for c in zip(*sorted(map(tuple, rows))))
    group = (np.cumsum(size) - size) // group_rows
    directory = spark.sparkContext.broadcast((cell, r_min, r_max, group))
    groups = spark.createDataFrame(list(zip(name.tolist(), group.tolist())), "block long, group long")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries with a first bound from their own block."""
        for b in batches:
            for row in b.to_pylist():
                ids, r, x = _unpack(row, dim)
                at = np.flatnonzero(ids % every == 0)
                tau = np.full(len(at), np.inf)
                for s in range(0, len(at) if len(x) > k else 0, 512):
                    d2 = squares(x[at[s : s + 512]], x)  # itself is among them, at 0
                    tau[s : s + 512] = np.sqrt(np.partition(d2, k, axis=1)[:, k] * (1 + SLACK) + SLACK)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(tau), pa.array([v.tobytes() for v in x[at]], pa.binary())], ["id", "tau", "vector"])

    seeds = written(blocks.mapInArrow(seed, "id long, tau double, vector binary"), "seeds")
    chunks = max(1, -(-seeds.count() // chunk_queries))

    def bounds(to: np.ndarray, own: np.ndarray, c: int, low: float, high: float) -> np.ndarray:
        return np.maximum(np.maximum(to - high, low - to), (to - own) / 2)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, (cell, r_min, r_max, group) = shared.value, directory.value
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                q = np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(-1, dim)
                tau = part.column(1).to_numpy(zero_copy_only=False)
                to = np.sqrt(squares(q, pivots))
                own = to.min(axis=1)
                at = 0
                while at < len(group):
                    end = int(np.searchsorted(group, group[at], side="right"))
                    need = np.zeros(len(q), dtype=bool)
                    for c, low, high in zip(cell[at:end].tolist(), r_min[at:end].tolist(), r_max[at:end].tolist()):
                        need |= bounds(to[:, c], own, c, low, high) <= tau + 1e-7
                    if need.any():
                        keep = pa.array(need)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(need.sum()), group[at])), *(x.filter(keep) for x in part.columns)], ["group", "id", "tau", "vector"])
                    at = end

    def visit(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not queries.num_rows or not held.num_rows:
            return _edges(*[np.zeros(0)] * 3)
        pivots = shared.value
        q_ids, kth = queries.column("id").to_numpy(), queries.column("tau").to_numpy().copy()
        q = np.frombuffer(b"".join(queries.column("vector").to_pylist())).reshape(-1, dim)
        to = np.sqrt(squares(q, pivots))
        own, seen, n_rows = to.min(axis=1), 0, 0
        all_i, all_id, all_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for row in held.sort_by([("cell", "ascending"), ("r_min", "ascending")]).to_batches(max_chunksize=1):
            row = row.to_pylist()[0]
            ids, r, x = _unpack(row, dim)
            n_rows += len(ids)
            go = np.flatnonzero(bounds(to[:, row["cell"]], own, row["cell"], row["r_min"], row["r_max"]) <= kth + 1e-7)
            if not len(go):
                continue
            i, j, d, n = search(q[go], q_ids[go], to[go, row["cell"]], kth[go], x, ids, r, k)
            seen += n
            all_i, all_id, all_d = np.concatenate([all_i, go[i]]), np.concatenate([all_id, ids[j]]), np.concatenate([all_d, d])
            all_i, at, all_d = nearest(all_i, np.arange(len(all_i)), all_d, all_id, k)
            all_id = all_id[at]
            last = np.flatnonzero(np.arange(len(all_i)) - np.searchsorted(all_i, all_i) == k - 1)
            kth[all_i[last]] = np.minimum(kth[all_i[last]], all_d[last])
        if count:
            return _edges(np.array([len(q)]), np.array([n_rows]), np.array([float(seen)]))
        return _edges(q_ids[all_i], all_id, all_d)

    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")
    routed = seeds.mapInArrow(route, "group long, id long, tau double, vector binary").select("group", chunk, "id", "tau", "vector")
    spread = blocks.join(F.broadcast(groups), "block").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "cell", "r_min", "r_max", "ids", "r", "vectors")
    return routed.groupBy("group", "chunk").cogroup(spread.groupBy("group", "chunk")).applyInArrow(visit, "vec_id long, neighbor_id long, distance double")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, **options: int) -> DataFrame:
    """vec_id, rank, neighbor_id, distance: the k nearest others, by Euclidean distance, ties by neighbor_id, of every vector whose id is divisible by every.

    Rows with a null id, a null or empty vector, or a null, NaN or infinite element are left out, as
    are vectors of another length than the most frequent (the shorter of two as frequent). Of rows
    that repeat an id the one with the least vector counts. With fewer than k others, all are given;
    an empty table, or a single vector, gives an empty table.
    """
    found = candidates(vectors, k, every, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", F.round("distance", 6).alias("distance"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = K, every: int = EVERY) -> str:
    return f"""
with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null),
pairs as (select a.vec_id, b.vec_id neighbor_id, list_distance(a.e, b.e) d from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
ranked as (select *, row_number() over (partition by vec_id order by round(d, 12), neighbor_id)::int rank from pairs)
select vec_id, rank, neighbor_id, round(d, 6) distance from ranked where rank <= {k}"""
