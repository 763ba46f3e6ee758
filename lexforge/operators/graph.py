"""Task graphs: (graph, id, depends_on array<string>, status)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(tasks: DataFrame) -> DataFrame:
    return tasks.select("graph", "id", F.explode("depends_on").alias("needs"))


def missing(tasks: DataFrame) -> DataFrame:
    """(graph, id, needs) of dependencies that are no task of the graph."""
    known = tasks.select("graph", F.col("id").alias("needs"))
    return edges(tasks).join(known, ["graph", "needs"], "left_anti").select("graph", "id", "needs")


def levels(tasks: DataFrame) -> DataFrame:
    """(graph, id, level): tasks without known dependencies at 0, others one above their highest; tasks of or behind a cycle have null."""
    return order(tasks).select("graph", "id", "level")


def order(tasks: DataFrame) -> DataFrame:
    """(graph, id, place, level, in_cycle): first-in first-out topological order, roots by id; tasks of or behind a cycle have no place. A graph is small: one row of its tasks, many rows a batch."""

    def place_all(graph: int, ids: list[str], depends: list[list[str]]) -> list[tuple]:
        needs = {k: list(dict.fromkeys(d)) for k, d in zip(ids, depends)}
        left = {k: sum(d in needs for d in v) for k, v in needs.items()}
        after: dict[str, list[str]] = {k: [] for k in needs}
        for k in needs:
            for d in needs[k]:
                if d in after:
                    after[d].append(k)
        ready, place, level = deque(sorted(k for k, n in left.items() if n == 0)), {}, {}
        while ready:
            k = ready.popleft()
            place[k], level[k] = len(place), max((level[d] + 1 for d in needs[k] if d in level), default=0)
            for x in after[k]:
                left[x] -= 1
                if left[x] == 0:
                    ready.append(x)
        return [(graph, k, place.get(k), level.get(k), k not in place) for k in needs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [x for g, r in zip(f["graph"], f["r"]) for x in place_all(g, [t["id"] for t in r], [[] if t["depends_on"] is None else list(t["depends_on"]) for t in r])]
            yield pd.DataFrame(out, columns=["graph", "id", "place", "level", "in_cycle"]).astype({"place": "Int32", "level": "Int32"})

    grouped = tasks.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("id", "depends_on"))).alias("r"))
    return grouped.mapInPandas(run, "graph long, id string, place int, level int, in_cycle boolean")


def ready(tasks: DataFrame) -> DataFrame:
    """Tasks with is_ready: pending, and no dependency that is not completed."""
    done = tasks.where("status = 'completed'").select("graph", F.col("id").alias("needs"))
    waits = edges(tasks).join(done, ["graph", "needs"], "left_anti").select("graph", "id").distinct().withColumn("__waits", F.lit(True))
    joined = tasks.join(waits, ["graph", "id"], "left")
    return joined.select(*tasks.columns, ((F.col("status") == "pending") & F.col("__waits").isNull()).alias("is_ready"))


def next_task(ordered: DataFrame) -> DataFrame:
    """(graph, id) of the first ready task by place."""
    first = F.row_number().over(Window.partitionBy("graph").orderBy("place", "id"))
    return ordered.where("is_ready").withColumn("__n", first).where("__n = 1").select("graph", "id")


def progress(tasks: DataFrame) -> DataFrame:
    """Counts by status, whether all are done (true for none) and whether any failed."""
    names = ("pending", "in_progress", "completed", "failed")
    return tasks.groupBy("graph").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names],
        F.coalesce(F.bool_and(F.col("status") == "completed"), F.lit(True)).alias("is_done"),
        F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("has_failures"),
    )
