"""Retrieval quality, token efficiency and judge scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx


def ir_metrics(results: DataFrame, k: int | None = None) -> DataFrame:
    """precision, recall, mrr and ndcg at k of (query_id, retrieved, relevant), both arrays of ids, and how many ids of each there are and both have.

    A retrieved id is a hit if it contains a relevant id; duplicates count again, so recall and ndcg
    may pass 1. Recall divides by the relevant ids as listed, the ideal ranking has as many hits as there are different relevant ids, and
    no more than were retrieved. Without relevant ids, or retrieved ones, all are 0.
    """
    top = F.col("retrieved") if k is None else F.slice("retrieved", 1, k)
    hit = F.transform(top, lambda r: F.exists("relevant", lambda x: F.contains(r, x)))
    d = results.withColumn("__hit", hit).withColumn("__n", F.size("relevant")).withColumn("__ideal", F.least(F.size(F.array_distinct("relevant")), F.size(top)))
    hits = F.size(F.filter("__hit", lambda h: h))
    gains = F.transform("__hit", lambda h, i: F.when(h, 1 / F.log2(i + 2)).otherwise(0.0))
    ideal = F.transform(F.when(F.col("__ideal") > 0, F.sequence(F.lit(1), F.col("__ideal"))).otherwise(F.array().cast("array<int>")), lambda i: 1 / F.log2(i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    first = F.array_position("__hit", True)
    some = (F.col("__n") > 0) & (F.size(top) > 0)
    value = lambda c: F.when(some, c).otherwise(F.lit(0.0))
    return d.select(
        "query_id",
        value(hits / F.size(top)).alias("precision"),
        value(hits / F.col("__n")).alias("recall"),
        value(F.when(first > 0, 1 / first).otherwise(F.lit(0.0))).alias("mrr"),
        value(F.coalesce(F.try_divide(total(gains), total(ideal)), F.lit(0.0))).alias("ndcg"),
        F.size(top).alias("n_retrieved"),
        F.col("__n").alias("n_relevant"),
        F.size(F.array_intersect(top, "relevant")).alias("n_relevant_retrieved"),
    )


def performance(results: DataFrame) -> DataFrame:
    """context_tokens (characters of all chunks, divided by 4) and e_tok of (query_id, contents, score, cache_hit); no score counts as 0."""
    size = F.aggregate(F.col("contents"), F.lit(0).cast("long"), lambda s, c: s + F.length(c))
    tokens = F.floor(size / 4).cast("long")
    return results.select("query_id", tokens.alias("context_tokens"), vx.token_cost(tokens, F.coalesce("score", F.lit(0.0))).alias("e_tok"), "cache_hit")


def aggregate(runs: DataFrame) -> DataFrame:
    """Means by run over all its queries; precision and recall of the judge sum what is there but divide by all; its cache rate is over judged queries."""
    n = F.count("*")
    mean = lambda c: (F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / n)
    return runs.groupBy("run").agg(
        n.alias("n_queries"),
        mean("latency_ms").alias("mean_latency_ms"),
        mean("context_tokens").alias("mean_context_tokens"),
        mean("score").alias("mean_score"),
        mean("context_precision").alias("mean_precision"),
        mean("context_recall").alias("mean_recall"),
        mean("e_tok").alias("mean_e_tok"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"),
        F.coalesce(F.avg(F.when(F.col("score").isNotNull(), F.col("from_cache").cast("double"))), F.lit(0.0)).alias("judge_cache_rate"),
    )


BEST = {"mean_e_tok": "min", "mean_latency_ms": "min", "mean_context_tokens": "min", "mean_score": "max", "mean_precision": "max", "mean_recall": "max"}


def compare(summary: DataFrame, digits: int = 6) -> DataFrame:
    """The runs with, for each measure, whether it is the best of all. Means that agree to so many digits after the point are equally good, as the last bits of a sum depend on the order of its rows."""
    everything = summary.agg(*[(F.min if how == "min" else F.max)(F.round(c, digits)).alias(f"__{c}") for c, how in BEST.items()])
    joined = summary.crossJoin(F.broadcast(everything))
    return joined.select(*summary.columns, *[(F.round(c, digits) == F.col(f"__{c}")).alias(f"best_{c}") for c in BEST])


def judged(results: DataFrame, cache: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Judge scores of (query_id, query, contexts) from a cache of (hash, faithfulness, answer_relevancy, context_precision, context_recall).

    What the cache lacks goes to scorer, a Column function of query and context that gives the four
    scores as a struct; without one the scores stay null. from_cache says which it was.
    """
    names = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    keyed = results.withColumn("hash", tx.context_hash(F.col("query"), F.col("contexts")))
    joined = keyed.join(cache.select("hash", *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__there")), "hash", "left")
    context = F.substring(F.array_join("contexts", "\n\n"), 1, 2000)
    made = scorer(F.col("query"), context) if scorer else None
    columns = [F.coalesce(F.col(f"__{c}"), made[c]).alias(c) if made is not None else F.col(f"__{c}").alias(c) for c in names]
    return joined.select("query_id", "hash", *columns, F.coalesce("__there", F.lit(False)).alias("from_cache"))


def overlap_scorer(query: Column, context: Column) -> Column:
    """A stand-in judge: shares of shared words."""
    q, c = (F.array_distinct(tx.tokens(F.lower(x))) for x in (query, context))
    both = F.size(F.array_intersect(q, c))
    part = lambda n: F.coalesce(F.try_divide(both, F.size(n)), F.lit(0.0))
    return F.struct(part(c).alias("faithfulness"), part(q).alias("answer_relevancy"), part(c).alias("context_precision"), part(q).alias("context_recall"))


def metrics_rows(results: DataFrame, with_judge: bool = True) -> DataFrame:
    """The columns of a metrics.csv: one row a query, rounded."""
    base = ["query_id", "query", F.round("latency_ms", 2).alias("latency_ms"), "context_tokens", "cache_hit"]
    judge = [F.round("score", 4).alias("ragas_score"), F.round("e_tok", 1).alias("e_tok"), F.round("faithfulness", 4).alias("ragas_faithfulness"), F.round("answer_relevancy", 4).alias("ragas_answer_relevancy"), F.col("from_cache").alias("ragas_from_cache")]
    return results.select(*base, *(judge if with_judge else []))


def summary_json(summary: DataFrame) -> DataFrame:
    """A run summary as one JSON text by run."""
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes]
    return summary.select("run", F.to_json(F.struct(*rounded)).alias("json"))


def comparison_markdown(compared: DataFrame) -> str:
    """A comparison table with the best of each measure in bold; a report of one row a run, so it is made on the driver."""
    rows = compared.orderBy("run").collect()
    lines = ["| run | " + " | ".join(c.removeprefix("mean_") for c in BEST) + " |", "|---" * (len(BEST) + 1) + "|"]
    for r in rows:
        cells = [f"**{r[c]:.4g}**" if r[f"best_{c}"] else f"{r[c]:.4g}" for c in BEST]
        lines.append(f"| {r['run']} | " + " | ".join(cells) + " |")
    return "\n".join(lines)


def access_history(accesses: DataFrame, every: int = 10) -> DataFrame:
    """Running cache figures of (session, seq, hit, depth), seq from 1, sampled every so many accesses."""
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hits, n, depth = F.sum(F.col("hit").cast("int")).over(order), F.count("*").over(order), F.sum("depth").over(order)
    out = accesses.select("session", "seq", F.round(hits / n, 4).alias("hit_rate"), F.round(depth / n, 2).alias("avg_depth"))
    return out.where(F.col("seq") % every == 0)


def run_markdown(run: str, settings: dict[str, object], summary: dict[str, float], rows: list[dict[str, object]], errors: list[str] = []) -> str:
    """The report of one run: its settings, its means, a row a query and its errors. A report for reading, so made on the driver."""
    lines = [f"# Run {run}", "", "| setting | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in settings.items())]
    lines += ["", "| measure | value |", "|---|---|", *(f"| {k} | {v:.4g} |" for k, v in summary.items()), ""]
    names = list(rows[0]) if rows else []
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v) if len(str(v)) <= 50 else str(v)[:50] + "..."
    if rows:
        lines += ["| " + " | ".join(names) + " |", "|---" * len(names) + "|", *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]
    if errors:
        lines += ["", f"Errors: {len(errors)}", *(f"- {e}" for e in errors)]
    return "\n".join(lines) + "\n"
