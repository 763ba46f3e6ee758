"""Operator 2, quality rules: cross-document line frequency per host.

Lines are normalised (lower case, runs of blanks to one, trimmed) and hashed. A line is
boilerplate on its host when more distinct documents of the host hold it than
max(min_docs, ratio * documents of the host). Documents are distinct when their texts are, so a
document and its exact copies count once and copying alone never condemns a line. Boilerplate lines are removed; a document that
lost lines and is left with under min_keep of its characters is depleted and rejected.

The limit is relative, so a host has at most (mean lines of a document) / ratio boilerplate
lines however large it is, and the table of them is small beside the corpus; its bytes are
counted before it is broadcast. The count shuffles (host, hash, text hash) triples, never text.
Beyond broadcast_bytes the lines meet the table by (host, hash), and only the positions of boilerplate
lines go back to the texts, by the hash of the text, so no join is keyed by the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import BROADCAST_BYTES, documents, table_bytes, written

MIN_DOCS, RATIO, MIN_KEEP = 10, 0.01, 0.3


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[ \t\r\f]+", " "))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("doc"), "text").where("text is not null")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, ratio: float = RATIO) -> DataFrame:
    """(host, line_hash, n_docs) of the boilerplate lines. Blank lines never count; a null source is the host ''."""
    d = _keyed(docs)
    hosts = d.groupBy("host").agg(F.countDistinct("doc").alias("host_docs"))
    hashes = F.transform(F.filter(F.transform(_lines(F.col("text")), normal_line), lambda x: x != ""), lambda x: F.xxhash64(x))
    lines = d.select("host", "doc", F.explode(F.array_distinct(hashes)).alias("line_hash"))
    counts = lines.groupBy("host", "line_hash").agg(F.countDistinct("doc").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counts.join(hosts, "host").where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), F.col("host_docs") * ratio)).select("host", "line_hash", "n_docs")


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, ratio: float = RATIO, min_keep: float = MIN_KEEP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without boilerplate lines and without depleted documents, plus removed_lines.

    docs needs doc_id, text and source; other columns pass through, n_chars (if there) is
    recomputed for changed texts, and a column removed_lines of docs is replaced. Null and empty
    texts have no lines: they are kept as they are.
    A null or repeated doc_id makes no difference: each row is cleaned and judged by itself. An
    empty table gives an empty table.
    """
    docs = docs.drop("removed_lines")
    flagged = written(frequent_lines(docs, min_docs, ratio).groupBy("host").agg(F.collect_list("line_hash").alias("__lx_flagged")).withColumnRenamed("host", "__lx_host"), "lines")
    host, text, lines = F.coalesce(docs["source"], F.lit("")), docs["text"], _lines(docs["text"])
    if table_bytes(flagged) <= broadcast_bytes:
        joined = docs.join(F.broadcast(flagged), host == F.col("__lx_host"), "left")
        kept = F.filter(lines, lambda x: ~F.array_contains("__lx_flagged", F.xxhash64(normal_line(x))))
        touched = F.col("__lx_flagged").isNotNull() & text.isNotNull()
    else:
        each = flagged.select(F.col("__lx_host").alias("host"), F.explode("__lx_flagged").alias("line_hash"))
        at = _keyed(docs).dropDuplicates(["host", "doc"]).select("host", "doc", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(normal_line(x)))).alias("at", "line_hash"))
        gone = at.join(each, ["host", "line_hash"]).groupBy("host", "doc").agg(F.collect_list("at").alias("__lx_gone"))
        gone = gone.select(F.col("host").alias("__lx_host"), F.col("doc").alias("__lx_doc"), "__lx_gone")
        joined = docs.join(gone, (F.xxhash64(text) == F.col("__lx_doc")) & (host == F.col("__lx_host")), "left")
        kept = F.filter(lines, lambda x, i: ~F.array_contains("__lx_gone", i))
        touched = F.col("__lx_gone").isNotNull() & text.isNotNull()
    # explode() of one element: what it makes is computed once, however often it is used behind it
    once = F.explode(F.array(F.when(touched, F.struct(kept.alias("kept"), F.size(lines).alias("n"))))).alias("__lx")
    out = joined.select(*[docs[c] for c in docs.columns], once)
    removed = F.coalesce(F.col("__lx.n") - F.size("__lx.kept"), F.lit(0))
    joint = F.explode(F.array(F.when(removed > 0, F.array_join("__lx.kept", "\n")))).alias("__lx_text")
    out = out.select(*[docs[c] for c in docs.columns], removed.alias("removed_lines"), joint)
    new = F.col("__lx_text")
    out = out.where(new.isNull() | ((F.length(F.trim(new)) > 0) & (F.length(new) >= min_keep * F.length(docs["text"]))))
    made = {"text": F.coalesce(new, docs["text"]), "n_chars": F.when(new.isNotNull(), F.length(new).cast("long")).otherwise(docs["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[made[c].alias(c) if c in made else docs[c] for c in docs.columns], "removed_lines")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_frequent_lines(documents(spark, sf_dir))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\r\\f]+', ' ', 'g'), ' ')"


def sql(table: str = "documents", min_docs: int = MIN_DOCS, ratio: float = RATIO, min_keep: float = MIN_KEEP, columns: str = "doc_id, text, lang, source, n_chars, removed_lines") -> str:
    return f"""
with hosts as (select coalesce(source, '') host, count(distinct text) host_docs from {table} group by 1),
lines as (select coalesce(source, '') host, text, unnest(string_split(text, chr(10))) line from {table}),
counts as (select host, {_norm("line")} norm, count(distinct text) n_docs from lines group by 1, 2),
flagged as (select host, list(norm) norms from counts join hosts using (host)
            where norm <> '' and n_docs > greatest({min_docs}, host_docs * {ratio}) group by 1),
parts as (select d.*, string_split(text, chr(10)) lines,
                 case when norms is null then string_split(text, chr(10))
                      else list_filter(string_split(text, chr(10)), lambda x: not list_contains(norms, {_norm("x")})) end kept
          from {table} d left join flagged f on coalesce(d.source, '') = f.host),
done as (select * exclude (text, n_chars, lines, kept), text old, n_chars old_chars, coalesce(len(lines) - len(kept), 0)::int removed_lines,
                case when len(lines) > len(kept) then array_to_string(kept, chr(10)) else text end as text from parts),
sized as (select *, case when removed_lines > 0 then length(text) else old_chars end n_chars from done)
select {columns} from sized
where removed_lines = 0 or (length(trim(text, ' ')) > 0 and length(text) >= {min_keep} * length(old))"""
