"""The store's tables made from the driver's, in Spark and, by the same rules, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import chunking

NOW = "2026-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, title, tags, priority, content: every document is a note."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Título "), F.col("doc_id").cast("string")).alias("title"), F.array("lang", "source").alias("tags"), (1 + F.col("doc_id") % 10).cast("int").alias("priority"), F.col("text").alias("content"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's older state: nine of ten notes, every seventh with other content."""
    n = notes(spark, sf_dir).where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    return n.select("id", "title", "tags", "priority", "content", tx.content_hash(F.col("content")).alias("content_hash"), F.lit("2025-01-01 00:00:00").alias("created_at"), F.lit("2025-06-01 00:00:00").alias("updated_at"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).where("doc_id % 10 <> 1").select("id", "title", "tags", "priority", "content")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a chunk, of two strategies in turn."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("order", "content"))
    note = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat(note, F.lit("::"), F.col("order").cast("string")).alias("id"), note.alias("note_id"), F.concat(F.lit("part "), F.col("order").cast("string")).alias("title"), "content", F.when(F.col("order") % 2 == 0, "naive").otherwise("structural").alias("strategy"), "order")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, vector: two of three chunks have the embedding their number points to."""
    v = read(spark, sf_dir, "embeddings")
    n = v.count()
    c = chunks(spark, sf_dir).where("order % 3 <> 0").select(F.col("id").alias("chunk_id"), ((F.col("doc_id") * 31 + F.col("order")) % n).alias("vec_id"))
    return c.join(v.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("chunk_id", "vector")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document points to the first line of the next, and of every fifth to itself."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    at = lambda c: F.concat(F.lit("doc_"), c.cast("string"), F.lit("::0"))
    near = d.select(at(F.col("doc_id")).alias("src"), at(F.col("doc_id") + 1).alias("tgt"), ((F.col("doc_id") % 100) / 100.0).alias("similarity"), F.lit("autocorrelation").alias("link_type"))
    return near.union(d.where("doc_id % 5 = 0").select(at(F.col("doc_id")), at(F.col("doc_id")), F.lit(1.0), F.lit("self")))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Markdown structure put in by line number."""

    def line(x: Column, i: Column) -> Column:
        return (
            F.when(i % 11 == 10, F.lit("---")).when(i % 13 == 6, F.lit("```py")).when(i % 13 == 8, F.lit("```"))
            .when(i % 7 == 0, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("### "), x)).when(i % 4 == 2, F.concat(x, F.lit("\n"))).otherwise(x)
        )

    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("note_id"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("content"))


def units(spark: SparkSession, sf_dir: str, cut=None) -> DataFrame:
    """note_id, pos, unit, vector: sentences with the embedding their number points to."""
    v = read(spark, sf_dir, "embeddings")
    n = v.count()
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode((cut or chunking.sentences)(F.col("text"))).alias("pos", "unit"))
    keyed = d.withColumn("vec_id", (F.col("doc_id") * 31 + F.col("pos")) % n)
    return keyed.join(v.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("note_id"), "pos", "unit", "vector")


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, raw: documents as note files with front matter in three styles."""
    k = F.col("doc_id")
    s = k.cast("string")
    inline = F.concat(F.lit("---\nid: note "), s, F.lit("\ntags: ["), F.upper("lang"), F.lit(", "), F.col("source"), F.lit(", ]\npriority: "), (k % 15 - 2).cast("string"), F.lit("\n---\n# Title "), s, F.lit("\n"), F.col("text"))
    comma = F.concat(F.lit("---\ntags: "), F.upper("lang"), F.lit(" , "), F.col("source"), F.lit("\npriority: high\n---\n"), F.col("text"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("file_"), s).alias("stem"), F.when(k % 3 == 0, inline).when(k % 3 == 1, comma).otherwise(F.col("text")).alias("raw"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of a customer's orders: an order needs the two its place halves to; some have an unknown or a circular need."""
    o = read(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    d = o.withColumn("n", n).select(F.col("o_custkey").alias("graph"), "n", "o_orderkey", "o_orderstatus")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    half = F.floor(F.col("n") / 2)
    needs = F.when(F.col("n") == 1, F.array().cast("array<string>")).when((F.col("n") == 4) & (F.col("graph") % 10 == 3), F.array(F.lit("lost"), name(half))).when((F.col("n") == 2) & (F.col("graph") % 10 == 4), F.array(F.lit("t5"), name(half))).otherwise(F.array_distinct(F.array(name(half), name(F.greatest(half - 1, F.lit(1))))))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("pending")
    return d.select("graph", name(F.col("n")).alias("id"), needs.alias("depends_on"), status.alias("status"))


CTE = {
    "notes": """select doc_id, 'doc_' || doc_id id, 'Título ' || doc_id title, [lang, source] tags, (1 + doc_id % 10)::int priority, text content from documents""",
    "stored": """select id, title, tags, priority, content, sha256(content) content_hash, '2025-01-01 00:00:00' created_at, '2025-06-01 00:00:00' updated_at
        from (select * replace (case when doc_id % 7 = 0 then content || ' old' else content end as content) from notes where doc_id % 10 <> 0)""",
    "seen": """select id, title, tags, priority, content from notes where doc_id % 10 <> 1""",
    "chunks": """select doc_id, 'doc_' || doc_id || '::' || pos id, 'doc_' || doc_id note_id, 'part ' || pos title, content, case when pos % 2 = 0 then 'naive' else 'structural' end strategy, pos
        from (select doc_id, unnest(range(len(l)))::int pos, unnest(l) content from (select doc_id, string_split(text, chr(10)) l from documents))""",
    "nvec": """select count(*) n from embeddings""",
    "vectors": """select id chunk_id, embedding vector from chunks, nvec join embeddings on vec_id = (doc_id * 31 + pos) % n where pos % 3 <> 0""",
    "links": """select 'doc_' || doc_id || '::0' src, 'doc_' || (doc_id + 1) || '::0' tgt, (doc_id % 100) / 100.0::double similarity, 'autocorrelation' link_type from documents
        union all select 'doc_' || doc_id || '::0', 'doc_' || doc_id || '::0', 1.0::double, 'self' from documents where doc_id % 5 = 0""",
    "md": """select 'doc_' || doc_id note_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: case
        when (j - 1) % 11 = 10 then '---' when (j - 1) % 13 = 6 then '```py' when (j - 1) % 13 = 8 then '```' when (j - 1) % 7 = 0 then '## ' || x
        when (j - 1) % 7 = 3 then '### ' || x when (j - 1) % 4 = 2 then x || chr(10) else x end), chr(10)) content from documents""",
    "sent": r"""select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda u: regexp_replace(u, '^\s+|\s+$', '', 'g')), lambda u: u <> '') u from documents""",
    "units": """select 'doc_' || doc_id note_id, pos, unit, embedding::double[] vector from (select doc_id, unnest(range(len(u)))::int pos, unnest(u) unit from sent), nvec join embeddings on vec_id = (doc_id * 31 + pos) % n""",
    "raw": """select 'file_' || doc_id stem, doc_id, case doc_id % 3 when 0 then '---' || chr(10) || 'id: note ' || doc_id || chr(10) || 'tags: [' || upper(lang) || ', ' || source || ', ]' || chr(10) || 'priority: ' || (doc_id % 15 - 2) || chr(10) || '---' || chr(10) || '# Title ' || doc_id || chr(10) || text
        when 1 then '---' || chr(10) || 'tags: ' || upper(lang) || ' , ' || source || chr(10) || 'priority: high' || chr(10) || '---' || chr(10) || text else text end raw from documents""",
    "tasks": """select graph, 't' || n id, case when n = 1 then []::varchar[] when n = 4 and graph % 10 = 3 then ['lost', 't' || n // 2] when n = 2 and graph % 10 = 4 then ['t5', 't' || n // 2]
        when n // 2 = greatest(n // 2 - 1, 1) then ['t' || n // 2] else ['t' || n // 2, 't' || greatest(n // 2 - 1, 1)] end depends_on,
        case when o_orderstatus = 'F' then 'completed' when o_orderkey % 11 = 0 then 'failed' else 'pending' end status
        from (select o_custkey graph, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) n from orders)""",
}


def sql(body: str, *more: str) -> str:
    """body under the tables above, and further 'name as (...)' parts."""
    parts = [f"{k} as ({v})" for k, v in CTE.items()] + list(more)
    return "with recursive " + ",\n".join(parts) + "\n" + body
