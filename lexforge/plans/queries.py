"""One query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx
from lexforge.operators import cache, chunking, evaluation, graph, index, retrieval, store
from lexforge.plans import experiment, registry
from lexforge.plans import fixtures as fx
from lexforge.sources import notes as src
from lexforge.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K, THRESHOLD, MAX_TOKENS = 5, 0.3, 60


def query(sql: str | None = None, *more: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = fx.sql(sql, *more)
        return f

    return put


def _v(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "embeddings")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """One query vector for each benchmark item."""
    items = fx.read(spark, d, "benchmark").select("item_id")
    return items.join(_v(spark, d).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id").withColumnRenamed("item_id", "query_id")


_SCORES = "scores as (select item_id query_id, v.vec_id chunk_id, list_inner_product(q.embedding::double[], v.embedding::double[]) score from benchmark join embeddings q on q.vec_id = item_id cross join embeddings v)"


# vectors


@query("select query_id, chunk_id, rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from scores where score >= 0) where rank <= 5", _SCORES)
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    found = retrieval.scores(q, _v(spark, d).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), k=K)
    return retrieval.top_k(found, K).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("select query_id, chunk_id, round(score, 6) score from scores where score >= 0.3", _SCORES)
def vec_threshold(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    found = retrieval.scores(q, _v(spark, d).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), THRESHOLD)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# sources and sinks

_PARSE = r"""parsed as (select stem, case when raw like '---%' then regexp_extract(raw, '(?s)^---\n(.*?)\n---\n', 1) else '' end f, regexp_replace(case when raw like '---%' then regexp_replace(raw, '(?s)^---\n.*?\n---\n', '') else raw end, '^\s+|\s+$', '', 'g') body from raw),
fields as (select *, coalesce(nullif(trim(regexp_extract(f, 'id: ([^\n]*)', 1)), ''), stem) id, trim(regexp_extract(f, 'tags: ([^\n]*)', 1)) t, try_cast(regexp_extract(f, 'priority: ([^\n]*)', 1) as int) p from parsed),
lists as (select *, list_filter(list_transform(string_split(replace(replace(t, '[', ''), ']', ''), ','), lambda x: lower(trim(x))), lambda x: x <> '') tl from fields)"""


@query(r"select id, coalesce(nullif(trim(regexp_extract(body, '(?m)^[ \t]*#[ \t]+([^\n]+)$', 1)), ''), id) title, tl tags, least(10, greatest(1, coalesce(p, 5)))::int priority, body content from lists", _PARSE)
def notes_parse(spark: SparkSession, d: str) -> DataFrame:
    return src.parse_notes(fx.raw_notes(spark, d))


@query(r"select id, coalesce(nullif(trim(regexp_extract(body, '(?m)^[ \t]*#[ \t]+([^\n]+)$', 1)), ''), id) title, case when t like '[%' then tl else []::varchar[] end tags, coalesce(p, 5)::int priority, body content from lists", _PARSE)
def notes_parse_loose(spark: SparkSession, d: str) -> DataFrame:
    return src.parse_notes(fx.raw_notes(spark, d), strict=False)


@query("select part_name, s_name, rank from (select p_type part_name, p_name s_name, p_size rank, row_number() over (partition by p_type order by p_size desc, p_partkey desc) n from part) where n = 1")
def skills_override(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part").withColumn("path_rank", F.struct("p_size", "p_partkey"))
    return src.override(p, "p_type").select(F.col("p_type").alias("part_name"), F.col("p_name").alias("s_name"), F.col("p_size").alias("rank"))


@query("select id, replace(id, '::', '--') || '.md' file_name from chunks")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).select("id", sinks.safe_filename(F.col("id")).alias("file_name"))


@query("select 'doc_' || doc_id id, 'Título ' || doc_id title, text content, ['plan'] tags, 5 priority from documents")
def plan_notes(spark: SparkSession, d: str) -> DataFrame:
    return sinks.plan_notes(fx.notes(spark, d).select("id", "title", F.col("content").alias("body")), "plan")


# the store


@query(f"select s.id, s.title, s.priority, s.content, sha256(s.content) content_hash, coalesce(o.created_at, '{fx.NOW}') created_at, '{fx.NOW}' updated_at from seen s left join stored o using (id) union all select id, title, priority, content, content_hash, created_at, updated_at from stored where id not in (select id from seen)")
def upsert_notes(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_notes(fx.stored(spark, d), fx.seen(spark, d), F.lit(fx.NOW)).drop("tags")


@query("select id, note_id, content, strategy, pos, sha256(content) content_hash, (length(content) // 4)::int token_estimate from (select id, note_id, case when pos % 4 = 1 then content || '!' else content end content, strategy, pos from chunks)")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = store.with_chunk_facts(fx.chunks(spark, d)).drop("doc_id", "title")
    new = store.with_chunk_facts(c.where("order % 4 = 1").withColumn("content", F.concat("content", F.lit("!"))))
    return store.upsert(c, new, ["id"]).withColumnRenamed("order", "pos")


@query("select chunk_id, len(vector)::int dim, round(list_sum(vector::double[]), 4) total from vectors")
def upsert_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = store.with_dim(fx.chunk_vectors(spark, d))
    out = store.upsert(v, v.where(F.col("chunk_id").endswith("1")), ["chunk_id"])
    return out.select("chunk_id", "dim", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("select src, tgt, similarity, link_type from (select *, row_number() over (partition by src, tgt order by seq desc) n from (select *, 1 seq from links union all select src, tgt, similarity / 2, 'again', 2 from links where similarity > 0.5 and link_type <> 'self')) where n = 1")
def upsert_links(spark: SparkSession, d: str) -> DataFrame:
    old = fx.links(spark, d)
    batch = old.where("similarity > 0.5 and link_type <> 'self'").select("src", "tgt", (F.col("similarity") / 2).alias("similarity"), F.lit("again").alias("link_type"))
    twice = batch.withColumn("seq", F.lit(1)).withColumn("similarity", F.lit(0.0)).union(batch.withColumn("seq", F.lit(2)))
    return store.upsert(old, store.latest(twice, ["src", "tgt"], "seq").drop("seq"), ["src", "tgt"])


@query("select id, content_hash from stored where id = 'doc_3'")
def note_lookup(spark: SparkSession, d: str) -> DataFrame:
    return fx.stored(spark, d).where(F.col("id") == "doc_3").select("id", "content_hash")


@query("select id, updated_at from stored")
def notes_listed(spark: SparkSession, d: str) -> DataFrame:
    return fx.stored(spark, d).orderBy(F.desc("updated_at"), "id").select("id", "updated_at")


@query("select note_id, pos, id from chunks where strategy = 'naive'")
def chunks_listed(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).where("strategy = 'naive'").orderBy("note_id", "order").select("note_id", F.col("order").alias("pos"), "id")


_STATUS = "status as (select coalesce(s.id, o.id) id, case when s.id is null then 'stale' when o.id is null then 'new' when o.content_hash <> sha256(s.content) then 'modified' else 'unchanged' end status from seen s full join stored o on s.id = o.id)"


@query("select s.id, (o.id is null or o.content_hash <> sha256(s.content) or h.note_id is null) needs_update from seen s left join stored o using (id) left join (select distinct note_id from chunks where strategy = 'structural') h on h.note_id = s.id")
def needs_update(spark: SparkSession, d: str) -> DataFrame:
    return store.needs_update(fx.seen(spark, d), fx.stored(spark, d), fx.chunks(spark, d), "structural").select("id", "needs_update")


@query("select id from chunks where id in (select chunk_id from vectors)")
def has_embedding(spark: SparkSession, d: str) -> DataFrame:
    return store.chunks_with_embeddings(fx.chunks(spark, d), fx.chunk_vectors(spark, d)).select("id")


@query("select id, other, similarity, link_type from (select src id, tgt other, similarity, link_type from links union all select tgt, src, similarity, link_type from links where src <> tgt)")
def links_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.links_of(fx.links(spark, d), fx.links(spark, d).select(F.col("src").alias("id")).union(fx.links(spark, d).select("tgt")).distinct())


@query("select id, strategy from chunks where strategy <> 'naive'")
def delete_strategy(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).where("strategy <> 'naive'").select("id", "strategy")


_GONE = "gone as (select id from stored where priority = 3), dead as (select id from chunks where note_id in (select id from gone))"


@query("select 'notes' table_name, count(*) n_rows from stored where id not in (from gone) union all select 'chunks', count(*) from chunks where id not in (from dead) union all select 'embeddings', count(*) from vectors where chunk_id not in (from dead) union all select 'links', count(*) from links where src not in (from dead) and tgt not in (from dead)", _GONE)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    n = fx.stored(spark, d)
    left = store.delete_notes(n.where("priority = 3"), n, fx.chunks(spark, d), fx.chunk_vectors(spark, d), fx.links(spark, d))
    return store.stats(**dict(zip(("notes", "chunks", "embeddings", "links"), left)))


@query("select lang, count(*) n, max(length(text))::int longest from documents group by lang")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return store.sql(spark, "select lang, count(*) n, max(length(text)) longest from {t} group by lang", t=fx.read(spark, d, "documents"))


@query("select chunk_id, note_id, pos from vectors join chunks on chunk_id = id where strategy = 'naive'")
def emb_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    return store.embeddings_of(fx.chunk_vectors(spark, d), fx.chunks(spark, d), "naive").select("chunk_id", "note_id", F.col("order").alias("pos"))


@query("select id from chunks where id not in (select chunk_id from vectors)")
def emb_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.chunks_without_embeddings(fx.chunks(spark, d), fx.chunk_vectors(spark, d)).select("id")


@query("select e.id, e.other, c.title, e.similarity, e.link_type from (select src id, tgt other, similarity, link_type from links union all select tgt, src, similarity, link_type from links where src <> tgt) e join chunks c on c.id = e.other where e.id in (select id from chunks)")
def link_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return store.linked_chunks(fx.links(spark, d), fx.chunks(spark, d).select("id"), fx.chunks(spark, d))


@query("select * from links where src not in (from dead) and tgt not in (from dead)", _GONE)
def link_delete(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_links_of_notes(fx.links(spark, d), fx.chunks(spark, d), fx.stored(spark, d).where("priority = 3"))


@query("select id from status where status = 'stale'", _STATUS)
def stale_notes(spark: SparkSession, d: str) -> DataFrame:
    return store.classify(fx.seen(spark, d), fx.stored(spark, d)).where("status = 'stale'").select("id")


@query("select count(*) filter (status = 'new') n_new, count(*) filter (status = 'modified') n_modified, count(*) filter (status = 'unchanged') n_unchanged, count(*) filter (status = 'stale') n_stale from status", _STATUS)
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    return store.sync_report(store.classify(fx.seen(spark, d), fx.stored(spark, d)))


@query("select 'notes' table_name, count(*) n_rows from stored union all select 'chunks', count(*) from chunks union all select 'embeddings', count(*) from vectors union all select 'links', count(*) from links")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(notes=fx.stored(spark, d), chunks=fx.chunks(spark, d), embeddings=fx.chunk_vectors(spark, d), links=fx.links(spark, d))


@query("select note_id, string_agg(title, ', ' order by pos) titles, count(*) n_chunks from chunks group by note_id")
def titles_per_note(spark: SparkSession, d: str) -> DataFrame:
    return store.titles_per_note(fx.chunks(spark, d))


@query("select s.id, case when f.h is null then 'new' when f.h <> sha256(s.content) then 'modified' else 'unchanged' end state from seen s left join (select note_id, arg_min(sha256(content), pos) h from chunks where note_id <> 'doc_4' group by note_id) f on f.note_id = s.id")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    return store.detect_changes(fx.seen(spark, d), store.with_chunk_facts(fx.chunks(spark, d)).where("note_id <> 'doc_4'"))


@query(
    rf"""select id, note_id, sha256(content) content_hash, strategy from chunks
        where note_id not in (select s.id from seen s join stored o using (id) where o.content_hash <> sha256(s.content)) and note_id not in (select id from stored where id not in (select id from seen))
        union all select id || '::0::document', id, sha256(regexp_replace(content, '^\s+|\s+$', '', 'g')), 'document' from seen"""
)
def synchronise(spark: SparkSession, d: str) -> DataFrame:
    """The chunks after a synchronisation: those kept, and those made of notes that are new, changed or not yet cut in this way."""
    old = fx.chunks(spark, d).select("id", "note_id", "title", "content", "strategy", "order")
    _, chunks, _ = experiment.synchronise(fx.seen(spark, d), fx.stored(spark, d), store.with_chunk_facts(old), [("document", {})], F.lit(fx.NOW))
    return chunks.select("id", "note_id", "content_hash", "strategy")


@query("select id, tgt from (select id from stored union select id from seen) left join (select id as tgt from seen) on id = tgt where tgt is null or id in (select id from seen)")
def synchronised_notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes after a synchronisation that leaves notes alone which went, and which of them were seen."""
    old = fx.chunks(spark, d).select("id", "note_id", "title", "content", "strategy", "order")
    kept, _, _ = experiment.synchronise(fx.seen(spark, d), fx.stored(spark, d), store.with_chunk_facts(old), [("document", {})], F.lit(fx.NOW), delete_removed=False)
    return kept.select("id").join(fx.seen(spark, d).select("id", F.col("id").alias("tgt")), "id", "left")


# text functions

_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(T), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
_WORDS = r"regexp_extract_all(T, '[\p{L}\p{N}\p{Mn}_]{2,}')"


@query(rf"select doc_id, (length(text) // 4)::int tokens, sha256(text) hash, coalesce(nullif({_SLUG.replace('T', 'text')}, ''), 'sin-titulo') slug, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 30) plan_slug, strip_accents(lower(text)) plain, regexp_replace(text, '^\s+|\s+$', '', 'g') stripped from documents")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.read(spark, d, "documents").select("doc_id", tx.token_estimate(t).alias("tokens"), tx.content_hash(t).alias("hash"), tx.slugify(t).alias("slug"), tx.plan_slug(t).alias("plan_slug"), tx.normalize(t).alias("plain"), tx.strip(t).alias("stripped"))


@query(rf"select doc_id, {_WORDS.replace('T', 'text')} words, array_to_string(list_sort(list_distinct({_WORDS.replace('T', 'lower(text)')})), ' ') cache_key from documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("words"), tx.cache_key(F.col("text")).alias("cache_key"))


@query("select id, id || ' ' || array_to_string(tags, ' ') || ' ' || left(content, 512) embedding_text from notes")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return fx.notes(spark, d).select("id", tx.embedding_text(F.col("id"), F.col("tags"), F.col("content")).alias("embedding_text"))


@query("select note_id, '## Context' || chr(10) || chr(10) || string_agg('### ' || title || chr(10) || content, chr(10) || chr(10) order by pos) prompt from chunks group by note_id")
def prompt_format(spark: SparkSession, d: str) -> DataFrame:
    g = fx.chunks(spark, d).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("order", F.col("title").alias("heading"), F.col("content").alias("body")))).alias("x"))
    return g.select("note_id", tx.format_prompt(F.col("x"), "Context").alias("prompt"))


@query(r"select event_id, least(1, greatest(0, coalesce(try_cast(nullif(regexp_extract(props, '-?[0-9]+([.][0-9]+)?', 0), '') as double), 0)))::double score, nullif(regexp_extract('answer: ' || props || ' end', '(?s)\{.*\}', 0), '') json_text from events")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    e = fx.read(spark, d, "events")
    return e.select("event_id", tx.parse_score(F.col("props")).alias("score"), tx.json_object(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))).alias("json_text"))


_C = r"regexp_replace(regexp_replace(T, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"select conv_id, sha256({_C.replace('T', 'lower(q)')} || '|||' || array_to_string(list_sort(list_transform(c, lambda x: {_C.replace('T', 'x')})), '|||')) hash from (select conv_id, arg_min(text, turn) q, list(text order by turn desc) c from conversations group by conv_id)")
def context_hashes(spark: SparkSession, d: str) -> DataFrame:
    g = fx.read(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.collect_list("text").alias("c"))
    return g.select("conv_id", tx.context_hash(F.col("q"), F.col("c")).alias("hash"))


_VERBS = "['crea', 'crear', 'desarrolla', 'desarrollar', 'diseña', 'diseñar', 'implementa', 'implementar', 'construye', 'construir', 'programa', 'programar', 'genera', 'generar', 'automatiza', 'automatizar', 'refactoriza', 'refactorizar', 'build', 'create', 'develop', 'design', 'implement', 'generate']"
_YES = "('sí', 'si', 'ok', 'apruebo', 'adelante', 'yes', 'confirmo', 'procede', 'ejecuta', 'listo', 'dale', 'bien', 'correcto')"
_SAID = f"said as (select conv_id, turn, regexp_replace(case turn % 5 when 1 then ' Procede ' when 2 then 'Vale' when 3 then text || ' generar el informe' else text end, '^\\s+|\\s+$', '', 'g') s from conversations)"


@query(rf"select conv_id, turn, (length(s) >= 100 and s not like '%?' and len(list_intersect(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}\p{{Mn}}_]+'), {_VERBS})) > 0) triggers, lower(s) in {_YES} approves from said", _SAID)
def message_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Messages, some of them with an answer or a wish put in."""
    turn, text = F.col("turn") % 5, F.col("text")
    said = F.when(turn == 1, F.lit(" Procede ")).when(turn == 2, F.lit("Vale")).when(turn == 3, F.concat(text, F.lit(" generar el informe"))).otherwise(text)
    return fx.read(spark, d, "conversations").select("conv_id", "turn", tx.is_trigger(said).alias("triggers"), tx.is_approval(said).alias("approves"))


@query("select id, '[' || array_to_string(list_transform(tags, lambda t: '\"' || t || '\"'), ',') || ']' json, tags from notes")
def tags_json(spark: SparkSession, d: str) -> DataFrame:
    t = fx.notes(spark, d).select("id", tx.tags_json(F.col("tags")).alias("json"))
    return t.select("id", "json", tx.tags_from_json(F.col("json")).alias("tags"))


_PLAN = r"""'Plan: ```json {"tasks": [{"id": "a' || conv_id || '", "description": "d"}, {"depends_on": ["a' || conv_id || '"]}]} ``` done'"""


@query(r"select conv_id, unnest(['a' || conv_id, 'task_2']) id, unnest(['d', '']) description, unnest([[]::varchar[], ['a' || conv_id]]) depends_on from (select distinct conv_id from conversations)")
def plan_answers(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of a model's answers, with the defaults of what is absent."""
    c = fx.read(spark, d, "conversations").select("conv_id").distinct()
    tasks = c.select("conv_id", F.explode(tx.parse_plan(F.expr(_PLAN))).alias("t"))
    return tasks.select("conv_id", "t.id", "t.description", "t.depends_on")


@query("select conv_id, ['q' || conv_id, 'b', 'c', 'd'] questions, 'Proyecto Sin Título' title, 'r' || conv_id description, ['x'] requirements, ['sdd', 'proyecto_sin_t_tulo'] tags from (select distinct conv_id from conversations)")
def design_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions (four at most) and designs of a model's answers."""
    c = fx.read(spark, d, "conversations").select("conv_id").distinct()
    asked = F.expr(r"""'Ask: ["q' || conv_id || '", "", "b", null, "c", "d", "e"] please'""")
    design = tx.parse_design(F.lit('```{"requirements": ["x"]}```'), F.expr("'r' || conv_id"))
    return c.select("conv_id", tx.parse_questions(asked).alias("questions"), design.alias("s")).select("conv_id", "questions", "s.title", "s.description", "s.requirements", "s.tags")


# tag search and budget

_TAGQ = r"tagq as (select conv_id * 1000 + turn query_id, list_distinct(regexp_extract_all(strip_accents(lower('note ' || ['en', 'fr', 'de', 'es'][(1 + turn % 4)::int] || ' src' || conv_id % 25)), '[\p{L}\p{N}_]{2,}')) words from conversations)"


@query("select query_id, item_id, matches, rank from (select *, row_number() over (partition by query_id order by matches desc, priority desc, item_id)::int rank from (select query_id, id item_id, priority, len(list_intersect(words, tags))::int matches from tagq cross join notes) where matches > 0) where rank <= 5", _TAGQ)
def tag_search(spark: SparkSession, d: str) -> DataFrame:
    lang = F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("turn") % 4).cast("int"))
    q = fx.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("note "), lang, F.lit(" src"), (F.col("conv_id") % 25).cast("string")).alias("query"))
    return retrieval.tag_search(q, fx.notes(spark, d).select(F.col("id").alias("item_id"), "tags", "priority"), K)


@query("select id, len(list_intersect(tags, ['fr', 'src3', 'src5']))::int match_count, priority from notes where len(list_intersect(tags, ['fr', 'src3', 'src5'])) > 0 order by 2 desc, 3 desc, id limit 20")
def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.notes_by_tags(fx.notes(spark, d), ["fr", "src3", "src5"], 20).select("id", "match_count", "priority")


@query("select p_type query_id, item_id, matches, rank from (select *, row_number() over (partition by p_type order by matches desc, item_id)::int rank from (select p_type, 'p' || s_nationkey || '-' || s_suppkey item_id, count(distinct w)::int matches from (select distinct p_type, unnest(regexp_extract_all(lower(p_type), '[a-z0-9_]{2,}')) w from part) join (select s_suppkey, s_nationkey, unnest([['steel', 'economy'], ['brass', 'standard'], ['copper', 'promo'], ['tin', 'small'], ['nickel', 'large']][(1 + s_suppkey % 5)::int]) t from supplier) on w = t group by all)) where rank <= 5")
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    tags = F.get(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in (("steel", "economy"), ("brass", "standard"), ("copper", "promo"), ("tin", "small"), ("nickel", "large"))]), (F.col("s_suppkey") % 5).cast("int"))
    items = fx.read(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("item_id"), tags.alias("tags"), F.lit(0).alias("priority"))
    q = fx.read(spark, d, "part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("query")).distinct()
    return retrieval.tag_search(q, items, K, by_priority=False)


@query("select note_id query_id, unnest(list_reduce(list(struct_pack(chunk_id := id, tokens := (length(content) // 4)::bigint) order by -(1 + pos % 10), -pos), lambda a, x: case when a.used + x.tokens <= 500 then {'used': a.used + x.tokens, 'kept': list_append(a.kept, {'chunk_id': x.chunk_id, 'tokens': x.tokens::int})} else a end, {'used': 0::bigint, 'kept': []::struct(chunk_id varchar, tokens int)[]}).kept, recursive := true) from chunks group by note_id")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    r = fx.chunks(spark, d).select(F.col("note_id").alias("query_id"), F.col("id").alias("chunk_id"), tx.token_estimate(F.col("content")).alias("tokens"), (1 + F.col("order") % 10).alias("priority"), (-F.col("order")).alias("rank"))
    return retrieval.apply_budget(r, 500).drop("place")


# chunking


def _sql_cuts(weights: str, limit: int) -> str:
    return f"list_reduce({weights}, lambda a, x: case when a.used + x > {limit} and a.n > coalesce(a.cuts[len(a.cuts)], 0) then {{'used': x, 'n': a.n + 1, 'cuts': list_append(a.cuts, a.n)}} else {{'used': a.used + x, 'n': a.n + 1, 'cuts': a.cuts}} end, {{'used': 0::bigint, 'n': 0, 'cuts': []::int[]}}).cuts"


def _sql_groups(items: str, cuts: str, glue: str) -> str:
    edges = f"list_concat([0], {cuts}, [len({items})::int])"
    return f"list_transform(range(1, len({edges})), lambda k: array_to_string({items}[({edges})[k] + 1 : ({edges})[k + 1]], {glue}))"


@query(r"select doc_id, [regexp_replace(text, '^\s+|\s+$', '', 'g')] fragments from documents")
def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select("doc_id", chunking.document(F.col("text")).alias("fragments"))


@query(
    f"select doc_id, {_sql_groups('w', 'c', chr(39) + ' ' + chr(39))} fragments, c cuts from cut",
    rf"""words as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w from documents),
cut as (select doc_id, w, {_sql_cuts('list_transform(w, lambda x: (length(x) + 1)::bigint)', 400)} c from words where len(w) > 0)""",
)
def chunk_naive(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.read(spark, d, "documents").where(F.size(chunking.words(t)) > 0).select("doc_id", chunking.naive(t, 100).alias("fragments"), chunking.naive_boundaries(t, 100).alias("cuts"))


@query("select doc_id, u units from sent")
def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select("doc_id", chunking.sentences(F.col("text")).alias("units"))


_SECTIONS = r"""lines as (select note_id, unnest(range(len(l))) pos, unnest(l) line from (select note_id, string_split(content, chr(10)) l from md)),
fences as (select *, starts_with(line, '```') fence, sum(starts_with(line, '```')::int) over (partition by note_id order by pos) fno from lines),
marks as (select *, fence or (fno % 2 = 0 and (regexp_replace(line, '^\s+|\s+$', '', 'g') in ('---', '***', '___') or regexp_matches(line, '^#{2,3}\s+.+$'))) ev from fences),
numbered as (select *, sum(ev::int) over (partition by note_id order by pos) sec from marks),
grouped as (select note_id, sec, max(line) filter (ev) head, coalesce(bool_or(fence), false) fence, coalesce(max(fno) filter (ev and fence), 0) fno, count(*) filter (not ev) n, coalesce(string_agg(line, chr(10) order by pos) filter (not ev), '') body from numbered group by all),
found as (select *, fence and fno % 2 = 1 opened, max(sec) over (partition by note_id) last, not fence and head is not null and head like '##%' header from grouped),
sections as (select note_id, row_number() over (partition by note_id order by sec) - 1 i,
    case when head is null then 'introduccion' when opened then rtrim('codigo ' || trim(substr(head, 4))) when header then regexp_replace(regexp_replace(head, '^#{2,3}\s+', ''), '^\s+|\s+$', '', 'g') else 'continuacion' end title,
    case when header then case when head like '###%' then 3 else 2 end else 0 end::int level, body
    from found where case when opened then sec < last else n > 0 end)"""
_FAMILIES = r"""fam as (select *, max(case when level <> 3 then i end) over (partition by note_id order by i) lead from sections),
heads as (select f.*, l.level lead_level, l.body lead_body from fam f left join sections l on l.note_id = f.note_id and l.i = f.lead),
joined as (select note_id, lead, string_agg(chr(10) || chr(10) || '### ' || title || chr(10) || body, '' order by i) below, count(*) n from heads where level = 3 and lead_level = 2 group by all),
merged as (select h.note_id, h.i, h.title, h.level, h.body, h.level = 3 and coalesce(h.lead_level = 2, false) led, h.lead, coalesce(j.n, 0) n_below, h.body || coalesce(j.below, '') whole, h.lead_body || coalesce(k.below, '') lead_whole
    from heads h left join joined j on j.note_id = h.note_id and j.lead = h.i and h.level = 2 left join joined k on k.note_id = h.note_id and k.lead = h.lead and h.level = 3 and h.lead_level = 2)"""


@query("select note_id, i::int i, title, level, body from sections", _SECTIONS)
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    s = fx.markdown(spark, d).where("trim(content) <> ''").select("note_id", F.posexplode(chunking.sections(F.col("content"))).alias("i", "s"))
    return s.select("note_id", "i", "s.title", "s.level", "s.body")


_STRIP = r"regexp_replace(T, '^\s+|\s+$', '', 'g')"
_S = lambda x: _STRIP.replace("T", x)
_CHUNKS = rf"""merging as (select *, level = 2 and n_below > 0 and length(whole) // 4 <= {MAX_TOKENS} merges from merged),
ruled as (select *, led and (length(lead_whole) // 4 <= {MAX_TOKENS} or {_S('lead_whole')} = '') swallowed, case when merges then whole else body end used from merging),
alive as (select note_id, i, title, used, string_split(used, chr(10) || chr(10)) p, length(used) // 4 <= {MAX_TOKENS} fits from ruled where not swallowed and {_S('used')} <> ''),
cutp as (select *, {_sql_cuts('list_transform(p, lambda x: (length(x) // 4)::bigint)', MAX_TOKENS)} c from alive),
pieces as (select *, case when fits then [used] else {_sql_groups('p', 'c', 'chr(10) || chr(10)')} end g from cutp),
flat as (select note_id, i, title, len(g) n, unnest(range(len(g))) k, unnest(g) content from pieces),
chunked as (select note_id, (row_number() over (partition by note_id order by i, k) - 1)::int pos, case when n > 1 then title || ' (parte ' || (k + 1) || ')' else title end title, {_S('content')} content from flat
    union all select note_id, 0, 'introduccion', '' from md where note_id not in (select note_id from flat))"""


@query(f"select note_id, note_id || '::' || coalesce(nullif({_SLUG.replace('T', 'title')}, ''), 'sin-titulo') chunk_id, title, content, pos, sha256(content) content_hash from chunked", _SECTIONS, _FAMILIES, _CHUNKS)
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_chunks(fx.markdown(spark, d), MAX_TOKENS).withColumnRenamed("order", "pos")


_STRUCTURAL = rf"""bodies as (select note_id, i, title, level, case when level = 2 then whole else body end used from merged where not led),
paras as (select *, list_filter(list_transform(string_split(used, chr(10) || chr(10)), lambda x: {_S('x')}), lambda x: x <> '') p from bodies where {_S('used')} <> ''),
cutq as (select *, {_sql_cuts('list_transform(p, lambda x: (length(x) // 4)::bigint)', MAX_TOKENS)} c from paras),
parts as (select *, case when length(used) // 4 <= {MAX_TOKENS} or len(p) = 0 then [{_S('used')}] else {_sql_groups('p', 'c', 'chr(10) || chr(10)')} end g from cutq),
long as (select note_id, i, title, level, unnest(range(len(g))) k, unnest(g) content from parts),
kept as (select * from long where length(content) >= 20)"""


@query("select note_id, (row_number() over (partition by note_id order by i, k) - 1)::int pos, title, content, case level when 2 then 0.9 when 3 then 0.8 else 0.5 end::double confidence from kept union all select m.note_id, 0, '', coalesce((select body from sections s where s.note_id = m.note_id and i = 0), ''), 0.5::double from md m where note_id not in (select note_id from kept)", _SECTIONS, _FAMILIES, _STRUCTURAL)
def chunk_structural(spark: SparkSession, d: str) -> DataFrame:
    s = fx.markdown(spark, d).select("note_id", F.posexplode(chunking.structural(F.col("content"), MAX_TOKENS)).alias("pos", "s"))
    return s.select("note_id", "pos", "s.title", "s.content", chunking.structural_confidence(F.col("s.level")).cast("double").alias("confidence"))


_SIMPLE = rf"""slines as (select note_id, unnest(range(len(l))) pos, unnest(l) line, len(l) n from (select note_id, string_split(content, chr(10)) l from md)),
smark as (select *, sum(regexp_matches(line, '^#{{2,3}}\s+.+$')::int) over (partition by note_id order by pos) sec from slines where not (pos = n - 1 and line = '')),
sgroup as (select note_id, sec, max(line) filter (regexp_matches(line, '^#{{2,3}}\s+.+$')) head, string_agg(line, chr(10) order by pos) filter (not regexp_matches(line, '^#{{2,3}}\s+.+$')) body from smark group by all),
snum as (select note_id, (row_number() over (partition by note_id order by sec) - 1)::int pos, coalesce({_S("regexp_replace(head, '^#{2,3}\\s+', '')")}, 'introduccion') title, {_S('body')} content from sgroup where body is not null),
simple as (select * from snum where content <> '')"""


@query(f"select note_id, note_id || '::' || coalesce(nullif({_SLUG.replace('T', 'title')}, ''), 'sin-titulo') chunk_id, title, content, pos from simple union all select note_id, note_id || '::contenido', note_id, {_S('content')}, 0 from md where note_id not in (select note_id from simple)", _SIMPLE)
def chunk_simple(spark: SparkSession, d: str) -> DataFrame:
    return chunking.simple(fx.markdown(spark, d)).withColumnRenamed("order", "pos")


_SIGNAL = """sims as (select note_id, pos, unit, list_inner_product(vector, lead(vector) over (partition by note_id order by pos)) sim from units),
sig as (select note_id, list(unit order by pos) us, coalesce(list(sim order by pos) filter (sim is not null), []) x from sims group by note_id)"""
_GAUSS = vx.kernel("gaussian", 5)
_BELL = "list_transform(range(0, 5), lambda k: exp(-0.5 * pow((k - 2) / 1.25, 2)) / list_sum(list_transform(range(0, 5), lambda m: exp(-0.5 * pow((m - 2) / 1.25, 2)))))"  # deviation: a quarter of the size
_SMOOTH = f"""smooth as (select note_id, us, x, case when len(x) = 0 then [] else list_transform(range(0, greatest(len(x), 5)), lambda i: least(1, greatest(0, list_sum(list_transform(range(0, 5), lambda j:
    coalesce(case when i + (least(len(x), 5) - 1) // 2 - j >= 0 then x[(i + (least(len(x), 5) - 1) // 2 - j + 1)::int] end, 0) * ({_BELL})[(j + 1)::int]))))) end y from sig)"""
_VALLEYS = """vals as (select *, list_filter(range(0, len(y)), lambda i: y[(i + 1)::int] < T and y[(i + 1)::int] <= coalesce(case when i > 0 then y[i::int] end, 2) and y[(i + 1)::int] <= coalesce(y[(i + 2)::int], 2)) v from smooth)"""


@query("select note_id, list_transform(x, lambda s: round(s, 6)) signal from sig", _SIGNAL)
def sim_signal(spark: SparkSession, d: str) -> DataFrame:
    return chunking.signals(fx.units(spark, d)).select("note_id", F.transform("signal", lambda x: F.round(x, 6)).alias("signal"))


@query("select note_id, list_transform(y, lambda s: round(s, 6)) smoothed, list_transform(v, lambda i: i::int) valleys from vals", _SIGNAL, _SMOOTH, _VALLEYS.replace("T", "0.1"))
def conv_signal(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.signals(fx.units(spark, d)).withColumn("y", vx.clip(vx.convolve_same(F.col("signal"), _GAUSS)))
    return s.select("note_id", F.transform("y", lambda x: F.round(x, 6)).alias("smoothed"), vx.valleys(F.col("y"), 0.1).alias("valleys"))


_FRAGMENTS = f"""cutv as (select note_id, us, list_transform(list_filter(v, lambda i: i < len(x)), lambda i: (i + 1)::int) c from vals),
grp as (select note_id, list_filter({_sql_groups('us', 'c', chr(39) + ' ' + chr(39))}, lambda g: g <> '') g from cutv),
opn as (select note_id, g, list_transform(list_filter(range(1, len(g)), lambda i: length(g[(i + 1)::int]) >= 30), lambda i: i::int) c from grp)"""


@query(f"select note_id, {_sql_groups('g', 'c', chr(39) + ' ' + chr(39))} fragments from opn", _SIGNAL, _SMOOTH, _VALLEYS.replace("T", "0.1"), _FRAGMENTS)
def chunk_convolution(spark: SparkSession, d: str) -> DataFrame:
    return chunking.convolution(fx.units(spark, d), _GAUSS, 0.1).select("note_id", "fragments")


_SEM = r"""semu as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda u: regexp_replace(u, '^\s+|\s+$', '', 'g')), lambda u: u <> '') u from documents),
semv as (select 'doc_' || doc_id note_id, pos, unit, embedding::double[] vector from (select doc_id, unnest(range(len(u)))::int pos, unnest(u) unit from semu), nvec join embeddings on vec_id = (doc_id * 31 + pos) % n),
low as (select *, coalesce(list_cosine_similarity(lag(vector) over (partition by note_id order by pos), vector) < 0.0, false) cut from semv),
isl as (select *, sum(cut::int) over (partition by note_id order by pos) k from low),
frag as (select note_id, k, string_agg(unit, ' ' order by pos) f from isl group by all)"""


@query("select note_id, list(f order by k) fragments from frag group by note_id", _SEM)
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic(fx.units(spark, d, chunking.semantic_sentences), 0.0).select("note_id", "fragments")


@query("select note_id, list(((pos + 1) * 200)::int order by pos) breaks from (select note_id, pos, list_cosine_similarity(vector, lead(vector) over (partition by note_id order by pos)) s from win) where s < 0.0 group by note_id", "win as (select 'doc_' || doc_id note_id, pos, embedding::double[] vector from (select doc_id, unnest(range(0, (length(text) + 199) // 200))::int pos from documents), nvec join embeddings on vec_id = (doc_id * 31 + pos) % n)")
def semantic_windows(spark: SparkSession, d: str) -> DataFrame:
    w = fx.units(spark, d, lambda t: chunking.sliding_windows(t, 400, 200))
    return chunking.window_breaks(w, 200, 0.0)


@query(
    rf"select note_id, note_id || '::' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'chunk') || '-' || pos chunk_id, title, content, pos from titled",
    rf"""para as (select 'doc_' || doc_id note_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda u: {_S('u')}), lambda u: u <> '') p from documents),
pw as (select note_id, k, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') w from (select note_id, unnest(range(len(p))) k, unnest(p) s from para)),
pc as (select note_id, k, w, {_sql_cuts('list_transform(w, lambda x: (length(x) + 1)::bigint)', 80)} c from pw where len(w) > 0),
pg as (select note_id, k, {_sql_groups('w', 'c', chr(39) + ' ' + chr(39))} g from pc),
pf as (select note_id, k, unnest(range(len(g))) j, unnest(g) content from pg),
titled as (select note_id, content, (row_number() over (partition by note_id order by k, j) - 1)::int pos, left(content, 60) title from pf)""",
)
def pipeline_two_stage(spark: SparkSession, d: str) -> DataFrame:
    notes = fx.read(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("note_id"), F.col("text").alias("content"))
    return chunking.adapt(registry.run(notes, [("sentences", {}), ("naive", {"max_tokens": 20})])).withColumnRenamed("order", "pos")


@query("select id || '::0' chunk_id, id note_id, title, content, 0 pos from notes")
def chunk_per_note(spark: SparkSession, d: str) -> DataFrame:
    return fx.notes(spark, d).select(F.concat("id", F.lit("::0")).alias("chunk_id"), F.col("id").alias("note_id"), "title", "content", F.lit(0).alias("pos"))


@query("select s.note_id, flatten(list(s.x order by f)) signal, flatten(list(list_transform(s.v, lambda i: (i + off)::int) order by f)) valleys from (select *, coalesce(sum(n) over (partition by note_id order by f rows between unbounded preceding and 1 preceding), 0) off from fr) s group by s.note_id", "fr as (select 'c' || l_orderkey % 50 note_id, l_orderkey f, count(*) n, list(l_discount order by l_linenumber, l_discount) x, list(l_linenumber order by l_linenumber) v from lineitem group by l_orderkey)")
def signal_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount")))
    g = fx.read(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"), F.count("*").alias("n_units"))
    f = g.select(F.concat(F.lit("c"), (F.col("l_orderkey") % 50).cast("string")).alias("note_id"), F.col("l_orderkey").alias("frag"), "n_units", F.col("r.l_discount").alias("signal"), F.col("r.l_linenumber").alias("valleys"))
    return chunking.concat_signals(f)


# evaluation


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Top 5 of each query, of every fifth only the first; relevant ids as listed, one of them twice."""
    top = vec_topk(spark, d).where("query_id % 5 > 0 or rank = 1")
    got = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("c")))).alias("r"))
    return got.select("query_id", F.col("r.c").alias("retrieved"), F.array(F.concat(F.lit("v"), F.col("query_id").cast("string")), F.lit("v1"), F.lit("v1"), F.lit("7")).alias("relevant"))


_EVAL = """top as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scores where score >= 0) where rank <= 5 and (query_id % 5 > 0 or rank = 1)),
res as (select query_id, list('v' || chunk_id order by rank) r, ['v' || query_id, 'v1', 'v1', '7'] rel from top group by query_id),
flags as (select *, list_transform(r, lambda x: len(list_filter(rel, lambda y: contains(x, y))) > 0) h from res),
gains as (select *, list_sum(list_transform(range(1, len(h) + 1), lambda i: case when h[i] then 1 / log2(i + 1) else 0 end)) dcg, list_sum(list_transform(range(1, least(len(list_distinct(rel)), len(r)) + 1), lambda i: 1 / log2(i + 1))) idcg, len(list_filter(h, lambda x: x)) hits from flags)"""


@query("select query_id, hits / len(r)::double as precision, hits / len(rel)::double recall, coalesce(1.0 / list_position(h, true), 0)::double mrr, round(dcg / idcg, 6) ndcg, len(r)::int n_retrieved, len(rel)::int n_relevant, len(list_intersect(r, rel))::int n_relevant_retrieved from gains", _SCORES, _EVAL)
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ir_metrics(_results(spark, d), K).withColumn("ndcg", F.round("ndcg", 6))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as judged queries of runs by priority."""
    o = fx.read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("run"), k.alias("query_id"), F.array(F.repeat(F.lit("x"), (k % 400).cast("int")), F.lit("yy")).alias("contents"),
        F.when(k % 7 != 0, (k % 11) / 10.0).alias("score"), F.when(k % 5 != 0, (k % 3) / 2.0).alias("context_precision"), F.when(k % 5 != 1, (k % 4) / 3.0).alias("context_recall"),
        (F.floor("o_totalprice") / 10).alias("latency_ms"), (k % 13 == 0).alias("cache_hit"), (k % 2 == 0).alias("from_cache"),
    )


_RUNS = """runs as (select *, case when context_tokens = 0 then 0 else context_tokens / (coalesce(score, 0) + 0.01) end::double e_tok from (select o_orderpriority run, o_orderkey query_id, ((o_orderkey % 400 + 2) // 4)::bigint context_tokens,
    case when o_orderkey % 7 <> 0 then (o_orderkey % 11) / 10.0 end::double score, case when o_orderkey % 5 <> 0 then (o_orderkey % 3) / 2.0 end::double context_precision, case when o_orderkey % 5 <> 1 then (o_orderkey % 4) / 3.0 end::double context_recall,
    floor(o_totalprice) / 10 latency_ms, o_orderkey % 13 = 0 cache_hit, o_orderkey % 2 = 0 from_cache from orders)),
agg as (select run, count(*) n_queries, sum(latency_ms) / count(*) mean_latency_ms, sum(context_tokens) / count(*)::double mean_context_tokens, sum(coalesce(score, 0)) / count(*) mean_score, sum(coalesce(context_precision, 0)) / count(*) mean_precision,
    sum(coalesce(context_recall, 0)) / count(*) mean_recall, sum(e_tok) / count(*) mean_e_tok, avg(cache_hit::int) cache_hit_rate, coalesce(avg(from_cache::int) filter (score is not null), 0) judge_cache_rate from runs group by run)"""
_MEANS = ("mean_latency_ms", "mean_context_tokens", "mean_score", "mean_precision", "mean_recall", "mean_e_tok", "cache_hit_rate", "judge_cache_rate")


@query("select query_id, context_tokens, round(e_tok, 4) e_tok, cache_hit from runs", _RUNS)
def e_tok(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.performance(_runs(spark, d)).withColumn("e_tok", F.round("e_tok", 4))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    return r.join(evaluation.performance(r).select("query_id", "context_tokens", "e_tok"), "query_id")


@query("select run, n_queries, " + ", ".join(f"round({c}, 4) {c}" for c in _MEANS) + " from agg", _RUNS)
def aggregate_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = evaluation.aggregate(_judged(spark, d))
    return a.select("run", "n_queries", *[F.round(c, 4).alias(c) for c in _MEANS])


@query("select run, " + ", ".join(f"round({c}, 6) = (select {how}(round({c}, 6)) from agg) best_{c}" for c, how in evaluation.BEST.items()) + " from agg", _RUNS)
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    a = experiment.experiment(_runs(spark, d))
    return a.select("run", *[c for c in a.columns if c.startswith("best_")])


@query("select query_id, 'q' || query_id as query, round(latency_ms, 2) latency_ms, context_tokens, cache_hit from runs", _RUNS)
def metrics_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics_rows(_judged(spark, d).withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string"))), with_judge=False)


_JUDGE = f"""convs as (select conv_id query_id, arg_min(text, turn) q, list(text) c from conversations group by conv_id),
keyed as (select query_id, sha256({_C.replace('T', 'lower(q)')} || '|||' || array_to_string(list_sort(list_transform(c, lambda x: {_C.replace('T', 'x')})), '|||')) hash from convs),
jcache as (select hash, min(query_id % 10) / 10.0 s from keyed where query_id % 3 = 0 group by hash)"""


@query("select query_id, hash, s::double faithfulness, s::double answer_relevancy, s::double context_precision, s::double context_recall, s is not null from_cache from keyed left join jcache using (hash)", _JUDGE)
def judge_cache(spark: SparkSession, d: str) -> DataFrame:
    g = fx.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"), F.collect_list("text").alias("contexts"))
    score = (F.min(F.col("query_id") % 10) / 10.0).alias("s")
    c = g.where("query_id % 3 = 0").groupBy(tx.context_hash(F.col("query"), F.col("contexts")).alias("hash")).agg(score)
    return evaluation.judged(g, c.select("hash", *[F.col("s").alias(n) for n in ("faithfulness", "answer_relevancy", "context_precision", "context_recall")]))


@query("select session, seq, floor(h / n * 10000 + 0.5 + 1e-7) / 10000 hit_rate, floor(dep / n * 100 + 0.5 + 1e-7) / 100 avg_depth from (select *, sum(hit) over w h, count(*) over w n, sum(depth) over w dep from acc window w as (partition by session order by seq)) where seq % 10 = 0", "acc as (select l_suppkey session, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) seq, (l_returnflag = 'R')::int hit, l_linenumber depth from lineitem)")
def access_history(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).cast("long")
    a = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), seq.alias("seq"), (F.col("l_returnflag") == "R").alias("hit"), F.col("l_linenumber").alias("depth"))
    return evaluation.access_history(a)


# task graphs


@query("select t.graph, t.id, needs from (select graph, id, unnest(depends_on) needs from tasks) t anti join tasks k on k.graph = t.graph and k.id = t.needs")
def dag_missing(spark: SparkSession, d: str) -> DataFrame:
    return graph.missing(fx.tasks(spark, d))


_WALK = """edges as (select distinct graph, id, unnest(depends_on) needs from tasks),
walk as (select graph, id, 0 lvl from tasks where len(depends_on) = 0 union select e.graph, e.id, lvl + 1 from walk w join edges e on e.graph = w.graph and e.needs = w.id where lvl < 40),
looped as (select graph, id, needs reach from edges union select l.graph, l.id, e.needs from looped l join edges e on e.graph = l.graph and e.id = l.reach)"""


@query("select t.graph, t.id, count(l.id) > 0 in_cycle from tasks t left join (select distinct graph, id from (select graph, id from looped where id = reach union all select o.graph, o.id from looped o join (select distinct graph, id from looped where id = reach) c on c.graph = o.graph and c.id = o.reach)) l on l.graph = t.graph and l.id = t.id group by all", _WALK)
def dag_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.order(fx.tasks(spark, d)).select("graph", "id", "in_cycle")


@query("select graph, id, status = 'pending' and not exists (select 1 from (select unnest(t.depends_on) n) d where n not in (select id from tasks k where k.graph = t.graph and k.status = 'completed')) is_ready from tasks t")
def task_ready(spark: SparkSession, d: str) -> DataFrame:
    return graph.ready(fx.tasks(spark, d)).select("graph", "id", "is_ready")


@query("select t.graph, t.id, case when count(b.id) = 0 then max(w.lvl)::int end level from tasks t left join walk w on w.graph = t.graph and w.id = t.id left join behind b on b.graph = t.graph and b.id = t.id group by t.graph, t.id", _WALK, "behind as (select graph, id from looped where id = reach union select o.graph, o.id from looped o join looped c on c.graph = o.graph and c.id = o.reach and c.id = c.reach)")
def dag_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of all graphs; tasks of or behind a cycle have null."""
    return graph.levels(fx.tasks(spark, d))


@query()
def dag_places(spark: SparkSession, d: str) -> DataFrame:
    """The order of execution itself; what stands in a cycle has no place."""
    return graph.order(fx.tasks(spark, d))


@query()
def next_task(spark: SparkSession, d: str) -> DataFrame:
    t = fx.tasks(spark, d)
    return graph.next_task(graph.ready(t).join(graph.order(t), ["graph", "id"]).where("place is not null"))


@query("select graph, count(*) total, count(*) filter (status = 'pending') n_pending, count(*) filter (status = 'in_progress') n_in_progress, count(*) filter (status = 'completed') n_completed, count(*) filter (status = 'failed') n_failed, bool_and(status = 'completed') is_done, bool_or(status = 'failed') has_failures from tasks group by graph")
def task_progress(spark: SparkSession, d: str) -> DataFrame:
    return graph.progress(fx.tasks(spark, d))


# the cache


def _log(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "conversations")
    words = F.array_distinct(tx.tokens(F.lower("text")))
    return c.select(F.col("conv_id").alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), words.alias("words"), F.array(F.concat(F.lit("c"), (F.col("turn") % 7).cast("string")), F.concat(F.lit("c"), (F.col("conv_id") % 9).cast("string"))).alias("results"))


@query()
def cache_simulation(spark: SparkSession, d: str) -> DataFrame:
    return cache.simulate(_log(spark, d), capacity=10)


@query()
def cache_two_level(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    tagged = F.transform("results", lambda r: F.struct(r.alias("id"), F.slice("words", 1, 2).alias("tags")))
    return cache.two_level(log.withColumn("results", tagged), capacity=10)


@query(r"select session, seq, key, row_number() over (partition by session, key order by seq) > 1 and key <> '' hit from (select conv_id session, conv_id * 1000 + turn seq, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Mn}_]{2,}'))), ' ') as key from conversations)")
def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the exact-key cache, over all words of each message."""
    return cache.repeats_exactly(_log(spark, d))


@query(
    "select query_id, '## Context' || chr(10) || chr(10) || string_agg('### ' || source || chr(10) || text, chr(10) || chr(10) order by place) context from taken join documents on doc_id = chunk_id group by query_id",
    _SCORES,
    """best as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scores where score >= 0.5) where rank <= 5),
listed as (select query_id, list(struct_pack(chunk_id := chunk_id, tokens := (length(text) // 4)::bigint) order by -(1 + doc_id % 10), rank) l from best join documents on doc_id = chunk_id group by query_id),
chosen as (select query_id, list_reduce(l, lambda a, x: case when a.used + x.tokens <= 1024 then {'used': a.used + x.tokens, 'kept': list_append(a.kept, x.chunk_id)} else a end, {'used': 0::bigint, 'kept': []::bigint[]}).kept k from listed),
taken as (select query_id, unnest(k) chunk_id, unnest(range(len(k))) place from chosen)""",
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    c = fx.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), (1 + F.col("doc_id") % 10).alias("priority"))
    return experiment.prompt_context(_queries(spark, d), v, c)


# the index and experiments

_W = r"'[\p{L}\p{N}\p{Mn}_]{2,}'"


def _sql_encode(name: str, rows: str, id_: str) -> str:
    """name as (id_, vec float[]) of rows with id_ and a text t: the stand-in encoder, and the tables it needs."""
    return f"""{name}_w as (select {id_}, unnest(list_distinct(regexp_extract_all(lower(t), {_W}))) w from {rows}),
{name}_v as (select w, list_transform(range(0, {index.DIM}), lambda i: ('0x' || substr(sha256(w), (2 * i + 1)::int, 2))::int * 2 - 255) v from (select distinct w from {name}_w)),
{name}_s as (select {id_}, d, sum(v[d + 1])::double s from {name}_w join {name}_v using (w), (select unnest(range({index.DIM}))::int d) group by all),
{name}_l as (select {id_}, list(s order by d) s from {name}_s group by {id_}),
{name} as (select {id_}, coalesce(list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y))))::float[], list_transform(range({index.DIM}), lambda x: 0::float)) vec from {rows} left join {name}_l using ({id_}))"""


@query(
    "select id chunk_id, len(vec)::int dim, list_transform(vec, lambda x: round(x::double, 4)) vector from ienc",
    "itext as (select id, id || '  ' || left(case when pos % 3 <> 0 and pos % 4 <> 1 then content || ' old' else content end, 512) t from chunks)",
    _sql_encode("ienc", "itext", "id"),
)
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """The index after an update: chunks without a vector are encoded, those of every fourth line anew, and the others keep the vectors of their older contents."""
    c = fx.chunks(spark, d).withColumn("tags", F.array().cast("array<string>"))
    old = index.build(c.where("order % 3 <> 0").withColumn("content", F.concat("content", F.lit(" old"))), index.hashed_encoder)
    after = index.update(index.update(old, c, index.hashed_encoder), c.where("order % 4 = 1"), index.hashed_encoder, force=True)
    return after.select("chunk_id", "dim", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


_HUNITS = """hsent as (select 'doc_' || doc_id note_id, pos, unit t, 'doc_' || doc_id || '/' || pos uid, unit from (select doc_id, unnest(range(len(u)))::int pos, unnest(u) unit from sent)),
""" + _sql_encode("henc", "hsent", "uid") + """,
hunits as (select note_id, pos, unit, vec::double[] vector from hsent join henc using (uid))"""


@query(
    f"select note_id, {_sql_groups('g', 'c', chr(39) + ' ' + chr(39))} fragments, list_transform(c, lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))::int) positions, list_transform(c, lambda i: round(1 - y[v[i] + 1], 6)) confidences, len({_sql_groups('g', 'c', chr(39) + ' ' + chr(39))})::int n_output from opn join vals using (note_id)",
    _HUNITS, _SIGNAL.replace("from units", "from hunits"), _SMOOTH, _VALLEYS.replace("T", "0.3"), _FRAGMENTS,
)
def chunk_plugins(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline of plug-ins that compares vectors, with what its stages report."""
    n = fx.notes(spark, d).select(F.col("id").alias("note_id"), "content")
    made = registry.with_stages(n, [("document", {}), ("convolution", {"threshold": 0.3})], index.hashed_encoder)
    last = F.element_at("stages", -1)
    return made.where(F.size("fragments") > 0).select(
        "note_id", "fragments", F.transform(last["boundaries"], lambda b: b["position"]).alias("positions"), F.transform(last["boundaries"], lambda b: F.round(b["confidence"], 6)).alias("confidences"), last["n_output"].alias("n_output")
    )


_MATRIX = rf"""xdoc as (select id note_id, tags, regexp_replace(content, '^\s+|\s+$', '', 'g') content from notes),
xnw as (select id note_id, tags, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') w from notes),
xnc as (select note_id, tags, w, {_sql_cuts('list_transform(w, lambda x: (length(x) + 1)::bigint)', 800)} c from xnw where len(w) > 0),
xng as (select note_id, tags, {_sql_groups('w', 'c', chr(39) + ' ' + chr(39))} g from xnc),
xfrag as (select 'whole' run, note_id, tags, 0 pos, content from xdoc union all select 'naive', note_id, tags, unnest(range(len(g)))::int, unnest(g) from xng),
xtitle as (select *, coalesce(nullif({_S("regexp_extract(content, '(?m)^[ \\t]*#{1,3}[ \\t]+([^\\n]+)$', 1)")}, ''), nullif(left({_S(f"split_part({_S('content')}, chr(10), 1)")}, 60), ''), note_id || ' parte ' || (pos + 1)) title from xfrag),
xchunk as (select run, note_id || '::' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'chunk') || '-' || pos chunk_id, tags, content from xtitle),
xtext as (select run || '|' || chunk_id cid, run, chunk_id, content, chunk_id || ' ' || array_to_string(tags, ' ') || ' ' || left(content, 512) t from xchunk),
{_sql_encode('xenc', 'xtext', 'cid')},
xask as (select item_id, text t from benchmark),
{_sql_encode('xqenc', 'xask', 'item_id')},
xscore as (select q.item_id query_id, run, chunk_id, content, list_inner_product(q.vec::double[], e.vec::double[]) score from xqenc q cross join xenc e join xtext using (cid)),
xtop as (select *, row_number() over (partition by run, query_id order by score desc, chunk_id) rank from xscore where score >= 0.2)"""


@query("select run, query_id, list(chunk_id order by rank) retrieved, (sum(length(content)) // 4)::bigint context_tokens, false cache_hit from xtop where rank <= 5 group by run, query_id", _MATRIX)
def experiment_run(spark: SparkSession, d: str) -> DataFrame:
    """Two ways of chunking under exact search, for all benchmark texts as queries."""
    asked = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array(F.lit("doc_1")).alias("relevant"))
    options = {"strategy": "embeddings", "options": {"threshold": 0.2}}
    runs = [{"name": "whole", "stages": [("document", {})], **options}, {"name": "naive", "stages": [("naive", {"max_tokens": 200})], **options}]
    r = experiment.run_matrix(fx.notes(spark, d), asked, runs, index.hashed_encoder)
    tokens = F.floor(F.aggregate("contents", F.lit(0).cast("long"), lambda s, c: s + F.length(c)) / 4).cast("long")
    return r.select("run", "query_id", "retrieved", tokens.alias("context_tokens"), "cache_hit")
