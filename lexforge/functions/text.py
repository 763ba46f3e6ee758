"""Text functions as Column expressions; all of them run inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks NFKD sets free, as a pattern: quicker than asking for each character. One with characters beyond \uffff would be slow
_COMBINING = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.combining(c)) + "]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
VERBS = tuple(
    "crea crear desarrolla desarrollar diseña diseñar implementa implementar construye construir programa programar genera generar "
    "automatiza automatizar refactoriza refactorizar build create develop design implement generate".split()
)
APPROVALS = tuple("sí si ok apruebo adelante yes confirmo procede ejecuta listo dale bien correcto".split())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once: inside a lambda, or in more than one place of a condition, an expression would be computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim() alone takes blanks only)."""
    return F.btrim(c, F.lit(_BLANKS))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def slugify(c: Column, empty: str = "sin-titulo", collapse: bool = True) -> Column:
    """Lower case, other characters than a-z 0-9 white space and - dropped (accented letters too), white space to -."""
    low = F.lower(c)
    kept = F.regexp_replace(low, r"(?U)[^a-z0-9\s-]+", "")
    s = F.btrim(F.regexp_replace(kept, r"(?U)[\s-]+" if collapse else r"(?U)\s+", "-"), F.lit("-"))
    # a look at the text, up to its first letter or figure, instead of at the slug: that would be made twice
    return F.when(low.rlike("[a-z0-9]"), s).when(c.isNotNull(), F.lit(empty))


def plan_slug(c: Column) -> Column:
    """The design documents' variant: runs of other characters to _, at most 30 characters."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), 1, 30)


def _without_marks(text: str) -> str:
    plain = _COMBINING.sub("", unicodedata.normalize("NFKD", text.lower()))
    return "".join(c for c in plain if not unicodedata.combining(c)) if _BEYOND.search(plain) else plain


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(_without_marks, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkd_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: [None if t is None else _without_marks(t) for t in x], na_action="ignore")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def normalize(c: Column) -> Column:
    """Lower case without accents: NFKD without combining marks. ASCII text stays in the JVM; other values go through Python, in Arrow batches."""
    plain = _ascii(c)
    return F.when(plain, F.lower(c)).otherwise(_nfkd(F.when(~plain, c)))


def normalize_each(c: Column) -> Column:
    """normalize() of every element of an array."""
    odd = F.exists(c, lambda x: ~_ascii(x))
    return F.when(odd, _nfkd_each(F.when(odd, c))).otherwise(F.transform(c, lambda x: F.lower(x)))


def tokens(c: Column, least: int = 2) -> Column:
    """Words of at least so many characters, with repetitions, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\b\w{%d,}\b" % least), F.lit(0))


def cache_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(F.lower(c)))), " ")


def embedding_text(id_: Column, tags: Column, content: Column, limit: int = 512) -> Column:
    return F.concat_ws(" ", id_, F.array_join(tags, " "), F.substring(content, 1, limit))


def parse_score(c: Column) -> Column:
    """The first number of an answer, clamped to 0..1; none is 0."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(found.try_cast("double"), F.lit(0.0))))


def _collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def context_hash(query: Column, contexts: Column) -> Column:
    """A judge cache key: the order of the contexts does not matter, the query's case neither."""
    parts = F.array_join(F.array_sort(F.transform(contexts, _collapse)), "|||")
    return F.sha2(F.concat(_collapse(F.lower(query)), F.lit("|||"), parts), 256)


def json_object(c: Column) -> Column:
    """From the first { to the last } of an answer; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def json_list(c: Column) -> Column:
    """From the first [ to the last ] of an answer; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def parse_questions(c: Column, limit: int = 4) -> Column:
    """The first questions of an answer's JSON list, without empty ones; none where it cannot be parsed."""
    items = F.coalesce(F.from_json(json_list(c), "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(items, lambda q: q.isNotNull() & (q != "")), 1, limit)


def parse_design(c: Column, request: Column) -> Column:
    """struct<title, description, requirements, constraints, tags> of an answer's JSON object, with the defaults of what is absent."""
    d = F.from_json(json_object(c), "title string, description string, requirements array<string>, constraints array<string>")
    none = F.array().cast("array<string>")
    title = F.coalesce(d["title"], F.lit("Proyecto Sin Título"))
    slug = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), 1, 30)
    return F.struct(title.alias("title"), F.coalesce(d["description"], request).alias("description"), F.coalesce(d["requirements"], none).alias("requirements"), F.coalesce(d["constraints"], none).alias("constraints"), F.array(F.lit("sdd"), slug).alias("tags"))


def parse_plan(c: Column) -> Column:
    """array<struct<id, description, depends_on, tags>> of an answer's JSON plan; tasks without an id are numbered, an answer that is no JSON has none."""
    d = F.from_json(json_object(c), "tasks array<struct<id:string,description:string,depends_on:array<string>>>")
    none = F.array().cast("array<string>")

    def task(t: Column, k: Column) -> Column:
        name = F.coalesce(t["id"], F.concat(F.lit("task_"), (k + 1).cast("string")))
        return F.struct(name.alias("id"), F.coalesce(t["description"], F.lit("")).alias("description"), F.coalesce(t["depends_on"], none).alias("depends_on"), F.array(F.lit("plan"), name).alias("tags"))

    return F.transform(F.coalesce(d["tasks"], F.array().cast("array<struct<id:string,description:string,depends_on:array<string>>>")), task)


def tags_json(tags: Column) -> Column:
    """Tags as the JSON text the store keeps."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def tags_from_json(c: Column) -> Column:
    """Tags of their JSON text; null and broken text give none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def is_trigger(c: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """A long message that is no question and holds a verb of making."""
    s = strip(c)
    return (F.length(s) >= 100) & ~s.endswith("?") & F.arrays_overlap(tokens(F.lower(s), 1), F.array(*map(F.lit, verbs)))


def is_approval(c: Column, words: tuple[str, ...] = APPROVALS) -> Column:
    return strip(F.lower(c)).isin(*words)


def prompt_section(heading: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), heading, F.lit("\n"), body)


def format_prompt(items: Column, title: str) -> Column:
    """One text of an array of structs (heading, body), as they stand; empty for no items."""
    text = F.array_join(F.transform(items, lambda x: prompt_section(x["heading"], x["body"])), "\n\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), text)).otherwise(F.lit(""))


def note_title(content: Column, note_id: Column) -> Column:
    """The first top-level header; the id if there is none."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(content, r"(?m)^[ \t]*#[ \t]+([^\n]+)$", 1)), F.lit("")), note_id)


def fragment_title(fragment: Column, otherwise: Column) -> Column:
    """The first header of a fragment, else the first 60 characters of its first line, else another name."""
    header = F.nullif(strip(F.regexp_extract(fragment, r"(?m)^[ \t]*#{1,3}[ \t]+([^\n]+)$", 1)), F.lit(""))
    first = F.nullif(F.substring(strip(F.substring_index(strip(fragment), "\n", 1)), 1, 60), F.lit(""))
    # most fragments hold no header, which is seen without a regular expression
    return F.coalesce(F.when(F.contains(fragment, F.lit("#")), header), first, otherwise)
