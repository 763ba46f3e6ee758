"""Notes (Markdown with front matter), evaluation sets, judge caches and catalogues as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx

_FRONT = r"(?s)\A---[ \t]*\n(?:(.*?)\n)?---[ \t]*(?:\n|\z)(.*)\z"


def _field(front: Column, name: str) -> Column:
    return F.regexp_extract(front, rf"(?m)^{name}:[ \t]*([^\n]*)$", 1)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(tx.strip(c), r"^[\"']|[\"']$", "")


def front_matter(raw: Column) -> tuple[Column, Column]:
    """The front matter (empty if there is none) and the body."""
    has = raw.rlike(_FRONT)
    return F.when(has, F.regexp_extract(raw, _FRONT, 1)).otherwise(F.lit("")), F.when(has, F.regexp_extract(raw, _FRONT, 2)).otherwise(raw)


def tag_list(front: Column, commas: bool = True) -> Column:
    """Tags of an inline list, a block list or (with commas) a comma-separated text; lower case, empty ones dropped."""
    value = tx.strip(_field(front, "tags"))
    block = F.regexp_extract(front, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))*)", 1)
    inline = F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",")
    listed = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*([^\n]*)$"), F.lit(1))
    plain = inline if commas else F.array().cast("array<string>")
    raw = F.when(value.startswith("["), inline).when(value != "", plain).otherwise(listed)
    return F.filter(F.transform(raw, lambda t: F.lower(_unquoted(t))), lambda t: t != "")


def parse_notes(files: DataFrame, strict: bool = True) -> DataFrame:
    """(stem, raw) -> id, title, tags, priority, content.

    strict clamps the priority to 1..10 and takes comma-separated tags; otherwise neither. Priority
    is 5 where it is absent or no number; the id falls back to the file's stem.
    """
    front, body = front_matter(F.col("raw"))
    d = files.withColumn("__front", front).withColumn("__body", tx.strip(body))
    priority = F.coalesce(tx.strip(_field(F.col("__front"), "priority")).try_cast("int"), F.lit(5))
    if strict:
        priority = F.least(F.lit(10), F.greatest(F.lit(1), priority))
    d = d.withColumn("id", F.coalesce(F.nullif(_unquoted(_field(F.col("__front"), "id")), F.lit("")), F.col("stem")))
    return d.select("id", tx.note_title(F.col("__body"), F.col("id")).alias("title"), tag_list(F.col("__front"), strict).alias("tags"), priority.cast("int").alias("priority"), F.col("__body").alias("content"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.url_decode(path), "/"), -1), r"\.[^.]*$", "")


def read_notes(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """All *.md files of a folder (not of its subfolders)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return parse_notes(files.select(_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("raw")), strict)


def load_or_chunk(notes: DataFrame, stored: DataFrame | None, chunker) -> DataFrame:
    """Stored chunks if there are any at all, else the chunks of all notes."""
    return stored if stored is not None and not stored.isEmpty() else chunker(notes)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: id, query, relevant, expected_answer, tags of a JSON (or, where a YAML library is installed, YAML) file; unreadable ones are empty."""
    schema = "id string, query string, relevant array<string>, expected_answer string, tags array<string>"
    try:
        raw = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(raw)
        else:
            data = json.loads(raw)
        items = data["queries"]
    except (OSError, ValueError, KeyError, TypeError, ImportError):
        items = []
    answer = lambda a: a if isinstance(a, str) else " ".join(a)
    rows = [(str(q.get("id", "")), q.get("query", ""), list(q.get("relevant_chunk_ids", [])), answer(q.get("expected_answer", "")), list(q.get("tags", []))) for q in items]
    return spark.createDataFrame(rows, schema)


def read_judge_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of hash to scores, or JSON lines of such objects, as rows; corrupt ones are empty."""
    scores = "struct<faithfulness:double,answer_relevancy:double,context_precision:double,context_recall:double>"
    kind = f"map<string,{scores}>"
    whole = spark.read.text(path, wholetext=True).select("value", F.from_json("value", kind).alias("m"), F.size(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("n"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.from_json(x, kind)), lambda m: m.isNotNull())
    first = F.split("value", "\n")[0]
    each = F.when((F.col("n") > 1) & F.from_json(first, kind).isNotNull() & first.rlike(r"\}\s*$"), lines).otherwise(F.array("m"))
    return whole.select(F.explode(each).alias("m")).where("m is not null").select(F.explode("m").alias("hash", "s")).select("hash", "s.*")


def write_judge_cache(cache: DataFrame, path: str) -> None:
    """Judge scores as JSON lines, an object of hash to scores each, which read_judge_cache() takes as well as one object of all."""
    scores = F.struct("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    cache.select(F.to_json(F.create_map("hash", scores)).alias("value")).write.mode("overwrite").text(path)


def clear_judge_cache(spark: SparkSession, path: str) -> bool:
    """Deletes a judge cache; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def override(items: DataFrame, key: str = "name", rank: str = "path_rank") -> DataFrame:
    """One item of each name: that of the path given last."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(rank)))
    return items.withColumn("__n", last).where("__n = 1").drop("__n")


def read_catalogue(spark: SparkSession, folders: list[str], pattern: str = "*.md") -> DataFrame:
    """Skills or tools of Markdown files with front matter: name, description, tags, body, origin; later folders override earlier ones by name.

    The description defaults to the first 200 characters of the body.
    """
    out = None
    for rank, folder in enumerate(folders):
        files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
        front, body = front_matter(F.col("value"))
        name = F.coalesce(F.nullif(_unquoted(_field(front, "name")), F.lit("")), _stem(F.col("_metadata.file_path")))
        text = tx.strip(body)
        description = F.coalesce(F.nullif(_unquoted(_field(front, "description")), F.lit("")), F.substring(text, 1, 200))
        one = files.select(name.alias("name"), description.alias("description"), tag_list(front).alias("tags"), text.alias("body"), F.lit(folder).alias("origin"), F.lit(rank).alias("path_rank"))
        out = one if out is None else out.union(one)
    return override(out).drop("path_rank")


def listed_tools(folder: str) -> list[str] | None:
    """The folders named in a _registry.yaml (or .json) of tools, entries being names or {path or name}; None where there is no such list. A list for people, so read on the driver; an unreadable one names nothing."""
    for name in ("_registry.yaml", "_registry.json"):
        path = Path(folder) / name
        if not path.exists():
            continue
        try:
            if name.endswith("yaml"):
                import yaml

                entries = (yaml.safe_load(path.read_text()) or {}).get("tools") or []
            else:
                entries = json.loads(path.read_text()).get("tools") or []
        except Exception:
            return []
        return [e if isinstance(e, str) else e.get("path") or e.get("name") or "" for e in entries if isinstance(e, (str, dict))]
    return None


def read_tools(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue with one folder for each tool (meta.md in it): those of its list (see listed_tools), else all whose name does not start with _. Of tools with one name the last counts."""
    listed = listed_tools(folder)
    here = [f for f in listed or [] if (Path(folder) / f / "meta.md").exists()]
    if listed is not None and not here:
        return spark.createDataFrame([], "name string, description string, runtime string, tags array<string>")
    files = spark.read.text([f"{folder}/{f}/meta.md" for f in dict.fromkeys(here)] if here else f"{folder}/[!_]*/meta.md", wholetext=True)
    front, body = front_matter(F.col("value"))
    home = F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -2)
    place = F.array_position(F.array(*map(F.lit, here)), home) if here else F.lit(0)
    text = tx.strip(body)
    found = files.select(
        F.coalesce(F.nullif(_unquoted(_field(front, "name")), F.lit("")), home).alias("name"),
        F.coalesce(F.nullif(_unquoted(_field(front, "description")), F.lit("")), F.substring(text, 1, 200)).alias("description"),
        F.coalesce(F.nullif(_unquoted(_field(front, "runtime")), F.lit("")), F.lit("python")).alias("runtime"),
        tag_list(front, False).alias("tags"),
        F.struct(place.alias("place"), home.alias("home")).alias("path_rank"),
    )
    return override(found).drop("path_rank")
