"""Plug-ins by name: chunkers (Column -> array of fragments) and retrieval strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx
from lexforge.operators import chunking
from lexforge.operators.index import Encoder, with_unit_vectors

Chunker = Callable[..., Column]
_CHUNKERS: dict[str, Chunker] = {}
_STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def register_chunker(name: str) -> Callable[[Chunker], Chunker]:
    def put(f: Chunker) -> Chunker:
        _CHUNKERS[name] = f
        return f

    return put


def get_chunker(name: str) -> Chunker:
    if name not in _CHUNKERS:
        raise KeyError(f"no chunker {name!r}; there are {', '.join(list_chunkers())}")
    return _CHUNKERS[name]


def list_chunkers() -> list[str]:
    return sorted(_CHUNKERS)


def register_strategy(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _STRATEGIES[name] = f
        return f

    return put


def get_strategy(name: str) -> Callable[..., DataFrame]:
    if name not in _STRATEGIES:
        raise KeyError(f"no strategy {name!r}; there are {', '.join(sorted(_STRATEGIES))}")
    return _STRATEGIES[name]


register_chunker("document")(chunking.document)
register_chunker("naive")(chunking.naive)
register_chunker("paragraphs")(chunking.paragraphs)
register_chunker("sentences")(chunking.sentences)
register_chunker("structural")(lambda text, **o: F.transform(chunking.structural(text, **o), lambda x: x["content"]))


def _one(chunker: Chunker, options: dict) -> Callable[[Column], Column]:
    return lambda fragment: chunker(fragment, **options)


#: Chunkers that compare the vectors of neighbouring units: how they cut a text into units, and units with vectors into struct<fragments, boundaries>
_VECTOR: dict[str, tuple[Chunker, Chunker]] = {}


def register_vector_chunker(name: str, units: Chunker) -> Callable[[Chunker], Chunker]:
    def put(f: Chunker) -> Chunker:
        _VECTOR[name] = (units, f)
        return f

    return put


def _no_index(name: str) -> Chunker:
    def fail(text: Column, **options) -> Column:
        raise RuntimeError(f"{name} needs an encoder")

    return fail


def _unit(text: Column, **options) -> Column:
    return (chunking.paragraphs if options.get("unit", "sentence") == "paragraph" else chunking.sentences)(text)


register_chunker("convolution")(lambda text, **options: _or_whole(text, chunking.paragraphs(text)))  # without an encoder
register_chunker("semantic")(_no_index("semantic"))


def _or_whole(text: Column, parts: Column) -> Column:
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(tx.strip(text)))


@register_vector_chunker("convolution", _unit)
def _convolution(units: Column, vectors: Column, kernel: str = "gaussian", size: int = 5, weights: list[float] | None = None, threshold: float = 0.5, min_chars: int = 30, unit: str = "sentence") -> Column:
    return chunking.let(chunking.convolved(units, vectors, vx.kernel(kernel, size, weights), threshold, min_chars), lambda x: F.struct(x["fragments"].alias("fragments"), x["boundaries"].alias("boundaries")))


@register_vector_chunker("semantic", lambda text, **options: chunking.semantic_sentences(text))
def _semantic(units: Column, vectors: Column, threshold: float = 0.5, min_sentences: int = 1) -> Column:
    return chunking.dropped(units, vectors, threshold, min_sentences)


def _stage(frame: DataFrame, stage: str, options: dict, encoder: Encoder | None) -> DataFrame:
    """frame with its fragments cut further, and pieces: for each fragment its fragments and boundaries (with an encoder)."""
    kind = f"array<struct<fragments:array<string>,boundaries:array<{chunking.BOUNDARY}>>>"
    if encoder is not None and stage in _VECTOR:
        cut, join = _VECTOR[stage]
        units = frame.withColumn("__u", F.transform("fragments", lambda f: cut(f, **options)))
        vectors = with_unit_vectors(units, "__u", "__v", encoder)
        pieces = F.transform(F.arrays_zip("__u", "__v"), lambda x: join(x["__u"], x["__v"], **options))
        out = vectors.withColumn("pieces", pieces.cast(kind)).drop("__u", "__v")
    else:
        one = _one(get_chunker(stage), options)
        out = frame.withColumn("pieces", F.transform("fragments", lambda f: F.struct(one(f).alias("fragments"), F.lit(None).alias("boundaries"))).cast(kind))
    return out


def run(notes: DataFrame, stages: list[tuple[str, dict]], encoder: Encoder | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """note_id, fragments and the columns to keep: the first stage cuts the content, each further one every fragment, in order and without a shuffle.

    Stages that compare vectors take the encoder; without one 'convolution' cuts at blank lines and 'semantic' is an error.
    """
    return with_stages(notes, stages, encoder, keep).select("note_id", "fragments", *keep)


def with_stages(notes: DataFrame, stages: list[tuple[str, dict]], encoder: Encoder | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """note_id, fragments, stages and the columns to keep: for each stage the chunker's name, the fragments it took and made, and its boundaries where it names any.

    Positions of boundaries count from the start of the note's fragments: those of a fragment move by the characters of the fragments made before it.
    """
    frame = notes.select("note_id", *keep, F.array("content").alias("fragments"))
    done = []
    for k, (stage, options) in enumerate(stages):
        cut = _stage(frame, stage, options, encoder)
        made = F.flatten(F.transform("pieces", lambda p: p["fragments"]))
        shift = F.transform("pieces", lambda p: F.aggregate(p["fragments"], F.lit(0), lambda s, f: s + F.length(f)))
        at_once = lambda p, a, i: F.transform(F.coalesce(p["boundaries"], F.array().cast(f"array<{chunking.BOUNDARY}>")), lambda b: F.struct((b["position"] + F.get(a, i)).alias("position"), b["confidence"].alias("confidence"), b["reason"].alias("reason")))
        # let: inside the lambda the sums would be made again for each boundary
        moved = chunking.let(chunking.running(shift), lambda a: F.flatten(F.transform("pieces", lambda p, i: at_once(p, a, i))))
        fact = F.struct(F.lit(stage).alias("chunker"), F.size("fragments").alias("n_input"), F.size("made").alias("n_output"), moved.alias("boundaries"))
        frame = cut.withColumn("made", made).withColumn(f"__s{k}", fact).drop("fragments", "pieces").withColumnRenamed("made", "fragments")
        done.append(f"__s{k}")
    return frame.select("note_id", "fragments", F.array(*done).alias("stages"), *keep)


def name(stages: list[tuple[str, dict]]) -> str:
    one = lambda s, o: f"convolution({o.get('kernel', 'gaussian')},{o.get('size', 5)})" if s == "convolution" else s
    return " → ".join(one(s, o) for s, o in stages)


def boundaries(fragments: Column) -> Column:
    """Where each fragment but the first begins, counted in characters of the fragments before."""
    sizes = F.transform(fragments, lambda f: F.length(f))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"] + n).alias("out")), lambda s: s["out"])
    return F.when(F.size(fragments) > 1, F.slice(ends, 1, F.size(fragments) - 1)).otherwise(F.array().cast("array<int>"))
