"""Chunking operators: text column in, array of fragments (or of sections) out, without a shuffle.

Everything is array arithmetic inside one row: lines and words are split once, cut points are found
by filters and one fold, and fragments are slices. A fold carries only its running total and the
cut points, so it is linear in the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions import vector as vx
from lexforge.operators.index import Encoder, with_unit_vectors

SECTION = "struct<title:string,level:int,body:string>"
BOUNDARY = "struct<position:int,confidence:double,reason:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


let = tx.let


def document(text: Column) -> Column:
    return F.array(tx.strip(text))


def _cuts(weights: Column, limit: int) -> Column:
    """Where greedy filling opens the next group: fold of the weights, a group takes at least one item."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), _none("int").alias("cuts"))

    def step(s: Column, w: Column) -> Column:
        over = (s["used"] + w > limit) & (s["n"] > F.coalesce(F.get(s["cuts"], F.size(s["cuts"]) - 1), F.lit(0)))
        return F.struct(
            F.when(over, w).otherwise(s["used"] + w).cast("long").alias("used"),
            (s["n"] + 1).alias("n"),
            F.when(over, F.array_append(s["cuts"], s["n"])).otherwise(s["cuts"]).alias("cuts"),
        )

    return F.aggregate(weights, start, step, lambda s: s["cuts"])


def _groups(items: Column, cuts: Column) -> Column:
    """Slices of items between cut points."""
    edges = lambda it: F.concat(F.array(F.lit(0)), cuts, F.array(F.size(it)))
    part = lambda it, e, k: F.slice(it, F.get(e, k) + 1, F.get(e, k + 1) - F.get(e, k))
    return let(items, lambda it: let(edges(it), lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: part(it, e, k))))


def greedy(items: Column, weight: Callable[[Column], Column], limit: int, glue: str) -> Column:
    joined = lambda it: F.transform(_groups(it, _cuts(F.transform(it, lambda x: weight(x).cast("long")), limit)), lambda g: F.array_join(g, glue))
    return let(items, lambda it: F.when(F.size(it) > 0, joined(it)).otherwise(_none("string")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def naive(text: Column, max_tokens: int = 512) -> Column:
    """Words filled up to four characters a token, each with its blank; a longer word stands alone. One pass of a regular expression over the blank-normalised text."""
    line = F.concat(tx.strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(" "))
    pattern = rf"(.{{1,{max_tokens * 4 - 1}}}|[^ ]+) "
    return F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda f: f != "")


def naive_boundaries(text: Column, max_tokens: int = 512) -> Column:
    """Number of the word that opens each further fragment."""
    sizes = F.transform(naive(text, max_tokens), lambda f: F.size(F.split(f, " ")))
    start = F.struct(F.lit(0).alias("at"), _none("int").alias("out"))
    ends = F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"] + n).alias("out")), lambda s: s["out"])
    return let(ends, lambda e: F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))))


def sentences(text: Column) -> Column:
    return _units(F.split(text, r"(?U)(?<=[.!?])\s+"))


def paragraphs(text: Column) -> Column:
    return _units(F.split(text, "\n\n"))


def semantic_sentences(text: Column) -> Column:
    return _units(F.split(tx.strip(text), r"(?U)(?<=[.?!])\s+|\n+"))


def _units(parts: Column) -> Column:
    return F.filter(F.transform(parts, tx.strip), lambda u: u != "")


_HEADER = r"(?U)^#{2,3}\s+.+$"


def sections(text: Column) -> Column:
    """array<struct<title, level, body>> of a Markdown text.

    Events are fence lines, and outside fences rules and headers of level 2 and 3. What stands between two
    events is a section if it has a line: named by the header before it, 'continuacion' after a rule
    or a fence, 'introduccion' at the top; between an opening and a closing fence it is code, even
    without a line. A header without lines, and a fence that is not closed, are lost.
    """
    fenced = lambda line: line.startswith("```")
    numbers = lambda lines: F.sequence(F.lit(0), F.size(lines) - 1)

    def events(lines: Column, fences: Column) -> Column:
        def marks(i: Column) -> Column:
            line = F.get(lines, i)
            rule = tx.strip(line).isin("---", "***", "___")
            return fenced(line) | ((rule | line.rlike(_HEADER)) & (F.size(F.filter(fences, lambda f: f < i)) % 2 == 0))

        return F.filter(numbers(lines), marks)

    def section(lines: Column, fences: Column, a: Column, b: Column) -> Column:
        line = F.when(a >= 0, F.get(lines, a))
        fence = F.coalesce(fenced(line), F.lit(False))
        opened = fence & (F.size(F.filter(fences, lambda f: f < a)) % 2 == 0)
        header = F.coalesce(line.rlike(_HEADER), F.lit(False)) & ~fence
        language = tx.strip(F.substring(line, 4, 1 << 30))
        title = (
            F.when(a < 0, F.lit("introduccion"))
            .when(opened, F.when(language == "", F.lit("codigo")).otherwise(F.concat(F.lit("codigo "), language)))
            .when(header, tx.strip(F.regexp_replace(line, r"(?U)^#{2,3}\s+", "")))
            .otherwise(F.lit("continuacion"))
        )
        level = F.when(header, F.when(line.startswith("###"), F.lit(3)).otherwise(F.lit(2))).otherwise(F.lit(0))
        body = F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")
        real = F.when(opened, b < F.size(lines)).otherwise(b - a > 1)
        return F.struct(title.alias("title"), level.cast("int").alias("level"), body.alias("body"), real.alias("real"))

    def cut(lines: Column, fences: Column, edges: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: section(lines, fences, F.get(edges, k), F.get(edges, k + 1))), lambda s: s["real"])

    def all_edges(lines: Column, fences: Column) -> Column:
        return F.concat(F.array(F.lit(-1)), events(lines, fences), F.array(F.size(lines)))

    found = let(
        F.split(text, "\n", -1),
        lambda lines: let(
            F.filter(numbers(lines), lambda i: fenced(F.get(lines, i))),
            lambda fences: let(all_edges(lines, fences), lambda edges: cut(lines, fences, edges)),
        ),
    )
    plain = F.transform(found, lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["body"].alias("body")))
    empty = F.array(F.struct(F.lit("introduccion").alias("title"), F.lit(0).alias("level"), F.lit("").alias("body")))
    return F.when(tx.strip(text) == "", empty).otherwise(plain).cast(f"array<{SECTION}>")


def _families(s: Column) -> Column:
    """Each section with the end of its run of level-3 followers, whether a level-2 section leads it, and the merged body."""

    def one(s: Column, others: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.filter(others, lambda j: j > i), F.lit(0)), F.size(s))
        before = F.filter(others, lambda j: j < i)
        below = F.transform(F.slice(s, i + 2, end - i - 1), lambda c: F.concat(F.lit("\n\n### "), c["title"], F.lit("\n"), c["body"]))
        lead = F.get(before, F.size(before) - 1)
        led = (F.get(s, i)["level"] == 3) & F.coalesce(F.get(s, lead)["level"] == 2, F.lit(False))
        x = F.get(s, i)
        return F.struct(
            x["title"].alias("title"), x["level"].alias("level"), x["body"].alias("body"), i.alias("i"), end.alias("end"),
            led.alias("led"), F.coalesce(lead, F.lit(-1)).alias("lead"), F.concat(x["body"], F.array_join(below, "")).alias("merged"),
        )

    def numbers(s: Column) -> Column:
        return F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(_none("int"))

    return let(s, lambda s: let(F.filter(numbers(s), lambda j: F.get(s, j)["level"] != 3), lambda others: F.transform(numbers(s), lambda i: one(s, others, i))))


def _refined(fam: DataFrame, encoder: Encoder, max_tokens: int, window_tokens: int, stride_tokens: int, threshold: float) -> DataFrame:
    """fam with those parts of __b that are over max_tokens split where the vectors of their windows differ, all in its row."""
    window, stride = window_tokens * 4, stride_tokens * 4
    long = lambda f: tx.token_estimate(f) > max_tokens
    windows = lambda f: F.when(long(f) & (F.length(f) >= window), sliding_windows(f, window, stride)).otherwise(_none("string"))
    flat = fam.withColumn("__f", F.flatten(F.col("__b.parts"))).withColumn("__w", F.transform("__f", windows))
    split = with_unit_vectors(flat, "__w", "__v", encoder).withColumn("__r", F.transform(F.arrays_zip("__f", "__v"), lambda x: split_windows(x["__f"], x["__v"], stride, threshold)))
    first = split.withColumn("__at", running(F.transform("__b", lambda b: F.size(b["parts"]))))
    own = lambda b, i: F.flatten(F.slice("__r", F.get("__at", i) + 1, F.size(b["parts"])))
    return first.withColumn("__b", F.transform("__b", lambda b, i: F.struct(b["title"].alias("title"), own(b, i).alias("parts")))).drop("__f", "__w", "__v", "__r", "__at")


def section_chunks(docs: DataFrame, max_tokens: int = 512, encoder: Encoder | None = None, window_tokens: int = 200, stride_tokens: int = 50, threshold: float = 0.5) -> DataFrame:
    """note_id, chunk_id, title, content, order, content_hash: Markdown sections as chunks.

    A level-2 section takes in its level-3 followers if all of it fits; else each stands for itself.
    What is too long is cut at blank lines (with an encoder, paragraphs over max_tokens also where the vectors of their sliding
    windows differ) and filled greedily ('title (parte n)'). Sections without
    text are left out; a note without any gets one empty chunk. Chunk ids are note::slug, so titles
    that repeat in a note share an id.
    """
    fam = docs.withColumn("__s", _families(sections(F.col("content"))))
    fits = lambda c: tx.token_estimate(c) <= max_tokens
    merges = lambda x: (x["level"] == 2) & (x["end"] > x["i"] + 1) & fits(x["merged"])

    def alive(x: Column) -> Column:
        lead = F.get(F.col("__s"), x["lead"])
        swallowed = x["led"] & (merges(lead) | (tx.strip(lead["merged"]) == ""))
        return ~F.coalesce(swallowed, F.lit(False)) & (tx.strip(F.when(merges(x), x["merged"]).otherwise(x["body"])) != "")

    def part(title: Column, cut: Column, p: Column, k: Column) -> Column:
        name = F.when(F.size(cut) > 1, F.concat(title, F.lit(" (parte "), (k + 1).cast("string"), F.lit(")"))).otherwise(title)
        return F.struct(name.alias("title"), p.alias("content"))

    def paras(x: Column) -> Column:
        body = F.when(merges(x), x["merged"]).otherwise(x["body"])
        return let(body, lambda b: F.struct(x["title"].alias("title"), F.when(fits(b), F.array(b)).otherwise(F.split(b, "\n\n", -1)).alias("parts")))

    def pieces(x: Column) -> Column:
        return let(greedy(x["parts"], tx.token_estimate, max_tokens, "\n\n"), lambda cut: F.transform(cut, lambda p, k: part(x["title"], cut, p, k)))

    fam = fam.withColumn("__b", F.transform(F.filter("__s", alive), paras))
    if encoder is not None:
        fam = _refined(fam, encoder, max_tokens, window_tokens, stride_tokens, threshold)
    fam = fam.withColumn("__p", F.flatten(F.transform("__b", pieces)))
    parts = F.col("__p")
    empty = F.array(F.struct(F.lit("introduccion").alias("title"), F.lit("").alias("content")))
    out = fam.select("note_id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(empty)).alias("order", "c"))
    content = tx.strip(F.col("c.content"))
    return out.select("note_id", F.concat_ws("::", "note_id", tx.slugify(F.col("c.title"))).alias("chunk_id"), F.col("c.title").alias("title"), content.alias("content"), "order", tx.content_hash(content).alias("content_hash"))


def structural(text: Column, max_tokens: int = 512, min_chars: int = 20) -> Column:
    """array<struct<content, level, title>>: level-2 sections always with their level-3 followers, cut at blank lines if too long; short fragments dropped."""
    def cut(body: Column, paras: Column) -> Column:
        short = (tx.token_estimate(body) <= max_tokens) | (F.size(paras) == 0)
        return F.when(short, F.array(tx.strip(body))).otherwise(greedy(paras, tx.token_estimate, max_tokens, "\n\n"))

    def pieces(x: Column) -> Column:
        body = F.when(x["level"] == 2, x["merged"]).otherwise(x["body"])
        kept = let(body, lambda b: F.filter(let(paragraphs(b), lambda p: cut(b, p)), lambda p: F.length(p) >= min_chars))
        return F.when(tx.strip(body) == "", _none("struct<content:string,level:int,title:string>")).otherwise(
            F.transform(kept, lambda p: F.struct(p.alias("content"), x["level"].alias("level"), x["title"].alias("title")))
        )

    def filled(s: Column, found: Column) -> Column:
        first = F.coalesce(F.get(s, F.lit(0))["body"], F.lit(""))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(first.alias("content"), F.lit(-1).alias("level"), F.lit("").alias("title"))))

    return let(_families(sections(text)), lambda s: let(F.flatten(F.transform(F.filter(s, lambda x: ~x["led"]), pieces)), lambda found: filled(s, found)))


def structural_confidence(level: Column) -> Column:
    return F.when(level == 2, 0.9).when(level == 3, 0.8).otherwise(0.5)


def simple(docs: DataFrame) -> DataFrame:
    """note_id, chunk_id, title, content, order: one chunk for each header of level 2 or 3; the order counts empty sections, a note without chunks is one."""
    lines = F.split("content", "\n", -1)
    lines = F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    d = docs.withColumn("__l", lines).withColumn("__n", F.when(F.size("__l") > 0, F.sequence(F.lit(0), F.size("__l") - 1)).otherwise(_none("int")))
    heads = F.filter("__n", lambda i: F.get("__l", i).rlike(r"(?U)^#{2,3}\s+.+$"))
    d = d.withColumn("__e", F.concat(F.array(F.lit(-1)), heads, F.array(F.size("__l"))))

    def section(k: Column) -> Column:
        a, b = F.get("__e", k), F.get("__e", k + 1)
        title = F.when(a < 0, F.lit("introduccion")).otherwise(tx.strip(F.regexp_replace(F.get("__l", a), r"(?U)^#{2,3}\s+", "")))
        return F.struct(title.alias("title"), F.array_join(F.slice("__l", a + 2, b - a - 1), "\n").alias("body"), (b - a > 1).alias("real"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("__e") - 2), section), lambda s: s["real"])
    numbered = F.filter(F.transform(found, lambda s, k: F.struct(s["title"].alias("title"), tx.strip(s["body"]).alias("content"), k.alias("order"))), lambda s: s["content"] != "")
    whole = F.array(F.struct(F.col("note_id").alias("title"), tx.strip(F.col("content")).alias("content"), F.lit(0).alias("order")))
    out = d.select("note_id", F.size(numbered).alias("n"), F.explode(F.when(F.size(numbered) > 0, numbered).otherwise(whole)).alias("c"))
    slug = F.when(F.col("n") == 0, F.lit("contenido")).otherwise(tx.slugify(F.col("c.title")))
    return out.select("note_id", F.concat_ws("::", "note_id", slug).alias("chunk_id"), "c.title", "c.content", "c.order")


def window_breaks(windows: DataFrame, stride_chars: int, threshold: float) -> DataFrame:
    """Cut points (in characters) of each text from the vectors of its sliding windows: note_id, pos, vector -> note_id, breaks."""
    after = F.lead("vector").over(Window.partitionBy("note_id").orderBy("pos"))
    sims = windows.withColumn("after", after).where("after is not null").select("note_id", "pos", vx.cosine(vx.as_double(F.col("vector")), vx.as_double(F.col("after"))).alias("sim"))
    return sims.where(F.col("sim") < threshold).groupBy("note_id").agg(F.array_sort(F.collect_list(((F.col("pos") + 1) * stride_chars).cast("int"))).alias("breaks"))


def sliding_windows(text: Column, window_chars: int, stride_chars: int) -> Column:
    """Windows at every stride up to the end of the text; the last ones may be shorter."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride_chars))).otherwise(_none("int"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(window_chars)))


def split_at(text: Column, breaks: Column) -> Column:
    """Stripped pieces between cut points; the whole text if there are no cut points or nothing is left."""
    edges = F.concat(F.array(F.lit(0)), F.coalesce(breaks, _none("int")), F.array(F.length(text)))
    piece = lambda e, k: F.substring(text, F.get(e, k) + 1, F.greatest(F.get(e, k + 1) - F.get(e, k), F.lit(0)))
    pieces = _units(let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: piece(e, k))))
    return F.when((F.coalesce(F.size(breaks), F.lit(0)) > 0) & (F.size(pieces) > 0), pieces).otherwise(F.array(text))


def split_windows(text: Column, vectors: Column, stride_chars: int, threshold: float) -> Column:
    """Pieces of a text, cut at the start of each sliding window whose cosine with the window before is under threshold."""
    pairs = F.when(F.size(vectors) > 1, F.sequence(F.lit(0), F.size(vectors) - 2)).otherwise(_none("int"))
    far = F.filter(pairs, lambda i: vx.cosine(vx.as_double(F.get(vectors, i)), vx.as_double(F.get(vectors, i + 1))) < threshold)
    return let(F.transform(far, lambda i: (i + 1) * stride_chars), lambda breaks: split_at(text, breaks))


def signals(units: DataFrame) -> DataFrame:
    """note_id, units, signal: similarity of each unit to the next one, from (note_id, pos, unit, vector)."""
    after = F.lead("vector").over(Window.partitionBy("note_id").orderBy("pos"))
    sims = units.withColumn("sim", F.when(after.isNotNull(), vx.dot(vx.as_double(F.col("vector")), vx.as_double(after))))
    # lists of their own: where the units aren't asked for, their text is neither joined nor shuffled
    rows = lambda c: F.array_sort(F.collect_list(F.struct("pos", c)))
    grouped = sims.groupBy("note_id").agg(rows("unit").alias("u"), rows("sim").alias("s"))
    return grouped.select("note_id", F.col("u.unit").alias("units"), F.filter(F.col("s.sim"), lambda x: x.isNotNull()).alias("signal"))


def running(sizes: Column) -> Column:
    """The sum of the sizes before each place."""
    start = F.struct(F.lit(0).alias("at"), _none("int").alias("out"))
    return F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def _at_valleys(units: Column, smoothed: Column, valleys: Column, min_chars: int) -> Column:
    """struct<fragments, boundaries>: units cut after the valleys. A fragment shorter than min_chars joins the one before; the first never does.

    A boundary stands where its fragment begins, counted in characters of the groups before, and is as sure as its valley is deep.
    """

    def boundary(groups: Column, at: Column, i: Column) -> Column:
        depth = F.coalesce(F.get(smoothed, F.get(valleys, F.least(i, F.size(valleys)) - 1)), F.lit(0.5))
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - depth))
        return F.struct(F.get(at, i).alias("position"), sure.alias("confidence"), F.format_string("kernel_valley(depth=%.3f)", depth).alias("reason"))

    def joined(groups: Column, real: Column) -> Column:
        opens = let(real, lambda r: F.filter(r, lambda i: (i == F.get(r, F.lit(0))) | (F.length(F.get(groups, i)) >= min_chars)))
        upto = lambda o, k: F.coalesce(F.get(o, k + 1), F.size(groups))
        text = lambda o, i, k: F.array_join(F.filter(F.slice(groups, i + 1, upto(o, k) - i), lambda g: g != ""), " ")
        at = running(F.transform(groups, lambda g: F.length(g)))
        later = lambda o: F.when(F.size(o) > 1, F.slice(o, 2, F.size(o) - 1)).otherwise(_none("int"))
        return let(
            opens,
            lambda o: F.struct(
                F.transform(o, lambda i, k: text(o, i, k)).alias("fragments"),
                let(at, lambda a: F.transform(later(o), lambda i: boundary(groups, a, i))).cast(f"array<{BOUNDARY}>").alias("boundaries"),
            ),
        )

    groups = F.transform(_groups(units, F.transform(valleys, lambda v: v + 1)), lambda g: tx.strip(F.array_join(g, " ")))
    return let(groups, lambda g: joined(g, F.filter(F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(_none("int")), lambda i: F.get(g, i) != "")))


def _smoothed(signal: Column, weights: list[float], threshold: float, then: Callable[[Column, Column], Column]) -> Column:
    """then(smoothed signal, its valleys that stand between units)."""
    return let(vx.clip(vx.convolve_same(signal, weights)), lambda y: let(F.filter(vx.valleys(y, threshold), lambda i: i < F.size(signal)), lambda v: then(y, v)))


def convolved(units: Column, vectors: Column, weights: list[float], threshold: float = 0.5, min_chars: int = 30) -> Column:
    """struct<signal, smoothed, valleys, fragments, boundaries> of the units of one text and their vectors, inside its row."""
    pairs = F.when(F.size(units) > 1, F.sequence(F.lit(0), F.size(units) - 2)).otherwise(_none("int"))
    signal = F.transform(pairs, lambda i: vx.dot(vx.as_double(F.get(vectors, i)), vx.as_double(F.get(vectors, i + 1))))

    def done(x: Column, y: Column, v: Column, f: Column) -> Column:
        return F.struct(x.alias("signal"), y.alias("smoothed"), v.alias("valleys"), f["fragments"].alias("fragments"), f["boundaries"].alias("boundaries"))

    return let(signal, lambda x: _smoothed(x, weights, threshold, lambda y, v: let(_at_valleys(units, y, v, min_chars), lambda f: done(x, y, v, f))))


def convolution(units: DataFrame, weights: list[float], threshold: float = 0.5, min_chars: int = 30) -> DataFrame:
    """note_id, signal, smoothed, valleys, fragments, boundaries: cuts after the valleys of the smoothed similarity signal."""
    s = signals(units).withColumn("smoothed", vx.clip(vx.convolve_same(F.col("signal"), weights)))
    s = s.withColumn("valleys", F.filter(vx.valleys(F.col("smoothed"), threshold), lambda i: i < F.size("signal")))
    s = s.withColumn("f", _at_valleys(F.col("units"), F.col("smoothed"), F.col("valleys"), min_chars))
    return s.select("note_id", "signal", "smoothed", "valleys", "f.fragments", "f.boundaries")


def _at_drops(units: Column, sims: Column, threshold: float, min_sentences: int) -> Column:
    """struct<fragments, boundaries> of units and the similarity of each to the one before (null for the first)."""
    low = F.transform(sims, lambda x: F.coalesce(x < threshold, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), _none("int").alias("cuts"))

    def step(s: Column, cut: Column) -> Column:
        cuts = cut & (s["open"] >= min_sentences)
        return F.struct((s["n"] + 1).alias("n"), F.when(cuts, F.lit(1)).otherwise(s["open"] + 1).alias("open"), F.when(cuts, F.array_append(s["cuts"], s["n"])).otherwise(s["cuts"]).alias("cuts"))

    def boundary(i: Column) -> Column:
        sim = F.get(sims, i)
        return F.struct((i - 1).alias("position"), (1 - sim).alias("confidence"), F.format_string("semantic_drop(%.2f)", sim).alias("reason"))

    def done(cut: Column) -> Column:
        fragments = F.transform(_groups(units, cut), lambda g: F.array_join(g, " "))
        return F.struct(F.when(F.size(units) > 0, fragments).otherwise(_none("string")).alias("fragments"), F.transform(cut, boundary).cast(f"array<{BOUNDARY}>").alias("boundaries"))

    return let(F.aggregate(low, start, step, lambda s: s["cuts"]), done)


def dropped(units: Column, vectors: Column, threshold: float = 0.5, min_sentences: int = 1) -> Column:
    """struct<fragments, boundaries> of the sentences of one text and their vectors, inside its row: see semantic()."""
    near = lambda i: vx.cosine(vx.as_double(F.get(vectors, i - 1)), vx.as_double(F.get(vectors, i)))
    sims = F.transform(units, lambda u, i: F.when(i > 0, near(i)))
    return let(sims, lambda x: _at_drops(units, x, threshold, min_sentences))


def semantic(units: DataFrame, threshold: float = 0.5, min_sentences: int = 1) -> DataFrame:
    """note_id, fragments, boundaries: a sentence opens a fragment where its cosine with the one before is under the threshold and the open fragment has min_sentences.

    A boundary's position is the number of the sentence before it.
    """
    before = F.lag("vector").over(Window.partitionBy("note_id").orderBy("pos"))
    rows = units.withColumn("sim", F.when(before.isNotNull(), vx.cosine(vx.as_double(before), vx.as_double(F.col("vector")))))
    grouped = rows.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("pos", "unit", "sim"))).alias("r"))
    return grouped.select("note_id", _at_drops(F.col("r.unit"), F.col("r.sim"), threshold, min_sentences).alias("f")).select("note_id", "f.fragments", "f.boundaries")


def concat_signals(fragments: DataFrame) -> DataFrame:
    """One signal for a text from those of its fragments: note_id, frag, n_units, signal, valleys -> note_id, signal, valleys.

    Valleys move by the units of the fragments before, although a fragment's signal is one shorter.
    """
    order = Window.partitionBy("note_id").orderBy("frag")
    moved = fragments.withColumn("off", F.sum("n_units").over(order) - F.col("n_units"))
    rows = F.array_sort(F.collect_list(F.struct("frag", "signal", F.transform("valleys", lambda v: (v + F.col("off")).cast("int")).alias("v"))))
    return moved.groupBy("note_id").agg(rows.alias("r")).select("note_id", F.flatten("r.signal").alias("signal"), F.flatten("r.v").alias("valleys"))


def adapt(fragments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks for the store from note_id, fragments: chunk_id (note::slug-i), title, content, order, and the columns to keep."""
    rows = fragments.select("note_id", *keep, F.posexplode("fragments").alias("order", "content"))
    title = tx.fragment_title(F.col("content"), F.concat(F.col("note_id"), F.lit(" parte "), (F.col("order") + 1).cast("string")))
    # explode() of one element: the title is worked out once, however often it is used behind it
    titled = rows.select("note_id", *keep, "order", "content", F.explode(F.array(title)).alias("title"))
    slug = tx.slugify(F.col("title"), "chunk", collapse=False)
    return titled.select("note_id", F.concat(F.col("note_id"), F.lit("::"), slug, F.lit("-"), F.col("order").cast("string")).alias("chunk_id"), "title", "content", "order", *keep)
