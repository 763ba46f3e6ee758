"""Operator 5, secret scan: guess cost of the values in credential context.

A value stands in credential context when a credential word (password, token, api_key, ...; also as
the end of a camel-case name and with a number behind) and an assignment sign come before it. Its guess cost is the cheapest way to write it as a chain of
dictionary words (with case and look-alike variants), dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming over its positions. Values that cost at least
min_log10 are secrets; cheaper ones are words, placeholders or masks and are left alone. References
(${NAME}, <name>, {{name}}, $NAME, %NAME%, [NAME]) are no values. What ends a sentence behind a bare word of letters after
another word than a password's ("the key: understanding.") is not part of the value.

The dictionary is ranked: the built-in list of frequent passwords, then the whole words of public BPE vocabularies in the
order of their merges, which is about that of their frequency. Their paths are a parameter; the driver reads them and
broadcasts their bytes, whose size does not depend on the corpus.

Costs are decimal logarithms of guesses and add up along the chain; each part but the first adds
JOIN for where the parts meet. A span of the value may be
- a word: its rank in the list, times 2 for a capital or capitals only, times the number of case
  patterns else, times 2 for each kind of look-alike used, times 2 if reversed;
- a date: 365 a year from the given one (this year), at least 20 years, times 4 with separators;
- a repeat of a block of at most 256: the cheapest cost of the block, times the number of repeats; it
  starts within the first period of its maximal periodic run;
- a walk over neighbouring keys: 47 starts, times 4 for each turn, times its length; it starts where
  its maximal run does;
- brute force: the size of the character class (10, 26, 52, 62, 95) a character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from math import comb, log10

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import bpe
from lexforge.llm.common import documents, scan_texts

MIN_LOG10, JOIN, MAX_BLOCK, LONGEST_WORD = 7.0, 0.5, 256, 24
VOCABULARIES = (bpe.VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
KEYWORDS = r"(?:pass(?:word|wd|phrase|code)?|pwd|passwort|contrase(?:ñ|n)a|secret|token|credentials?|auth|bearer|authorization|private[_-]?key(?:[_-]?id)?|(?:api|access|secret|auth|client|account|encryption)[_-]?(?:key(?:[_-]?id)?|token|secret|id)|key(?:[_-]?id)?)(?:[_-]?[0-9]+)?"
CONTEXT = re.compile(r"(?i)(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?P<word>(?:[a-z0-9]+[_-])*" + KEYWORDS + r")[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}(?:(?:bearer|basic|token)\s+)?(?:\"(?P<dq>[^\"\n]+)\"|'(?P<sq>[^'\n]+)'|(?P<bare>[^\s\"'<>,;|]+))")
REFERENCE = re.compile(r"\$?\{+[^{}]*\}+|\$[A-Za-z_]\w*|<[^<>]*>|%\w+%|\[[A-Z_ ]+\]")
PROSE, PASS = re.compile(r"[^\W\d_]*[.!?)]*"), re.compile(r"(?i)pass|pwd|contrase")
#: All of CONTEXT up to its sign, for RE2: there \s is ASCII only, and i has no dotless or dotted form
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
GATE = "(?i)" + KEYWORDS.replace("i", "[iıİ]") + r"[\"']?" + _BLANK + "{0,3}[:=]"
WORDS = (
    "password 123456 12345678 qwerty abc123 111111 admin letmein welcome monkey dragon master login secret changeme default example test testing user root guest sample "
    "placeholder your yourpassword mypassword pass token apikey key api here insert none null true false xxx todo fixme redacted hidden removed demo dummy foo bar baz "
    "iloveyou sunshine princess football baseball shadow superman batman trustno1 hello freedom whatever michael jordan jennifer hunter ranger buster soccer hockey killer "
    "george andrew charlie thomas robert daniel summer winter spring autumn love money computer internet samsung google amazon service server client database config "
    "production staging development local localhost system manager office company business account access private public security the and for you that with this from have "
    "not are was but all can had her one our out day get has him his how man new now old see two way who boy did its let put say she too use of to in is it on be at by we "
    "der die das und ist nicht mit auf les des est une dans pour que qui los las una con por para hola clave contrasena passwort motdepasse bonjour hallo"
).split()
_LOOKS = {"4": "a", "@": "a", "8": "b", "3": "e", "1": "il", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "9": "g", "2": "z", "|": "l"}
_ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", 'ASDFGHJKL:"'), ("zxcvbnm,./", "ZXCVBNM<>?"))
_KEYS = {c: (y, x + (0, 1.5, 1.75, 2.25)[y]) for y, pair in enumerate(_ROWS) for row in pair for x, c in enumerate(row)}
_DATES = [re.compile(p) for p in (r"(?:19|20)\d\d", r"(?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<d>\d\d)", r"(?P<d>\d\d)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<y>(?:19|20)\d\d|\d\d)")]


def _next_to(a: str, b: str) -> tuple[float, float] | None:
    p, q = _KEYS.get(a), _KEYS.get(b)
    if p and q and a != b:
        step = (q[0] - p[0], q[1] - p[1])
        if abs(step[0]) <= 1 and abs(step[1]) <= 1:
            return step
    return None


def _plain(low: str) -> list[tuple[str, int]]:
    """Readings of a span as letters, with the number of look-alikes replaced."""
    used = {c for c in low if c in _LOOKS}
    if not used:
        return [(low, 0)]
    first = "".join(_LOOKS.get(c, c)[0] for c in low)
    last = "".join(_LOOKS.get(c, c)[-1] for c in low)
    return [(low, 0), (first, len(used)), (last, len(used))]


class Dictionary:
    """Words by rank, and the year from which dates are counted."""

    def __init__(self, words: list[str] | tuple[str, ...] = (), year: int | None = None) -> None:
        self.rank: dict[str, int] = {}
        for w in [*WORDS, *words]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest, self.year = max(map(len, self.rank)), year or date.today().year


@lru_cache(maxsize=2)
def dictionary(vocabularies: tuple[bytes, ...], year: int | None = None) -> Dictionary:
    """The built-in words, then the whole words of vocabularies, of 3 letters and more, by their places there."""
    placed: dict[str, int] = {}
    for raw in vocabularies:
        for place, token in enumerate(bpe.read_ranks(raw)):
            word = token.decode("utf-8", "replace")
            if word[:1] == " " and 3 <= len(word) - 1 <= LONGEST_WORD and word[1:].isalpha():
                placed[word[1:].lower()] = min(place, placed.get(word[1:].lower(), place))
    return Dictionary(sorted(placed, key=lambda w: (placed[w], w)), year)


PLAIN = Dictionary()


def word_cost(s: str, words: Dictionary = PLAIN) -> float | None:
    low, best = s.lower(), None
    up = sum(c.isupper() for c in s)
    letters = sum(c.isalpha() for c in s)
    case = 0.0 if not up else log10(2) if up == letters or (up == 1 and s[0].isupper()) else log10(max(2, sum(comb(letters, k) for k in range(1, min(up, letters - up) + 1))))
    for text, looks in _plain(low):
        for back, w in enumerate((text, text[::-1])):
            rank = words.rank.get(w)
            if rank and (best is None or log10(rank) + (looks + back) * log10(2) + case < best):
                best = log10(rank) + (looks + back) * log10(2) + case
    return best


def date_cost(s: str, year: int = PLAIN.year) -> float | None:
    for k, p in enumerate(_DATES):
        m = p.fullmatch(s)
        if not m:
            continue
        if k == 0:
            return log10(max(20, abs(int(s) - year)))
        d, mo, y = int(m["d"]), int(m["m"]), int(m["y"])
        if k == 2 and mo > 12:
            d, mo = mo, d
        if not (1 <= d <= 31 and 1 <= mo <= 12):
            continue
        y = y if y > 99 else 1900 + y + 100 * (y < 50)
        return log10(365 * max(20, abs(y - year))) + (log10(4) if m["s"] else 0)
    return None


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isascii() and c.isalpha() else log10(33) if c.isascii() else log10(100)


def walks(s: str) -> tuple[list[int], list[int]]:
    """For each position the start of the longest keyboard walk that ends there, and the number of turns up to it."""
    start, turns, was = [0] * len(s), [0] * len(s), None
    for i in range(1, len(s)):
        step = _next_to(s[i - 1], s[i])
        if step is None:
            start[i], turns[i] = i, turns[i - 1]
        else:
            start[i] = start[i - 1]
            turns[i] = turns[i - 1] + (start[i] < i - 1 and step != was)
        was = step
    return start, turns


def _periods(s: str) -> list[tuple[int, int, int]]:
    """Maximal periodic runs (start, end, period) with a period of at most MAX_BLOCK and at least two, for one character three, full turns."""
    a, out = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32), []
    for p in range(1, min(MAX_BLOCK, len(s) // 2) + 1):
        same = np.r_[False, a[p:] == a[:-p], False].astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo >= p * (2 if p == 1 else 1):
                out.append((lo, hi + p, p))
    return out


def guess_log10(value: str, words: Dictionary = PLAIN) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation; 0 for an empty value."""
    n = len(value)
    if not n:
        return 0.0
    opening: dict[int, list[tuple[int, int, int]]] = {}
    live: list[tuple[int, int, int]] = []
    for run in _periods(value):
        opening.setdefault(run[0] + run[2] * (3 if run[2] == 1 else 2), []).append(run)
    blocks: dict[str, float] = {}

    def block_cost(s: str) -> float:
        if s not in blocks:
            blocks[s] = char_cost(s) if len(s) == 1 else guess_log10(s, words)
        return blocks[s]

    walk, turns = walks(value)
    best, brute = [0.0] + [1e300] * n, [1e300] * (n + 1)
    for j in range(1, n + 1):
        # a brute-force span goes on at the price of its next character, or starts after any other part
        c = char_cost(value[j - 1])
        brute[j] = min(brute[j - 1] + c, best[j - 1] + c + (JOIN if j > 1 else 0))
        low = brute[j]
        for i in range(max(0, j - max(words.longest, 10)), j):
            before = best[i] + (JOIN if i else 0)
            if before >= low:
                continue
            span = value[i:j]
            for cost in (word_cost(span, words) if len(span) > 1 else None, date_cost(span, words.year) if 4 <= len(span) <= 10 else None):
                if cost is not None and before + cost < low:
                    low = before + cost
        live = [run for run in live if run[1] >= j] + opening.get(j, [])
        for lo, _, p in live:
            i = lo + (j - lo) % p
            if j - i >= p * (3 if p == 1 else 2):
                low = min(low, best[i] + (JOIN if i else 0) + block_cost(value[i : i + p]) + log10((j - i) // p))
        i = walk[j - 1]
        if j - i >= 3:
            low = min(low, best[i] + (JOIN if i else 0) + log10(47) + (turns[j - 1] - turns[i]) * log10(4) + log10(j - i))
        best[j] = low
    return best[n]


def findings(text: str, min_log10: float = MIN_LOG10, words: Dictionary = PLAIN) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, credential word, log10 of guesses, is a secret) of each value in credential context, in order."""
    out = []
    for m in CONTEXT.finditer(text):
        kind = m.lastgroup
        value = m[kind]
        if REFERENCE.fullmatch(value):
            continue
        if kind == "bare" and not PASS.search(m["word"]) and PROSE.fullmatch(value):
            value = value.rstrip(".!?)")
        cost = guess_log10(value, words)
        out.append((m.start(kind), m.start(kind) + len(value), m["word"].lower(), round(cost, 6), cost >= min_log10))
    return out


def _shared(docs: DataFrame, vocabularies: tuple[str, ...], year: int | None) -> Callable[[], Dictionary]:
    """The dictionary, made once in each worker from the vocabularies' bytes."""
    raw, year = docs.sparkSession.sparkContext.broadcast(tuple(map(bpe._raw, vocabularies))), year or date.today().year
    return lambda: dictionary(raw.value, year)


def secret_values(docs: DataFrame, min_log10: float = MIN_LOG10, vocabularies: tuple[str, ...] = VOCABULARIES, year: int | None = None) -> DataFrame:
    """One row for each value in credential context: doc_id, start, end (in characters), keyword, length, guesses_log10, is_secret. The value itself is not given.

    Null and empty texts have none; rows that repeat a doc_id are each scanned; a null doc_id is
    kept; an empty table gives an empty table. Values of any length are taken whole.
    """
    words = _shared(docs, vocabularies, year)

    def scan(texts: list[str | None]) -> list[list]:
        return [[None if t is None else findings(t, min_log10, words()) for t in texts], [None] * len(texts)]

    kind = "array<struct<start:int,end:int,keyword:string,guesses_log10:double,is_secret:boolean>>"
    found = scan_texts(docs.select("doc_id", "text"), f"__lx_found {kind}, text string", scan, GATE)
    return found.select("doc_id", F.explode("__lx_found").alias("f")).select("doc_id", "f.start", "f.end", "f.keyword", (F.col("f.end") - F.col("f.start")).alias("length"), "f.guesses_log10", "f.is_secret")


def mask_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, mask: str = "[SECRET]", vocabularies: tuple[str, ...] = VOCABULARIES, year: int | None = None) -> DataFrame:
    """docs with each secret value replaced by mask, n_chars (if there) of the new text; no row goes. Null, empty and repeated rows as in secret_values."""
    words = _shared(docs, vocabularies, year)

    def scan(texts: list[str | None]) -> list[list]:
        out = []
        for t in texts:
            for start, end, _, _, secret in reversed(findings(t, min_log10, words()) if t is not None else []):
                if secret:
                    t = t[:start] + mask + t[end:]
            out.append(t)
        return [out]

    names = docs.columns
    if "n_chars" not in names:
        return scan_texts(docs, "text string", scan, GATE)
    out = scan_texts(docs.withColumn("__lx_old", F.xxhash64("text")), "text string", scan, GATE)
    n = F.when(F.xxhash64("text") == F.col("__lx_old"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_values(documents(spark, sf_dir))
