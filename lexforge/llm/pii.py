"""Operator 3, format-preserving Feistel pseudonyms for personal numbers and dates.

A value is found by its shape, validated (check digits, ranges, calendar), ranked among the valid
values of its format, moved by a keyed Feistel permutation of exactly that set and written back in
its own shape. So a pseudonym is again valid, equal values get equal pseudonyms in every document,
different values different ones, and whoever holds the key can undo it. Values that fail their
validation (a card number with a wrong check digit) are no personal data and stay.

Formats: payment cards (check digit kept valid, separators kept), IBANs (country kept, check
digits valid), US social security numbers, telephone numbers (the E.164 country code and punctuation kept),
IPv4 addresses, calendar dates from 1900 to 2099 (with a time behind too, which stays), and the local
part of e-mail addresses. All shapes of a date share one permutation, which moves dates up to the
12th of a month among themselves and later ones among themselves, so that a date stays linked whether it is
written year, day or month first and no pseudonym can be read in two ways where its value could not.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import documents, scan_texts

ROUNDS = 10
#: Country codes of one and two digits; all others have three
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_FOUND = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?=[A-Za-z0-9-]+\.)[A-Za-z0-9.-]*[A-Za-z]{2})
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<iso>(?<![\w-])\d{4}(?P<a>[-/.])\d{2}(?P=a)\d{2}(?!(?!T\d\d)[\w-]))
    |(?P<dmy>(?<![\w/.-])\d{2}(?P<b>[-/.])\d{2}(?P=b)\d{4}(?![\w-]))
    |(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w])(?!\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:(?![ ]?\d{4}[ -]\d{4}[ -]\d{4})[ .-]?\d{2,4}){1,4}(?!\w)
        |(?<!\w)\(\d{3}\)[ ]?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}(?P<c>[-.])\d{3}(?P=c)\d{4}(?![\w-]))
    |(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<d>[ -])\d{4}(?P=d)\d{4}(?P=d)\d{1,7}|\d{4}(?P<e>[ -])\d{6}(?P=e)\d{5})(?![\w-]))""",
    re.X | re.A,
)


def permute(value: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on Z_a x Z_b with a * b just over size, walked until it lands inside."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def f(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{x}".encode(), key=key[:64], digest_size=24).digest(), "big")

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * f(i, left)) % b
            else:
                left = (left + sign * f(i, right)) % a
        value = left * b + right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    """The check digit that follows body."""
    total = sum(int(x) if k % 2 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n, v = len(d) - 1, int(d[:-1])
    while True:  # a run of one digit is not taken as a card, so neither is it given as one
        v = permute(v, 10**n, "card", key, back)
        body = str(v).zfill(n)
        if len(set(full := body + luhn_digit(body))) > 1:
            return _refill(s, full)


def _iban(s: str, key: bytes, back: bool) -> str | None:
    def check(country: str, bban: str) -> str:
        return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"

    plain = s.replace(" ", "")
    country, bban = plain[:2], plain[4:]
    if len(plain) < 15 or check(country, bban) != plain[2:4]:
        return None
    radix = [10 if c.isdigit() else 26 for c in bban]
    value, size = 0, 1
    for c, r in zip(bban, radix):
        value, size = value * r + (int(c) if r == 10 else ord(c) - 65), size * r
    value, out = permute(value, size, "iban" + country, key, back), ""
    for r in reversed(radix):
        value, x = divmod(value, r)
        out = (str(x) if r == 10 else chr(65 + x)) + out
    it = iter(country + check(country, out) + out)
    return "".join(c if c == " " else next(it) for c in s)


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    v = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    v, serial = divmod(permute(v, 898 * 99 * 9999, "ssn", key, back), 9999)
    area, group = divmod(v, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    code = next(n for n in (1, 2, 3) if n == 3 or d[:n] in _CODES) if s[0] == "+" else 0
    if not 10 - (s[0] == "+") * 2 <= len(d) <= 15:
        return None
    n = len(d) - code
    return _refill(s, d[:code] + str(permute(int(d[code:]), 10**n, "phone" + (d[:code] or "1"), key, back)).zfill(n))


def _ip(s: str, key: bytes, back: bool) -> str | None:
    o = [int(x) for x in s.split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    v = permute(int.from_bytes(bytes(o), "big"), 2**32, "ip", key, back)
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ordinal(y: str, m: str, d: str) -> int | None:
    try:
        n = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return n - FIRST if FIRST <= n <= LAST else None


def _date(n: int, key: bytes, back: bool) -> datetime.date:
    early = datetime.date.fromordinal(FIRST + n).day < 13
    while True:
        n = permute(n, LAST - FIRST + 1, "date", key, back)
        d = datetime.date.fromordinal(FIRST + n)
        if (d.day < 13) == early:
            return d


def _iso(s: str, key: bytes, back: bool) -> str | None:
    n = _ordinal(s[:4], s[5:7], s[8:])
    return None if n is None else _date(n, key, back).strftime(f"%Y{s[4]}%m{s[7]}%d")


def _dmy(s: str, key: bytes, back: bool) -> str | None:
    """Day first where that is a date, else month first."""
    for shape, n in (("%d{}%m{}%Y", _ordinal(s[6:], s[3:5], s[:2])), ("%m{}%d{}%Y", _ordinal(s[6:], s[:2], s[3:5]))):
        if n is not None:
            return _date(n, key, back).strftime(shape.format(s[2], s[5]))
    return None


def _email(s: str, key: bytes, back: bool) -> str:
    local, host = s.rsplit("@", 1)
    value, size, radix = 0, 1, []
    for c in local:
        base = 10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 0
        if base:
            radix.append(base)
            value, size = value * base + (int(c) if base == 10 else ord(c.lower()) - 97), size * base
    value, out = permute(value, size, "email@" + host.lower(), key, back), []
    for base in reversed(radix):
        value, x = divmod(value, base)
        out.append(str(x) if base == 10 else chr(97 + x))
    out = iter(reversed(out))
    return "".join((next(out).upper() if c.isupper() else next(out)) if c.isascii() and c.isalnum() else c for c in local) + "@" + host


_LAST = re.compile(r"(.*\w)[ .-]+\w+\)?\Z", re.S)
_KINDS = {"email": _email, "iban": _iban, "iso": _iso, "dmy": _dmy, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with pseudonyms (or, with back, the values again) and the number of values changed."""
    count = 0

    def put(m: re.Match) -> str:
        nonlocal count
        value, change = m[0], _KINDS[m.lastgroup]
        new = change(value, key, back)
        while new is None and m.lastgroup in ("iban", "phone") and (cut := _LAST.match(value)):
            value = cut[1]  # the last group may belong to what follows
            new = change(value, key, back)
        if new is None:
            return m[0]
        rest, more = pseudonymise(m[0][len(value) :], key, back) if value != m[0] else ("", 0)
        count += 1 + more
        return new + rest

    return _FOUND.sub(put, text), count


def with_pseudonyms(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with pseudonyms in text, n_chars (if there) of the new text, and n_pseudonyms.

    Null and empty texts stay and count 0; ids don't matter, so null and repeated ids are kept
    row by row. A column n_pseudonyms of docs is replaced; an empty table gives an empty table.
    """

    def scan(texts: list[str | None]) -> list[list]:
        done = [(t, 0) if t is None else pseudonymise(t, key, back) for t in texts]
        return [[t for t, _ in done], [n for _, n in done]]

    out = scan_texts(docs, "text string, n_pseudonyms int", scan, r"[0-9]|@")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pseudonyms") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the session (lexforge.pii.key); the synthetic tables have one of their own."""
    return with_pseudonyms(documents(spark, sf_dir), spark.conf.get("lexforge.pii.key", "synthetic tables").encode())
