import random

import pytest

from lexforge.llm import pii as P
from tests.llm.util import odd, table

KEY = b"test"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation_is_one_and_is_undone(size):
    moved = [P.permute(k, size, "t", KEY) for k in range(size)]
    assert sorted(moved) == list(range(size))
    assert [P.permute(v, size, "t", KEY, back=True) for v in moved] == list(range(size))
    if size > 90:
        assert moved != [P.permute(k, size, "u", KEY) for k in range(size)]
        assert moved != [P.permute(k, size, "t", key=b"other") for k in range(size)]


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + P.luhn_digit(body)


def test_valid_values_change_and_stay_valid():
    rng = random.Random(3)
    values = [card(rng) for _ in range(40)] + [card(rng, 15)] + [f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}" for _ in range(20)]
    values += ["97.51.17.173", "2020-02-29", "31/12/1999", "12/31/1999", "123-45-6789", "GB82WEST12345698765432", "ana.b7@mail7.example.com", "4111 1111 1111 1111", "1999.12.31", "GB82 WEST 1234 5698 7654 32", "+49 30 1234567", "+44 20 7946 0958"]
    for v in values:
        for text in (f"call {v} now", f"({v})", v):
            new, n = P.pseudonymise(text, KEY)
            assert n == 1 and new != text, text
            assert P.pseudonymise(new, KEY, back=True) == (text, 1)
            assert P.pseudonymise(new, KEY)[1] == 1  # valid again
    assert P.pseudonymise("+49 30 1234567 4845-1681-1440-7329 GB82 WEST 1234 5698 7654 32 THE END", KEY)[1] == 3
    one, two = P.pseudonymise("4111 1111 1111 1111", KEY)[0], P.pseudonymise("4111111111111111", KEY)[0]
    assert one.replace(" ", "") == two  # linked whatever the punctuation


@pytest.mark.parametrize("text", ["9807915762804490", "2021-02-29", "256.1.1.1", "000-12-3456", "GB82WEST12345698765431", "2399-01-01", "version 1.2.3", "a 1234567 b", "0000000000000000", "", "x@y", "45/45/2000"])
def test_what_is_not_valid_stays(text):
    assert P.pseudonymise(text, KEY) == (text, 0)


def test_table_links_documents_and_comes_back(spark):
    rng = random.Random(9)
    c = card(rng)
    d = table(spark, [(1, f"card {c} end"), (2, f"again {c}"), (3, "nothing"), (4, "2020-01-05 and 1.2.3.4")])
    out = P.with_pseudonyms(d, KEY)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text.split()[1] == got[2].text.split()[1] != c and got[3].n_pseudonyms == 0 and got[4].n_pseudonyms == 2
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert {(r.doc_id, r.text) for r in P.with_pseudonyms(out, KEY, back=True).collect()} == {(r.doc_id, r.text) for r in d.collect()}


def test_query_equals_row_by_row(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert {(r.doc_id, r.text, r.n_pseudonyms) for r in P.op3_pii(spark, "/root/testdata/sf0.001").collect()} == {(r.doc_id, *P.pseudonymise(r.text, b"synthetic tables")) for r in d}


def test_odd_rows(spark):
    d = odd(spark)
    out = P.with_pseudonyms(d, KEY)
    assert out.columns == [*d.columns, "n_pseudonyms"] and out.count() == d.count()
    assert P.with_pseudonyms(out, KEY).columns == out.columns and P.with_pseudonyms(d.limit(0), KEY).count() == 0


def test_country_codes_stay():
    for number, code in (("+351 912 345 678", "+351"), ("+971 50 123 4567", "+971"), ("+49 30 1234567", "+49"), ("+1 202 555 0143", "+1"), ("+7 495 123 4567", "+7"), ("+886 2 1234 5678", "+886")):
        new, n = P.pseudonymise(f"call {number} now", KEY)
        assert n == 1 and new.split()[1] == code and number not in new and P.pseudonymise(new, KEY, back=True) == (f"call {number} now", 1)


def test_one_date_stays_one_date_in_every_shape():
    import datetime

    seen = set()
    for k in range(0, 73_000, 97):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(days=k)
        shapes = [f"{d:%Y-%m-%d}", f"{d:%Y.%m.%d}", f"{d:%d/%m/%Y}", f"{d:%Y-%m-%d}T10:00:00Z"] + ([f"{d:%m/%d/%Y}"] if d.day > 12 else [])
        new = [P.pseudonymise(s, KEY) for s in shapes]
        assert all(n == 1 for _, n in new) and new[3][0].endswith("T10:00:00Z")
        y, m, day = new[0][0].split("-")
        assert [t for t, _ in new] == [f"{y}-{m}-{day}", f"{y}.{m}.{day}", f"{day}/{m}/{y}", f"{y}-{m}-{day}T10:00:00Z", f"{m}/{day}/{y}"][: len(shapes)]
        assert [P.pseudonymise(t, KEY, back=True)[0] for t, _ in new] == shapes
        seen.add(new[0][0])
    assert len(seen) == len(range(0, 73_000, 97))


def scan(text):
    """An independent scanner: card numbers and dates found by hand, without the operator's pattern."""
    import datetime

    found = []
    for word in text.replace(",", " ").replace("(", " ").replace(")", " ").split():
        word = word.strip(".;:!?")
        if word.isdigit() and 13 <= len(word) <= 19 and len(set(word)) > 1 and sum(int(c) if (len(word) - i) % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(word)) % 10 == 0:
            found.append(("card", word))
        if len(word) == 10 and word[4] == word[7] == "-" and (word[:4] + word[5:7] + word[8:]).isdigit():
            try:
                if 1900 <= datetime.date.fromisoformat(word).year <= 2099:
                    found.append(("date", word))
            except ValueError:
                pass
    return found


def test_an_independent_scanner_finds_as_much_before_and_after(spark):
    old = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    new = {r.doc_id: r.text for r in P.op3_pii(spark, "/root/testdata/sf0.001").collect()}
    moved = {}
    for d, t in old.items():
        a, b = scan(t), scan(new[d])
        assert [k for k, _ in a] == [k for k, _ in b]
        for (kind, x), (_, y) in zip(a, b):
            assert moved.setdefault((kind, x), y) == y
    assert moved and len({(k, y) for (k, _), y in moved.items()}) == len(moved) and sum(x == y for (_, x), y in moved.items()) < 2
