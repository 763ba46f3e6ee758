import random
from math import log10

import pytest

from lexforge.llm import bpe
from lexforge.llm import secrets as S
from tests.llm.util import odd, table

FULL = S.dictionary(tuple(map(bpe._raw, S.VOCABULARIES)))


def brute(value):
    """Every segmentation, priced part by part from the definitions."""
    n = len(value)
    if not n:
        return 0.0
    runs = S._periods(value)
    start, turns = S.walks(value)
    best = [0.0] + [1e300] * n
    for j in range(1, n + 1):
        for i in range(j):
            span, costs = value[i:j], [sum(map(S.char_cost, value[i:j]))]
            costs += [c for c in ((S.word_cost(span) if len(span) > 1 else None), (S.date_cost(span) if 4 <= len(span) <= 10 else None)) if c is not None]
            for lo, hi, p in runs:
                if lo <= i < lo + p and j <= hi and (j - i) % p == 0 and (j - i) // p >= (3 if p == 1 else 2):
                    block = value[i : i + p]
                    costs.append((S.char_cost(block) if p == 1 else brute(block)) + log10((j - i) // p))
            if j - i >= 3 and start[j - 1] == i:
                costs.append(log10(47) + (turns[j - 1] - turns[i]) * log10(4) + log10(j - i))
            best[j] = min(best[j], best[i] + (S.JOIN if i else 0) + min(costs))
    return best[n]


def test_equals_brute_force():
    rng = random.Random(1)
    bits = ["password", "qwe", "1999", "12/03/2001", "aaa", "abab", "x", "9", "$", "P@ss", "zxcv", "drowssap", "é"]
    values = ["".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(120)] + ["".join(rng.choices("ab1$", k=9)) for _ in range(60)]
    for v in values:
        assert abs(S.guess_log10(v) - brute(v)) < 1e-9, v


def test_order_of_strengths():
    weak = ["password", "P4ssw0rd", "letmein123", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "19990412", "changeme", "drowssap"]
    strong = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "xK9#vLp2!qRz", "sk_live_93jfk28fja", "Tr0ub4dour&Zq7w"]
    assert max(map(S.guess_log10, weak)) < S.MIN_LOG10 < min(map(S.guess_log10, strong))
    assert S.guess_log10("") == 0


@pytest.mark.parametrize(("text", "found"), [('token = "f3ef4d6b2755a36d7d9c"', 1), ("API_KEY=sk93jfk28fjaPq", 1), ("db_password: 'hunter'", 0), ("the key: understanding", 0), ("the key: understanding.", 0), ("password: elephant", 0), ("password = understanding", 0), ("token: qzvxkjwprtnmbd", 1), ("secret: qZkVtRwXbNmLpHsG.", 1), ("secret = ${NAME}", 0), ("password=<your password>", 0), ("monkey: f3ef4d6b2755a36d7d9c", 0), ("no credentials here", 0)])
def test_contexts(text, found):
    assert sum(f[4] for f in S.findings(text, words=FULL)) == found


def test_long_values_are_taken_whole():
    rng = random.Random(2)
    long = "".join(rng.choices("abcdef0123456789", k=3000))
    (start, end, _, cost, secret) = S.findings(f'x token = "{long}" y')[0]
    assert end - start == 3000 and secret and cost > 3000


def test_masking(spark):
    d = table(spark, [(1, 'a token = "f3ef4d6b2755a36d7d9c" b'), (2, "pwd: changeme"), (3, "clean")])
    assert {(r.doc_id, r.text, r.n_chars) for r in S.mask_secrets(d).collect()} == {(1, 'a token = "[SECRET]" b', 22), (2, "pwd: changeme", 13), (3, "clean", 5)}


def test_query_equals_row_by_row(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {(r.doc_id, a, b, k, c, s) for r in d for a, b, k, c, s in S.findings(r.text, words=FULL)}
    got = {(r.doc_id, r.start, r.end, r.keyword, r.guesses_log10, r.is_secret) for r in S.op5_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and got


def test_odd_rows(spark):
    d = odd(spark)
    assert S.secret_values(d).count() == 0 and S.mask_secrets(d).columns == d.columns
    assert sorted(map(str, S.mask_secrets(d).collect())) == sorted(map(str, d.collect()))
    assert S.mask_secrets(d.limit(0)).count() == 0 and S.secret_values(d.limit(0)).count() == 0


KINDS = ["api", "access", "secret", "auth", "client", "account", "encryption"]
NAMES = ["pass", "password", "passwd", "passphrase", "passcode", "pwd", "passwort", "contraseña", "contrasena", "secret", "token", "credential", "credentials", "auth", "bearer", "private_key", "private-key", "privatekey", "key"]
NAMES += [k + s + w for k in KINDS for s in ("", "_", "-") for w in ("key", "token", "secret", "id")]


def test_gate_lets_every_context_through(spark):
    value = "9xK2mPq77zLw"
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [n + sign + value for n in NAMES for sign in ("=", ": ", "' := ", '"=>')]
    texts += [n.upper() + b + "= " + value for n in ("client_id", "key") for b in blanks] + ["apı_İd = " + value, "toKen=" + value]
    assert all(S.findings(t) for t in texts)
    d = table(spark, list(enumerate(texts)))
    assert {r.doc_id for r in S.secret_values(d).where("is_secret").collect()} == set(range(len(texts)))
    assert not S.mask_secrets(d).where(f"text like '%{value}%'").count()


@pytest.mark.parametrize("context", ["dbPassword=", "secretAccessKey=", "aws_access_key_id=", "Authorization: Bearer ", "Authorization: Basic ", "authorization: token ", "password2=", "api_key1: ", "clientSecret_2 = ", "private_key_id: ", '"accessKeyId": '])
def test_names_of_contexts(context):
    import pyarrow as pa
    import pyarrow.compute as pc

    text = "x " + context + "9xK2mPq77zLw y"
    assert [(text[a:b], secret) for a, b, _, _, secret in S.findings(text)] == [("9xK2mPq77zLw", True)]
    assert pc.match_substring_regex(pa.array([text]), S.GATE).to_pylist() == [True]


def test_a_bare_word_is_listed_without_what_ends_its_sentence():
    assert [(a, b, s) for a, b, _, _, s in S.findings("the key: understanding.", words=FULL)] == [(9, 22, False)]
    assert len(FULL.rank) > 30_000 and FULL.rank["password"] == 1
    assert S.guess_log10("correcthorsebatterystaple", FULL) > 7 > S.guess_log10("Sunshine1999", FULL)
    long = "".join(random.Random(3).choices("abcdefghij", k=150))
    assert S.guess_log10(long * 3) < S.guess_log10(long) + 1
    assert S.date_cost("2031", 2030) == S.date_cost("2030", 2030) < S.date_cost("1900", 2030)
