import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


def table(spark, rows, extra=""):
    """Rows (doc_id, text) or longer ones as documents."""
    full = [(*r, "en", "s", len(r[1]) if r[1] is not None else None) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, SCHEMA + extra)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names might clash."""
    rows = [(1, "plain words here", "en", "s", 16), (1, "plain words here", "en", "s", 16), (2, None, None, None, None), (3, "", "en", "", 0), (None, "no id at all", "en", "s", 12), (4, "word " * 60_000, "en", "s", 300_000), (5, " \n\t ", "de", "s", 4)]
    return spark.createDataFrame([(*r, k, "x", k) for k, r in enumerate(rows)], SCHEMA + ", version int, host string, node int")
