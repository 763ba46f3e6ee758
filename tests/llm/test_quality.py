from lexforge.llm import quality as Q
from tests.compare import from_spark, from_sql
from tests.llm.util import odd, table

DATA = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert from_spark(Q.op2_quality(spark, DATA)) == from_sql(Q.sql(), DATA)


def test_removes_frequent_lines_and_depleted_documents(spark, tmp_path):
    rows = [(k, f"Home  page\nOwn line {k} with some text\nall RIGHTS reserved", "en", "a", 1) for k in range(12)]
    rows += [(50, "home page\nAll rights reserved\nx", "en", "a", 1), (51, "home page\nown", "en", "b", 1), (52, None, "en", "a", 1)]
    rows += [(60 + k, "copied line\nsecond copied line", "en", "c", 1) for k in range(40)]
    d = table(spark, rows)
    got = {r.doc_id: (r.text, r.removed_lines, r.n_chars) for r in Q.drop_frequent_lines(d).collect()}
    assert got[3] == ("Own line 3 with some text", 2, 25) and 50 not in got
    assert got[51] == ("home page\nown", 0, 1) and got[52] == (None, 0, 1)
    assert sum(k >= 60 for k in got) == 40  # copies of one text are one document
    d.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {(r[0], r[1]) for r in c.execute(Q.sql()).fetchall()} == {(k, v[0]) for k, v in got.items()}


def test_odd_rows(spark):
    d = odd(spark)
    out = Q.drop_frequent_lines(d)
    assert out.columns == [*d.columns, "removed_lines"] and out.count() == d.count()
    assert Q.drop_frequent_lines(d.limit(0)).count() == 0


def test_shuffled_way_and_a_clashing_column(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'x' removed_lines", "1 host")
    want = sorted(map(str, Q.drop_frequent_lines(docs).collect()))
    assert sorted(map(str, Q.drop_frequent_lines(docs, broadcast_bytes=-1).collect())) == want
    assert Q.drop_frequent_lines(docs).columns == [*docs.drop("removed_lines").columns, "removed_lines"]
    again = Q.drop_frequent_lines(Q.drop_frequent_lines(docs))
    assert again.columns == [*docs.drop("removed_lines").columns, "removed_lines"] and again.count() <= len(want)
