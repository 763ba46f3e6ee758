import base64
import hashlib
import struct

import zstandard

from lexforge.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file int, frame string")


def test_files_come_back(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    frames = W.records(src, file_bytes=20_000)
    made = {r.file: r for r in W.write_files(frames, f"file://{tmp_path}").collect()}
    assert len(made) > 2
    for r in frames.collect():
        raw = open(made[r.file].path, "rb").read()
        assert raw[r.offset : r.offset + r.length] == bytes(r.frame)
        if r.seq == 0:
            magic, size = struct.unpack("<II", raw[:8])
            assert (magic, r.offset, r.page_id, r.length) == (W.SKIPPABLE, 0, None, size + 8)
        else:  # a record by its offset alone
            size = struct.unpack("<I", raw[4:8])[0]
            one = zstandard.ZstdDecompressor(dict_data=W._dictionary(raw[8 : 8 + size])).decompress(raw[r.offset : r.offset + r.length])
            assert W.parse(one)[0] == r.page_id
    assert {tuple(r) for r in W.read_files(spark, f"file://{tmp_path}").collect()} == {tuple(r) for r in src.select("page_id", "url", "html").collect()}
    assert sorted(map(str, frames.collect())) == sorted(map(str, W.records(src, file_bytes=20_000).collect()))


def test_dictionary_helps(spark):
    html = [r.html.encode() for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    d = W._dictionary(W.train(html))
    small = sum(len(zstandard.ZstdCompressor(dict_data=d).compress(h)) for h in html)
    assert small < 0.9 * sum(len(zstandard.ZstdCompressor().compress(h)) for h in html)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/b c", "<p>é</p>", 0, "f"), (1, "http://a/b c", "<p>é</p>", 0, "f"), (2, None, "x", 1, None), (None, "http://b", "", 2, None), (3, "http://c", None, 3, None), (4, "http://d", "long " * 300_000, 4, None), (5, "", "e", 5, None), (6, "http://e/\r\nX-Page-ID: 9", "f", 6, None)]
    d = pages(spark, rows)
    W.write_files(W.records(d), f"file://{tmp_path}").collect()
    got = sorted(map(str, ((r.page_id, r.url, r.html) for r in W.read_files(spark, f"file://{tmp_path}").collect())))
    assert got == sorted(map(str, ((a, b, c) for a, b, c, *_ in rows)))
    assert W.records(d.limit(0)).count() == 0


def read_alone(raw):
    """A reader that knows the format only: skippable frame, frames, and WARC's own lengths."""
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    text, at = b"", 8 + size
    while at < len(raw):
        one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        text += one.decompress(raw[at:])
        at = len(raw) - len(one.unused_data)
    out, at = [], 0
    while at < len(text):
        assert text.startswith(b"WARC/1.1\r\n", at)
        end = text.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in text[at:end].decode().split("\r\n")[1:])
        block = text[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block) + 4
        assert text[at - 4 : at] == b"\r\n\r\n"
        http, body = block.split(b"\r\n\r\n", 1)
        assert f"Content-Length: {len(body)}".encode() in http
        for name, part in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", body)):
            assert fields[name] == "sha1:" + base64.b32encode(hashlib.sha1(part).digest()).decode()
        out.append((fields, body.decode()))
    return out


def test_an_independent_reader_finds_pages_and_dates(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("*", "case when page_id % 3 > 0 then timestamp'2024-05-06 07:08:09' + make_interval(0, 0, 0, cast(page_id as int)) end date")
    want = {r.page_id: (r.url, r.html, r.date.strftime("%Y-%m-%dT%H:%M:%SZ") if r.date else W.DATE) for r in src.selectExpr("page_id", "url", "html", "cast(date as timestamp_ntz) date").collect()}
    got = {}
    for f in W.write_files(W.records(src, file_bytes=50_000), f"file://{tmp_path}").collect():
        for fields, body in read_alone(open(f.path, "rb").read()):
            got[int(fields["X-Page-ID"])] = (fields["WARC-Target-URI"], body, fields["WARC-Date"])
    assert got == want and len({d for *_, d in got.values()}) > 2


def test_dates():
    assert [W.warc_date(x) for x in (None, "no", "2024-01-02", "2024-01-02T03:04:05+01:00")] == [W.DATE, W.DATE, "2024-01-02T00:00:00Z", "2024-01-02T02:04:05Z"]
