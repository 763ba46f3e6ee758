"""Operator 8, dictionary-compressed WARC writer and reader.

Pages become WARC/1.1 response records. The records of a file train a Zstandard dictionary, the
file begins with that dictionary in a skippable frame (magic 0x184D2A5D, four bytes of size, the
dictionary itself), and every record follows as a Zstandard frame of its own, so that a reader that
has the leading frame can start at the offset of any record.

A task cuts its part of the pages into files as it reads them: a file is closed when its records reach
file_bytes, so a task holds one file (and at least one page), whatever the pages' sizes, nothing is shuffled, and all
records of a file train its dictionary. A file's number is that of its partition and its place in it. Ids come from
the page, not from the clock, and dates from the page's date column: a task that is run again writes the same bytes.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexforge.llm.common import frugal, small_batches

FILE_BYTES, DICTIONARY_BYTES, LEVEL, DATE = 32 << 20, 64 << 10, 3, "1970-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
SCHEMA = "file long, seq int, page_id long, offset long, length long, frame binary"


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One response record. Null html is an empty body; a null url has no WARC-Target-URI; a url with blanks or control characters is written percent-encoded there, and as it is in X-URL (base64)."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block, sha = http + body, lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha(body)}')}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)
        head.append("WARC-Target-URI: " + safe)
        if safe != url or not url:
            head.append("X-URL: " + base64.b64encode(url.encode()).decode())
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if html is None:
        head.append("X-Null-Body: true")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {sha(block)}", f"WARC-Payload-Digest: {sha(body)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str | None, str | None]:
    """(page_id, url, html) of a record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    body = block.split(b"\r\n\r\n", 1)[1]
    page = fields.get("X-Page-ID")
    url = base64.b64decode(fields["X-URL"]).decode() if "X-URL" in fields else fields.get("WARC-Target-URI")
    return int(page) if page is not None else None, url, None if "X-Null-Body" in fields else body.decode()


def warc_date(value: object) -> str:
    """A date column's value as a WARC date in UTC (a timestamp without a zone counts as UTC); null and what is no date give DATE."""
    if isinstance(value, str):
        try:
            value = datetime.datetime.fromisoformat(value.strip())
        except ValueError:
            return DATE
    if isinstance(value, datetime.datetime):
        if value.tzinfo:
            value = value.astimezone(datetime.timezone.utc)
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    return value.strftime("%Y-%m-%dT00:00:00Z") if isinstance(value, datetime.date) else DATE


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of all records. Too few or too small ones give their own bytes as a content dictionary, so that a file always has one."""
    total = sum(map(len, records))
    try:
        return zstd.train_dictionary(min(size, max(1024, total // 10)), records, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(records)[-size:]


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict:
    return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def open_file(raw: bytes) -> Iterator[bytes]:
    """The records of a whole file."""
    magic, size = struct.unpack("<II", raw[:8])
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstd.ZstdDecompressor(dict_data=_dictionary(raw[8 : 8 + size]))
    rest = raw[8 + size :]
    while rest:
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = one.unused_data


def records(pages: DataFrame, file_bytes: int = FILE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL, date: str | None = "date") -> DataFrame:
    """Every frame of every file: file, seq, page_id, offset, length, frame. seq 0 is the dictionary frame, with a null page_id.

    Frames of a file in the order of seq are the file. Rows that repeat an id are records of their
    own; null ids, urls and html are kept as such; an empty table gives no file. pages needs
    page_id, url and html; date names the column with the date of a page's retrieval, and where pages
    has no such column, or a null in it, the record has the date DATE. Other columns are left out.
    """
    small_batches(pages.sparkSession)
    columns = [pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")]
    dated = date is not None and date in pages.columns
    spec = pages.select(*columns, *([pages[date].alias("date")] if dated else []))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def file() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            dictionary = train([raw for _, raw in held], dictionary_bytes)
            writer = zstd.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
            frames, ids, at, seq = [leading_frame(dictionary)], [None], 0, 0
            names, types = [x.split()[0] for x in SCHEMA.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for page, raw in [*held, (None, None)]:
                if raw is None or len(frames) == 256:
                    sizes = [len(f) for f in frames]
                    places = [at + sum(sizes[:k]) for k in range(len(sizes))]
                    out = [[number] * len(frames), range(seq, seq + len(frames)), ids, places, sizes, frames]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    at, seq, frames, ids = at + sum(sizes), seq + len(frames), [], []
                if raw is not None:
                    frames.append(writer.compress(raw))
                    ids.append(page)
            number, held, size = number + 1, [], 0

        for b in batches:
            for k in range(b.num_rows):
                page, url, html = (b.column(c)[k].as_py() for c in range(3))
                raw = record(page, url, html, warc_date(b.column(3)[k].as_py()) if dated else DATE)
                if held and size + len(raw) > file_bytes:
                    yield from file()
                held.append((page, raw))
                size += len(raw)
        if held:
            yield from file()

    return spec.mapInArrow(run, SCHEMA)


def write_files(frames: DataFrame, folder: str) -> DataFrame:
    """Writes the files of records() to a folder all executors share (any URI pyarrow can open) and returns file, path, records, bytes.

    A file is written under a name of its own attempt and then moved, so a repeated task does no harm.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        number = table.column("file")[0].as_py()
        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base)
        path = f"{base}/part-{number >> 32:06d}-{number & 0xFFFFFFFF:04d}.warc.zst"
        part = f"{path}.{uuid.uuid4().hex}"
        size = 0
        with place.open_output_stream(part) as out:
            for f in table.column("frame"):
                size += out.write(f.as_buffer())
        place.move(part, path)
        return pa.table({"file": pa.array([number], pa.int64()), "path": [path], "records": pa.array([table.num_rows - 1], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return frames.groupBy("file").applyInArrow(run, "file long, path string, records long, bytes long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html of all .warc.zst files of a folder."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [parse(r) for r in open_file(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, T._parse_datatype_string("page_id long, url string, html string"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
