"""WARC archives of pages with a two-level capture index.

Writing: every page becomes one record, a gzip member of its own, in archives on the shared storage (one
archive a task and attempt; only archives of tasks that ended are in the returned captures). Payloads
are grouped by SHA-1; of equal ones of at least `revisit_from` bytes the least page_id is a response and
the others revisit it.

Index: captures are range-sorted by reversed-host URL key into compressed blocks. Every index file ends
with its directory: first key, offset and length of each block. The top level has one row an index
file, its first and last key. A lookup binary-searches the top level, then a file's directory,
range-reads and unpacks one block, and range-reads the records that it names.

Defined results: a null html is an empty payload; a null url is the empty URL; a null page_id is kept as
null and is never the page that others revisit while another one is there. Rows with equal ids are
separate records; of equal payloads, all rows with the least id are responses. Ids are longs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoloom.llm.common import shared_dir, stored

#: Bytes of records, and rows of index or keys, that a task works through, about.
TASK_BYTES, TASK_ROWS = 32_000_000, 2_000_000
CAPTURE = "urlkey string, page_id long, url string, archive string, offset long, length long"
BLOCK_LINES = 1_000
#: Rows of the top level that a task may hold; there is one an index file.
MOST_FILES = 1_000_000


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://a.b.org:80/x?q -> org,b,a)/x?q. What is no URL stays as it is."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        port = parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = ",".join(reversed(host.split(".")))
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        place += f":{port}"
    return f"{place}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri_of(url: str | None) -> str:
    return quote(url or "", safe=_SAFE)


def warcinfo(name: str, date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: ecoloom\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Filename: {name.rsplit('/', 1)[-1]}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """The bytes of one WARC/1.1 record, not yet compressed; a revisit also names the URL and date of its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri_of(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {uri_of(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def parsed(data: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": length}


def measured(r: dict) -> tuple[int, str]:
    """Length and digest of a parsed record's payload: of a response from the payload itself, which the
    headers must agree with; of a revisit, which has none, from the headers."""
    length, digest = r["payload_bytes"], r["WARC-Payload-Digest"].removeprefix("sha1:")
    if r["WARC-Type"] == "response":
        found = len(r["payload"]), payload_digest(r["payload"])
        if found != (length, digest):
            raise ValueError(f"{r['WARC-Record-ID']}: payload of {found[0]} bytes, sha1:{found[1]}; the headers say {length}, sha1:{digest}")
    return length, digest


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))


def tasks(spark: SparkSession, rows: int, size: int = 0) -> int:
    """Partitions for so many rows and bytes: by size, and no fewer than the cluster has slots while there are
    rows to share out."""
    return max(1, size // TASK_BYTES, rows // TASK_ROWS, min(rows // 100, spark.sparkContext.defaultParallelism))


_CAPTURE = {"urlkey": pa.string(), "page_id": pa.int64(), "url": pa.string(), "archive": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_READ = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def write(pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives below folder and returns the captures (see CAPTURE)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    firsts = rows.filter(F.col("n") >= revisit_from).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    decided = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("n") >= revisit_from), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            captures = []
            for page, url, text, ref, ref_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out = fs.open_output_stream(path, compression=None)
                    offset = out.write(gzip.compress(warcinfo(name, date), 4, mtime=0))
                member = gzip.compress(record(page, url, text.encode("utf-8", "surrogatepass"), ref, date, ref_url), 4, mtime=0)
                out.write(member)
                captures.append((url_key(url), page, url, name, offset, len(member)))
                offset += len(member)
            if captures:
                yield _batch(captures, _CAPTURE)
        if out is not None:
            out.close()

    return stored(decided.select("page_id", "url", "html", refers.alias("refers_to"), "refers_url").mapInArrow(archive, CAPTURE), "captures")


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index files below folder; returns the top level: file, first, last, tail (bytes of its directory)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset, lines, directory, last = None, f"{folder}/index-{uuid.uuid4().hex}.cdx.gz", 0, [], [], ""

        def flush() -> int:
            data = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode("utf-8", "surrogatepass"), 4, mtime=0)
            out.write(data)
            directory.append((lines[0][0], offset, len(data)))
            lines.clear()
            return len(data)

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in _CAPTURE), strict=True):
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out = fs.open_output_stream(path, compression=None)
                lines.append(line)
                last = line[0]
                if len(lines) == block_lines:
                    offset += flush()
        if out is not None:
            if lines:
                offset += flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first": [directory[0][0]], "last": [last], "tail": [len(tail)]})

    order = ("urlkey", "page_id", "archive", "offset")
    ordered = captures.repartitionByRange(tasks(captures.sparkSession, captures.count()), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(blocks, "file string, first string, last string, tail long"), "index")


class IndexFile:
    """One index file: its directory, and one unpacked block at a time."""

    def __init__(self, name: str, tail: int):
        fs, path = _open(name)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - 8 - tail)
        self.directory = json.loads(zlib.decompress(self.file.read(tail)))
        self.firsts = [d[0] for d in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def find(self, key: str) -> Iterator[list]:
        """All captures of the key, across as many blocks as they fill."""
        block = max(0, bisect_left(self.firsts, key) - 1)
        while block < len(self.directory) and self.firsts[block] <= key:
            if block != self.at:
                _, offset, length = self.directory[block]
                self.file.seek(offset)
                text = gzip.decompress(self.file.read(length)).decode("utf-8", "surrogatepass")
                self.lines = [json.loads(x) for x in text.split("\n")]
                self.keys, self.at = [x[0] for x in self.lines], block
            yield from self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]
            block += 1


def lookup(top: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(urlkey) -> the captures of each distinct key, through both levels of the index."""
    spark = keys.sparkSession
    files = [tuple(r) for r in top.orderBy("first", "last").limit(MOST_FILES + 1).collect()]  # a row an index file
    if len(files) > MOST_FILES:
        raise ValueError("the index has more files than MOST_FILES: write it with fewer partitions")
    shared = spark.sparkContext.broadcast(files)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts = [f[1] for f in shared.value], [f[2] for f in shared.value]
        for pdf in batches:
            hits = [(i, k) for k in pdf["urlkey"] for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pd.DataFrame(hits, columns=["number", "urlkey"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opened, rows = -1, None, []
        for batch in batches:
            for i, key in zip(*(batch.column(c).to_pylist() for c in ("number", "urlkey")), strict=True):
                if i != number:
                    number, opened = i, IndexFile(shared.value[i][0], shared.value[i][3])
                for line in opened.find(key):
                    rows.append(line)
                    if len(rows) == 10_000:  # one key may have any number of captures
                        yield _batch(rows, _CAPTURE)
                        rows = []
        if rows:
            yield _batch(rows, _CAPTURE)

    routed = stored(keys.select("urlkey").distinct().mapInPandas(route, "number int, urlkey string"), "routed-keys")
    n = tasks(spark, routed.count())
    return routed.repartitionByRange(n, "number", "urlkey").sortWithinPartitions("number", "urlkey").mapInArrow(find, CAPTURE)


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls -> urlkey for every row."""

    @F.pandas_udf("string")
    def key(u: pd.Series) -> pd.Series:
        return u.map(url_key, na_action=None)

    return urls.select(key(F.col(url_col)).alias("urlkey"))


def read(captures: DataFrame) -> DataFrame:
    """captures -> page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, by range reads."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    fs, path = _open(archive)
                    name, file = archive, fs.open_input_file(path)
                file.seek(offset)
                r = parsed(gzip.decompress(file.read(length)))
                payload_bytes, digest = measured(r)
                page, ref = r.get("X-Page-ID"), r.get("X-Refers-To-Page")
                rows.append((page and int(page), r["WARC-Target-URI"], r["payload"], payload_bytes, digest, r["WARC-Type"], ref and int(ref)))
                held += len(r["payload"])
                if held > TASK_BYTES:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _READ)

    places = stored(captures.select("archive", "offset", "length"), "places")
    size = places.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    n = tasks(captures.sparkSession, size["n"], int(size["bytes"] or 0))
    ordered = places.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(fetch, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives and index on the shared storage."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes and indexes the pages, then reads every record back through the index."""
    folder = archive_folder(pages.sparkSession)
    captures = write(pages, folder)
    top = index(captures, folder)
    return read(lookup(top, keys_of(pages)))
