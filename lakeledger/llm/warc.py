"""WARC archives with a two-level capture index.

Records are compressed one by one, so each can be read by its byte range. The index holds a line for
each record under the URL's key with the host reversed, sorted, in compressed blocks; each index file
ends with a sparse directory of its blocks. A lookup finds its files by their first keys, searches
the directory for the block and the block for the line, and only then reads the record's range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.common import batches, picked
from lakeledger.runtime import checkpoint, scratch, ship

ship(__name__)

#: Lines of an index block, records for each index file, bytes of an archive file.
BLOCK, FILE_LINES, FILE_BYTES = 256, 500_000, 1 << 28
#: Records that a task of a lookup reads, where all are wanted.
READS = 4_096
#: Payloads shorter than this are always written whole.
SMALLEST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = pa.schema([("key", pa.string()), ("line", pa.string())])
_FILE = pa.schema([("first", pa.string()), ("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("lines", pa.int64())])


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a shared location (``file:``, ``hdfs:``, ``s3:`` ...)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """Host reversed, then port, path and query: ``org,example,www)/a?b``; the fragment is left out.

    A URL that is null, empty or cannot be split keeps its escaped text behind a ``)``.
    """
    text = quote((url or "").strip(), safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"<>\\")
    try:
        u = urlsplit(text)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return ")" + text
    if not host:
        return ")" + text
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(text: str | None) -> int | None:
    found = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return None if found in ("", "none") else int(found)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The URL's key and, behind a blank, the page's number in sortable form."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One compressed record; a revisit holds the response's headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"<>\\"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, full payload length and payload of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, length, payload


@dataclass
class Archive:
    """Index files of an archive by first key; as many as the index has tasks, however many records."""

    spark: SparkSession
    files: list[tuple[str, str, int, int]]
    records: int


def _write_records(date: str, root: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        out, path, at = None, "", 0

        def lines() -> Iterator[tuple[str, str]]:
            nonlocal out, path, at
            for b in parts:
                for page_id, url, html, digest, keep in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # a name of its own for each attempt: only the attempt that counts is indexed
                        path, at = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                    is_revisit = keep is not None and page_id != keep
                    data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, keep, is_revisit, date)
                    out.write(data)
                    key = capture_key(url, page_id)
                    yield key, f"{key}\t{path}\t{at}\t{len(data)}"
                    at += len(data)

        yield from batches(lines(), _CAPTURE, 10_000)
        if out is not None:
            out.close()

    return run


def _write_index(root: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        out, path, first, at, n = None, "", "", 0, 0
        directory: list[str] = []
        held: list[str] = []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(held).encode())
            out.write(data)
            directory.append(f"{held[0].partition(chr(9))[0]}\t{at}\t{len(data)}")
            at += len(data)
            held.clear()

        for b in parts:
            for line in b.column(1).to_pylist():
                if out is None:
                    first = line.partition("\t")[0]
                    path = f"{base}/{uuid.uuid4().hex}.cdx.z"
                    out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                held.append(line)
                n += 1
                if len(held) == BLOCK:
                    flush()
        if out is None:
            return
        if held:
            flush()
        data = zlib.compress("\n".join(directory).encode())
        out.write(data)
        out.close()
        yield from batches([(first, path, at, len(data), n)], _FILE)

    return run


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write every row as a record and index the records, in the shared folder.

    Of rows with equal payloads of ``SMALLEST`` bytes or more the one with the largest id is a
    response and the others revisit it; rows that repeat that id are responses too. Shorter payloads
    and those of groups without an id are responses. Null html is an empty payload.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    fs, base = store(root)
    fs.create_dir(base, recursive=True)
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = picked(pages, page_id=F.col(id_col).cast("bigint"), url=url_col, html=html, digest=F.sha1(html.cast("binary")))
    long = F.octet_length("html") >= SMALLEST
    again = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    again = checkpoint(again.select(F.col("digest").alias("_digest"), "keep"))  # its size known, a small one needs no shuffle of pages
    met = rows.join(again, (rows["digest"] == again["_digest"]) & (F.octet_length(rows["html"]) >= SMALLEST), "left")
    captures = checkpoint(met.select("page_id", "url", "html", "digest", "keep").mapInArrow(_write_records(date, root), "key string, line string"))
    files = max(1, spark.sparkContext.defaultParallelism, -(-captures.count() // FILE_LINES))
    ordered = captures.repartitionByRange(files, "key").sortWithinPartitions("key")
    written = checkpoint(ordered.mapInArrow(_write_index(root), "first string, path string, begin bigint, size bigint, lines bigint"))
    found = [tuple(r) for r in written.orderBy("first").select("first", "path", "begin", "size", "lines").toLocalIterator()]
    return Archive(spark, [f[:4] for f in found], sum(f[4] for f in found))


class Reader:
    """Range reads over the archive's files; the files last used stay open."""

    def __init__(self, root: str):
        self.fs = store(root)[0]
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.block: tuple[str, int] | None = None
        self.lines: list[str] = []

    def range(self, path: str, begin: int, size: int) -> bytes:
        f = self.open.pop(path, None) or self.fs.open_input_file(path)
        self.open[path] = f
        if len(self.open) > 32:
            self.open.popitem(last=False)[1].close()
        f.seek(begin)
        return f.read(size)

    def directory(self, path: str, begin: int, size: int) -> tuple[list[str], list[tuple[int, int]]]:
        """First key and byte range of each block of an index file."""
        rows = [r.split("\t") for r in zlib.decompress(self.range(path, begin, size)).decode().split("\n")]
        return [key for key, _, _ in rows], [(int(at), int(n)) for _, at, n in rows]

    def captures(self, path: str, directory: tuple[list[str], list[tuple[int, int]]], prefix: str) -> Iterator[list[str]]:
        """Index lines of an index file whose key begins with ``prefix``."""
        heads, ranges = directory
        k = max(0, bisect_left(heads, prefix) - 1)
        while k < len(heads) and heads[k][: len(prefix)] <= prefix:
            if self.block != (path, k):
                self.lines = zlib.decompress(self.range(path, *ranges[k])).decode().split("\n")
                self.block = (path, k)
            for line in self.lines[bisect_left(self.lines, prefix) :]:
                if not line.startswith(prefix):
                    return
                yield line.split("\t")
            k += 1


def lookup(archive: Archive, wanted: DataFrame, url_col: str = "url", id_col: str | None = None, payload: bool = True) -> DataFrame:
    """All records of the wanted URLs (of one page each where ``id_col`` is given).

    ``url_key, page_id, record_type, payload_bytes, payload_digest, refers_to, payload``: the
    digest of a response is taken from the bytes read and must agree with its header. A revisit's
    length and digest are those of the payload it stands for, ``payload`` is then null. Wanted rows
    of one key are looked up once, whatever their URLs' text, unknown ones give no row.
    """
    spark, files = archive.spark, archive.files
    root = scratch(spark, "read").rpartition("/")[0]
    schema = "url_key string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    if not files:
        return spark.createDataFrame([], schema)
    firsts = [f[0] for f in files]
    asked = picked(wanted, url=url_col, **({"page_id": F.col(id_col).cast("bigint")} if id_col else {}))
    routes = pa.schema([("file", pa.int32()), ("prefix", pa.string())])

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, str]]:
            for b in parts:
                columns = [c.to_pylist() for c in b.columns]
                for n, url in enumerate(columns[0]):
                    prefix = capture_key(url, columns[1][n]) if id_col else url_key(url) + " "
                    lo, hi = max(0, bisect_left(firsts, prefix) - 1), bisect_right(firsts, prefix + "\U0010ffff")
                    yield from ((f, prefix) for f in range(lo, max(hi, lo + 1)))

        yield from batches(found(), routes, 10_000)

    out = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root)

        def found() -> Iterator[tuple]:
            now, directory = None, None
            for b in parts:
                for f, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    _, path, begin, size = files[f]
                    if f != now:
                        now, directory = f, reader.directory(path, begin, size)
                    for key, where, at, n in reader.captures(path, directory, prefix):
                        fields, length, body = parse(reader.range(where, int(at), int(n)))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        is_revisit = fields["WARC-Type"] == "revisit"
                        if not is_revisit and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
                            raise ValueError(f"{where} at {at}: payload and header differ")
                        yield key.rpartition(" ")[0], _id_of(fields["WARC-Record-ID"]), fields["WARC-Type"], length, digest, _id_of(fields.get("WARC-Refers-To")), body if payload and not is_revisit else None

        yield from batches(found(), out, 512)

    # in key order, so a task meets each block once and a busy URL's pages are spread; URLs may differ and share a key
    routed = asked.mapInArrow(route, "file int, prefix string").dropDuplicates()
    routed = routed.repartitionByRange(-(-archive.records // READS), "file", "prefix").sortWithinPartitions("file", "prefix")
    return routed.mapInArrow(read, schema)
