"""WARC archives: writing pages as records, and reading archives in byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range, looks for
the gzip magic in it, and takes a place for a member only if what it decodes to starts
with a whole WARC header and has the length the header states. From the first such
member on it follows the chain of members; a record belongs to the range in which it
starts, however far beyond the end it reaches.

Files are opened in the tasks through Arrow's file systems, by URI.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored
from eventloom.session import work_folder

LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 29
RANGE_BYTES = 1 << 25
BATCH_BYTES = 1 << 23
LEVEL = 3
GZIP = 31  # what zlib calls a gzip stream
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 18

# The format's version, header names and record types.
VERSION = b"WARC/1.1"
PAGE_URN = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<{PAGE_URN}{'' if page_id is None else page_id}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One record as a gzip member; a revisit has no payload, only its digest and size."""
    headers = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        headers.append(f"WARC-Refers-To: {_record_id(refers_to)}")
        block += b"\r\n"
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head = VERSION + b"\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``page_id``, ``url``, ``html`` in ``folder``; one row per file: ``path``, ``bytes``.

    Of equal payloads of at least 1000 bytes the one with the largest ``page_id`` is a
    response and the others are revisits of it; a row repeated with that id is a
    response each time. Without any id among them all are responses. A null page is an
    empty payload, a null URL leaves its header out. An empty table gives no files.

    A task names its files anew each time it runs. The table of files is written when
    all tasks are done and lists those of the runs that counted, so that what a lost
    or repeated task left behind is never read.
    """
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    # One row per payload and task is shuffled, however often a payload occurs.
    firsts = (
        known.filter(F.col("size") >= LEAST_REVISIT_BYTES)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    rows = known.join(firsts, ["digest", "size"], "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        paths, sizes, file, name, size = [], [], None, "", 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(
                *(batch.column(i).to_pylist() for i in range(5))
            ):
                if file is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = system.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, url, html.encode(), digest, refers_to)
                file.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    file.close()
                    paths, sizes, file = [*paths, f"{folder}/{name}"], [*sizes, size], None
        if file is not None:
            file.close()
            paths, sizes = [*paths, f"{folder}/{name}"], [*sizes, size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"]
        )

    return stored(rows.mapInArrow(write, "path string, bytes long"), "warc-files")


class Window:
    """A file read forward from any place, with what was read kept until it is passed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""

    def upto(self, size: int) -> bytes:
        """At least ``size`` bytes from the current place, if the file has them."""
        while len(self.data) < size:
            more = self.file.read_at(max(READ, size - len(self.data)), self.at + len(self.data))
            if not more:
                break
            self.data += more
        return self.data

    def skip(self, size: int) -> None:
        self.at, self.data = self.at + size, self.data[size:]


def _member(window: Window) -> tuple[bytes, int] | None:
    """Content and length of the record that starts at the current place, if one does."""
    if window.upto(len(MAGIC))[: len(MAGIC)] != MAGIC:
        return None
    unpacker, content, used = zlib.decompressobj(GZIP), [], 0
    length, checked = 0, False
    try:
        while not unpacker.eof:
            data = window.upto(used + READ)[used : used + READ]
            if not data:
                return None
            content.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            length += len(content[-1])
            if not checked and length >= len(VERSION):
                if not b"".join(content).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    whole = b"".join(content)
    head, end, _ = whole.partition(b"\r\n\r\n")
    stated = _headers(head).get("content-length", "")
    if not end or not stated.isdigit() or len(head) + 8 + int(stated) != len(whole):
        return None
    return whole, used


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the records that start in ``[start, end)``.

    What is no whole record, such as a damaged or cut member, is passed over up to the
    next place where one starts.
    """
    window = Window(file, start)
    while window.at < end:
        found = _member(window)
        if found:
            yield window.at, found[0]
            window.skip(found[1])
            continue
        data = window.upto(READ)
        if not data:
            return
        next_ = data.find(MAGIC, 1)
        # The magic may lie across the end of what has been read.
        window.skip(next_ if next_ > 0 else max(1, len(data) - len(MAGIC) + 1))


_RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("stated_digest", pa.string()),
        ("stated_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _parsed(path: str, offset: int, content: bytes) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    stated = headers.get("x-payload-length")
    return (
        path,
        offset,
        headers.get("warc-record-id"),
        headers.get("warc-type"),
        headers.get("warc-target-uri"),
        headers.get("warc-refers-to"),
        headers.get("warc-payload-digest"),
        int(stated) if stated else None,
        payload,
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            system, name = _open(path)
            with system.open_input_file(name) as file:
                rows, size = [], 0
                for offset, content in members(file, start, end):
                    rows.append(_parsed(path, offset, content))
                    size += len(content)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)]
    return pa.RecordBatch.from_arrays(columns, schema=_RECORDS)


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of archives given as ``path`` and ``bytes``, any number of tasks a file.

    Columns ``path``, ``offset``, ``record_id``, ``record_type``, ``target_uri``,
    ``refers_to``, ``stated_digest``, ``stated_bytes`` and ``payload``.
    """
    ranges = files.filter("bytes > 0").select(
        "path",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
        ).alias("start"),
    )
    ranges = ranges.withColumn("end", F.col("start") + range_bytes)
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0)
    schema = (
        "path string, offset long, record_id string, record_type string, target_uri string, "
        "refers_to string, stated_digest string, stated_bytes long, payload binary"
    )
    return ranges.repartition(int(tasks)).mapInArrow(_read, schema)


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    folder = work_folder(spark, "warc")
    records = read_archives(write_archives(read_table(spark, sf_dir, "pages"), folder))

    def page(urn: str):
        return F.nullif(F.regexp_extract(urn, rf"{PAGE_URN}(-?\d+)", 1), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    return records.select(
        page("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("stated_bytes"))
        .otherwise(F.octet_length("payload").cast("long"))
        .alias("payload_bytes"),
        F.when(revisit, F.replace("stated_digest", F.lit("sha1:"), F.lit("")))
        .otherwise(F.sha1("payload"))
        .alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to").cast("long")).alias("refers_to"),
    )
