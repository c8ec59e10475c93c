"""WARC archives: a writer, and a reader that salvages what lies behind damage.

A record is accepted after checks: version line, headers, length, the blank
lines behind it, and the digests that it states; in compressed archives, where
each record is a gzip member of its own, also the member's checksum. Where a
check fails, the reader looks for the next gzip member or version line that
begins an acceptable record, goes on from there, and logs the bytes between as
a gap. An archive is read in pieces by one task; archives are dealt over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.session import Workspace, ship

#: Payloads of so many bytes are stored once.
LEAST_SHARED = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Most tasks that read archives.
READERS = 1 << 15
#: The registered query leaves the torn start of a member before every so many-th record, so that it has damage to read past.
TORN_EVERY = 97
#: Date of records, where a page has none: reruns write the same archives.
DATE = "1970-01-01T00:00:00Z"
PIECE = 1 << 20
#: Longest block of header lines that is looked for.
HEADER_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r?\n")


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    folder = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


# Writing


def record(kind: str, record_id: str, block: bytes, content_type: str, fields: dict[str, str | None]) -> bytes:
    """A record: version line, headers in the given order (those of None are left out), block and blank lines."""
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | fields
    headers |= {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record_id(page_id, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='')}:{digest[:16]}"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """The response record of a page, or, where refers_to is given, its revisit record: HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is None:
        return record("response", record_id(page_id, digest), http + payload, "application/http; msgtype=response", fields)
    fields |= {"WARC-Refers-To": f"<{record_id(refers_to, digest)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", record_id(page_id, digest), http, "application/http; msgtype=response", fields)


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, torn_every: int = 0) -> DataFrame:
    """Writes a record for each row into archives in the folder; (path, records, bytes) of the archives, which the job writes first.

    Of pages with equal payloads of at least LEAST_SHARED bytes, those with the
    smallest id hold the payload and others revisit them; a null id is never
    the smallest unless all are null, and rows that repeat the smallest id are
    responses all. A null html is an empty payload; a null url is left out.
    A task writes archives of its own under names drawn anew by each attempt:
    only those in the table returned count, so an executor that is lost leaves
    nothing that is read twice. torn_every: before every so many-th record, its
    member's first half is written, as a writer that broke off leaves it.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    space = Workspace(spark)
    shared = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Not broadcast, for it grows with the pages; Spark splits the pages of a frequent payload where it joins them.
    rows = rows.join(space.write(shared, "shared").hint("merge"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _system(folder)
        system.create_dir(at, recursive=True)
        name, out, done, records, kept = "", None, 0, 0, []

        def opened() -> tuple[str, pa.NativeFile, int]:
            name = f"{uuid.uuid4().hex}.warc" + ".gz" * compressed
            head = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"software: quillspar\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields", {"WARC-Filename": name})
            head = member(head) if compressed else head
            out = system.open_output_stream(f"{at}/{name}", compression=None)
            out.write(head)
            return name, out, len(head)

        for batch in batches:
            ids, urls, payloads, digests, refer = (c.to_pylist() for c in batch.columns)
            for page_id, url, body, digest, to in zip(ids, urls, payloads, digests, refer, strict=True):
                if out is None:
                    name, out, done = opened()
                    records = 0
                data = page_record(page_id, url, body, digest, to)
                data = member(data) if compressed else data
                records += 1
                if torn_every and records % torn_every == 0:
                    done += out.write(data[: len(data) // 2])
                done += out.write(data)
                if done >= archive_bytes:
                    out.close()
                    kept.append((name, records, done))
                    out = None
        if out is not None:
            out.close()
            kept.append((name, records, done))
        names, counts, sizes = zip(*kept, strict=True) if kept else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return space.write(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


# Reading


class Damaged(ValueError):
    """Why bytes are no acceptable record."""


class Window:
    """Bytes of a file by offset, of which about one piece is held."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset, or as many as there are."""
        if offset < self.start or offset + n > self.start + len(self.data):
            self.file.seek(offset)
            self.start, self.data = offset, self.file.read(max(n, PIECE))
        return self.data[offset - self.start : offset - self.start + n]

    def starts(self, offset: int) -> Iterator[int]:
        """Where a gzip member or a version line begins, from offset on; what was cut off may stand right before one."""
        while offset < self.size:
            piece = self.at(offset, PIECE)
            last = max(1, len(piece) - 16) if offset + len(piece) < self.size else len(piece)
            for found in _START.finditer(piece):
                if found.start() < last:
                    yield offset + found.start()
            offset += last


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def get(self, name: str) -> str | None:
        return self.headers.get(name.lower())


def _digest(stated: str, data: bytes) -> bool:
    """Whether a stated digest (sha1 or sha256 in hexadecimal or base 32; others aren't judged) is that of the data."""
    name, _, value = stated.strip().partition(":")
    if name.lower() not in ("sha1", "sha256", "sha-1", "sha-256"):
        return True
    real = hashlib.new(name.lower().replace("-", ""), data)
    return value.lower() == real.hexdigest() or value.upper().rstrip("=") == base64.b32encode(real.digest()).decode().rstrip("=")


def payload_of(found: Record) -> bytes:
    """What follows the HTTP headers, or the whole block of records that have none."""
    if "application/http" not in (found.get("Content-Type") or ""):
        return found.block
    head, mark, rest = found.block.partition(END)
    return rest if mark else b""


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\n")
    if not re.fullmatch(r"WARC/1\.\d\r?", lines[0]):
        raise Damaged("no version line")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, mark, value = line.partition(":")
            if not mark:
                raise Damaged("a header without a colon")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parsed(data, offset: int) -> tuple[Record, int]:
    """The record at an offset of data, which is a Window or has its method `at`, and where it ends."""
    n, step = -1, 1 << 12
    while n < 0 and step <= HEADER_BYTES:
        head = data.at(offset, step)
        n = head.find(END)
        if len(head) < step:
            break
        step *= 4
    if n < 0 and not head.startswith(VERSION):
        raise Damaged("no version line")
    if n < 0:
        raise Damaged("headers without an end")
    headers = _headers(head[:n])
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("no length")
    begin, size = offset + n + len(END), int(length)
    if begin + size + len(END) > data.size:
        raise Damaged("cut off")
    block = data.at(begin, size + len(END))
    if block[size:] != END:
        raise Damaged("no blank lines behind it")
    found = Record(headers, block[:size])
    if not _digest(found.get("WARC-Block-Digest") or "", found.block):
        raise Damaged("another block digest")
    if found.get("WARC-Type") == "response" and not _digest(found.get("WARC-Payload-Digest") or "", payload_of(found)):
        raise Damaged("another payload digest")
    return found, begin + size + len(END)


class _Held:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def at(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]


def accepted(window: Window, offset: int) -> tuple[list[Record], int]:
    """The records of the gzip member or the record at an offset, and where it ends."""
    if window.at(offset, 3) != MAGIC:
        found, end = parsed(window, offset)
        return [found], end
    inflate, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not inflate.eof:
            piece = window.at(at, 1 << 16)
            if not piece:
                raise Damaged("cut off")
            parts.append(inflate.decompress(piece))
            if len(parts) == 1 and parts[0] and not parts[0].startswith(VERSION[: len(parts[0])]):
                raise Damaged("no version line")
            at += len(piece)
    except zlib.error as e:
        raise Damaged("no sound member") from e
    held, records, place = _Held(b"".join(parts)), [], 0
    while place < held.size:
        found, place = parsed(held, place)
        records.append(found)
    if not records:
        raise Damaged("an empty member")
    return records, at - len(inflate.unused_data)


def salvaged(window: Window) -> Iterator[tuple[int, int, list[Record], str | None]]:
    """(offset, end, records, None) of what is accepted and (offset, end, [], reason) of the gaps between, in the file's order."""
    at = 0
    while at < window.size:
        try:
            found, end = accepted(window, at)
            yield at, end, found, None
            at = end
            continue
        except Damaged as e:
            why = str(e)
        after, hit = window.size, None
        for candidate in window.starts(at + 1):
            try:
                hit = accepted(window, candidate)
                after = candidate
                break
            except Damaged:
                continue
        yield at, after, [], why
        if hit:
            yield after, hit[1], hit[0], None
            at = hit[1]
        else:
            at = after


_FIELDS = [
    ("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())),
]
_SCHEMA = "path string, offset long, bytes long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, headers map<string,string>"


def _row(path: str, offset: int, end: int, found: Record, payloads: bool) -> dict:
    """One record; size and digest of a revisit's payload are those that its headers state."""
    bare = lambda x: x.strip("<>") if x else None
    row = {"path": path, "offset": offset, "bytes": end - offset, "gap": None, "record_type": found.get("WARC-Type"), "record_id": bare(found.get("WARC-Record-ID")), "target_uri": found.get("WARC-Target-URI"), "refers_to": bare(found.get("WARC-Refers-To")), "headers": list(found.headers.items())}
    if row["record_type"] == "revisit":
        stated = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", found.block.partition(END)[0])
        digest = re.fullmatch(r"sha-?256:([0-9A-Fa-f]{64})", found.get("WARC-Payload-Digest") or "")
        return row | {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": digest[1].lower() if digest else None, "payload": None}
    body = payload_of(found)
    return row | {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body if payloads else None}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(path) -> the records and gaps of all archives, in the columns of _SCHEMA.

    A row with a null `gap` is a record: offset and bytes are its place in the
    file (of its member, where that is compressed), payload_digest the SHA-256
    in hexadecimal. Other rows are quarantined bytes and say in `gap` which
    check failed first. A member with several records gives a row for each;
    members of other content are gaps. Empty archives give nothing.
    """
    spark = archives.sparkSession
    ship(spark)
    paths = archives.select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _system(path)
                rows, held = [], 0
                with system.open_input_file(at) as file:
                    for offset, end, found, why in salvaged(Window(file)):
                        rows += [_row(path, offset, end, x, payloads) for x in found] or [{"path": path, "offset": offset, "bytes": end - offset, "gap": why}]
                        held += end - offset
                        if held >= PIECE or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    return paths.repartition(max(1, min(READERS, paths.count()))).mapInArrow(run, _SCHEMA)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", torn_every: int = TORN_EVERY, **options) -> DataFrame:
    """Writes the pages into archives under spark.checkpoint.dir and reads them back.

    Per record: the page's id, payload_bytes, payload_digest, record_type
    (response or revisit) and refers_to (the id of the page that holds the
    payload; null for responses). See write_pages for nulls and repeated ids.
    """
    folder = Workspace(pages.sparkSession).place("warc")
    archives = write_pages(pages, folder, id_col, url_col, html_col, torn_every=torn_every, **options)
    found = read_archives(archives, payloads=False).where("gap IS NULL AND record_type IN ('response', 'revisit')")
    page = lambda name: F.nullif(F.url_decode(F.regexp_extract(name, "^urn:page:([^:]*):", 1)), F.lit("")).cast(pages.schema[id_col].dataType)
    return found.select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


PAGE_RECORDS_SQL = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
    SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
"""
