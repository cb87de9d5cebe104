"""WARC archives with a two-level capture index.

Each task writes one archive of gzip members, a member for each record, to the shared folder. Records with the payload
of another are revisits, which carry its digest and length but not its bytes. The capture index is sorted by
reversed-host URL keys and cut into compressed blocks of ``BLOCK`` lines; a sparse directory has one line for each
block. A lookup searches the directory by bisection, reads one block by its range, searches that, and reads the
record by its range. Reading everything back goes through the index as well: its entries are grouped by archive and
each archive is read by ranges in order.

Archive and index files of failed task attempts have names that no list holds.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import fresh_path, partitions_for, slices, stage

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Entries of a block of the index, and records that a task reads, about.
BLOCK, TASK_RECORDS = 1000, 1 << 14
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, a leading www left out, lower case, then port, path and query."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.lower())
    host = re.sub(r"^(www\d*|m)\.", "", host) if host.count(".") > 1 else host
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    rest = (parts.path or "/") + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")
    return re.sub(r"\s", "%20", f"{where}){rest}".lower())


def record_id(page_id: int | None, url: str | None) -> str:
    return uuid.uuid5(_NAMESPACE, f"{page_id} {url}").urn


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit (refers_to is set) has the digest and length of its payload in its head alone."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, url)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The head of a record, and its payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode().split("\r\n")[1:])
    body = rest[: int(head["Content-Length"])]
    return head, body.partition(b"\r\n\r\n")[2]


ENTRIES = "key string, page_id long, digest string, kind string, path string, offset long, length long"


def captures(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (null: empty), digest and refers_to: the page whose equal payload is kept, or null.

    Of equal payloads of ``least`` bytes or more, the one with the largest page_id is kept. Payloads are equal if
    their SHA-1 and lengths are. The largest ids are found by partial maxima, so a payload that a third of all pages
    share is a few rows; where many share one, Spark splits its side of the join.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    rows = rows.withColumn("size", F.octet_length("html"))
    kept = rows.filter(large).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "size", "first")
    out = rows.join(kept, ["digest", "size"], "left")
    other = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, *, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives of pages and returns the entries of the capture index, staged and not yet sorted.

    Null page_ids and urls are empty fields; repeated rows are records of their own; no pages give no archive.
    Columns other than page_id, url and html are not read. A task holds 64 pages or some megabytes at a time, whichever
    is less, and a longer page alone, as text, record and compressed record.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    names = ["key", "page_id", "digest", "kind", "path", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pa.fs.FileSystem.from_uri(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for part in slices(batch, 64):
                out = out or fs.open_output_stream(f"{inner}/{name}", compression=None)
                rows, members = [], []
                for page, url, html, digest, refers in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    member = gzip.compress(render(page, url, html.encode(), digest, refers), 1, mtime=0)
                    members.append(member)
                    rows.append((url_key(url), page, digest, "response" if refers is None else "revisit", f"{folder}/{name}", at, len(member)))
                    at += len(member)
                out.write(b"".join(members))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "offset", "length") else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
        if out is not None:
            out.close()

    return stage(captures(pages, least=least).mapInArrow(run, ENTRIES), "warc-entries")


DIRECTORY = "key string, path string, offset long, length long, n long"


def _line(entry: dict) -> str:
    return f"{entry['key']} {json.dumps({k: v for k, v in entry.items() if k != 'key'})}"


def _entry(line: str) -> dict:
    key, _, rest = line.partition(" ")
    return {"key": key} | json.loads(rest)


def index(entries: DataFrame, folder: str | None = None, *, block: int = BLOCK) -> DataFrame:
    """Writes the sorted, compressed blocks of the index and returns the directory: each block's first key and range.

    Pages of one key are dealt on by page_id, so a key that many captures share fills several blocks and tasks.
    """
    spark = entries.sparkSession
    folder = folder or fresh_path(spark, "warc-index")
    cols = ["key", "page_id", "digest", "kind", "path", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pa.fs.FileSystem.from_uri(folder)
        name, out, at, lines = f"index-{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal at, out
            out = out or fs.open_output_stream(f"{inner}/{name}", compression=None)
            raw = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(raw)
            row = {"key": pa.array([lines[0].partition(" ")[0]]), "path": pa.array([f"{folder}/{name}"]), "offset": pa.array([at], pa.int64()), "length": pa.array([len(raw)], pa.int64()), "n": pa.array([len(lines)], pa.int64())}
            at += len(raw)
            lines.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in slices(batch):
                for entry in part.to_pylist():
                    lines.append(_line(entry))
                    if len(lines) >= block:
                        yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    rows = entries.select(*cols).repartitionByRange(partitions_for(spark, entries), "key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(rows.mapInArrow(run, DIRECTORY), "warc-directory")


def _read_at(path: str, offset: int, length: int, open_: dict) -> bytes:
    if path not in open_:
        fs, inner = pa.fs.FileSystem.from_uri(path)
        open_[path] = fs.open_input_file(inner)
    return open_[path].read_at(length, offset)


class CaptureIndex:
    """Lookups of single URLs: the sparse directory in memory, blocks and records by range."""

    def __init__(self, directory: list[tuple[str, str, int, int]]):
        self.directory = sorted(directory)
        self.keys = [d[0] for d in self.directory]
        self.open: dict = {}

    @classmethod
    def load(cls, directory: DataFrame) -> CaptureIndex:
        """One row for each block; meant for a serving process, and not used by the jobs here."""
        return cls([(r["key"], r["path"], r["offset"], r["length"]) for r in directory.toLocalIterator()])

    def entries(self, url: str) -> list[dict]:
        key, out = url_key(url), []
        first = max(0, bisect_left(self.keys, key) - 1)
        for _, path, offset, length in self.directory[first : bisect_right(self.keys, key)]:
            lines = gzip.decompress(_read_at(path, offset, length, self.open)).decode().split("\n")
            at = bisect_left(lines, key + " ")
            while at < len(lines) and lines[at].startswith(key + " "):
                out.append(_entry(lines[at]))
                at += 1
        return out

    def records(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        return [parse(gzip.decompress(_read_at(e["path"], e["offset"], e["length"], self.open))) for e in self.entries(url)]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(directory: DataFrame, *, payloads: bool = True) -> DataFrame:
    """All records, read through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The bytes and digest of a response are those of the payload that was read, those of a revisit the ones in its
    head. A payload is null for revisits, and for all with ``payloads`` false.
    """
    spark = directory.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}
        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = [_entry(x) for x in gzip.decompress(_read_at(path, offset, length, open_)).decode().split("\n")]
                yield pa.RecordBatch.from_pydict({"path": pa.array([e["path"] for e in found], pa.string()), "offset": pa.array([e["offset"] for e in found], pa.int64()), "length": pa.array([e["length"] for e in found], pa.int64())})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for path, offset, length in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if path not in open_:
                        open_.clear()  # one archive at a time
                    head, body = parse(zlib.decompress(_read_at(path, offset, length, open_), 31))
                    page, refers = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page-ID")
                    n, digest = (len(body), hashlib.sha1(body).hexdigest()) if refers is None else (int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((int(page) if page else None, head["WARC-Target-URI"], n, digest, head["WARC-Type"], None if refers is None else int(refers), body if payloads and refers is None else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    found = directory.select("path", "offset", "length").mapInArrow(blocks, "path string, offset long, length long")
    parts = -(-(directory.agg(F.sum("n")).first()[0] or 0) // TASK_RECORDS)
    found = found.repartitionByRange(max(parts, partitions_for(spark)), "path", "offset").sortWithinPartitions("path", "offset")
    return found.mapInArrow(records, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives and index, and reads every page back: what its record says, without the payload."""
    return read(index(write(pages)), payloads=False).drop("payload", "url")


def round_trip_sql(least: int = LEAST_BYTES) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS first FROM d WHERE n >= {least} GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest AND n >= {least}"""
