"""WARC archives: written as one gzip member per record, read back sequentially.

An archive is a binary row of a Parquet table in a store that all executors share, so writing and reading go through Spark alone. The
reader walks an archive once: it inflates member after member in small steps, frames each record by its Content-Length, and checks
both digests. Payloads met before (in the whole table, by digest) become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

STEP = 1 << 16
#: A payload shorter than this is always stored.
LEAST_REVISIT = 100
_DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def payload(self) -> bytes:
        """The block of an HTTP response without its header; other blocks as they are."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def member(kind: str, page: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only and names the response and the payload's digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + p)}>"
    one_line = " ".join((url or "").split())
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page)), ("WARC-Date", _DATE), ("WARC-Target-URI", one_line), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("X-Page", page)]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", refers_to)]
    head.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read(archive: bytes) -> Iterator[Record]:
    """The records of an archive in order; ValueError where framing or a digest is wrong, or the archive ends early."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        z, held, head, need, block = zlib.decompressobj(31), bytearray(), None, 0, None
        while not z.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a record")
            part = view[at : at + STEP]
            held += z.decompress(part)
            at += len(part) - len(z.unused_data)
            if head is None and (end := held.find(b"\r\n\r\n")) >= 0:
                lines = bytes(held[:end]).decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise ValueError("no WARC record")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = int(head["content-length"])
                del held[: end + 4]
            if head is not None and block is None and len(held) >= need + 4:
                block = bytes(held[:need])
                if held[need : need + 4] != b"\r\n\r\n":
                    raise ValueError("a record does not end where its length says")
                del held[: need + 4]
        if block is None or held:
            raise ValueError("a member does not hold one whole record")
        if _digest(block) != head["warc-block-digest"]:
            raise ValueError("a block's digest is wrong")
        r = Record(head["warc-type"], head, block)
        if r.kind != "revisit" and _digest(r.payload()) != head["warc-payload-digest"]:
            raise ValueError("a payload's digest is wrong")
        yield r


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): the smallest page of equal payloads of enough bytes; null for that page itself and for small ones.

    Null html is an empty payload. Null ids are never referred to; repeated rows are one page, stored once for each row.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    first = p.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    # few payloads repeat, and a join on the digest of all pages would carry their html: find the pages first
    again = p.select("page_id", "digest").join(first, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return p.join(again.hint("shuffle_hash"), ["page_id", "digest"], "left").drop("digest")


def write(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives of about that size of planned pages, as a table (archive) in the shared folder. Each task closes its own archives."""

    def rows(batches):
        held, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                back = r["refers_to"]
                held.append(member("response" if back is None else "revisit", str(r["page_id"]), r["url"], r["html"].encode("utf-8", "surrogatepass"), None if back is None else str(back)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})

    return common.written(pages.mapInArrow(rows, "archive binary"), "warc")


def scan(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives: page, kind, length and digest of the full payload, and the page referred to."""

    def rows(batches):
        for b in batches:
            for a in b.column(0):
                got = []
                for r in read(a.as_py()):
                    head = dict(x.split(b": ", 1) for x in r.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
                    digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha256:") + "====").hex()
                    page, back = r.headers["x-page"], r.headers.get("x-refers-to-page")
                    got.append({"page": None if page == "None" else page, "payload_bytes": int(head[b"Content-Length"]), "payload_digest": digest, "record_type": r.kind, "back": back})
                yield pa.RecordBatch.from_pylist(got, pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("back", pa.string())]))

    return archives.mapInArrow(rows, "page string, payload_bytes long, payload_digest string, record_type string, back string")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of `pages`, read back from the archives.

    Null and empty html are empty payloads, all of them responses. Of equal payloads of 100 bytes or more the smallest page_id is the
    response; a repeated row of it is a response again.
    """
    records = scan(write(plan(common.table(spark, sf_dir, "pages"))))
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("back").cast("long").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
