"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each task puts its records into files of its own in the shared folder, one gzip member a record, and returns an
index row a record: file, offset, length, url, digest. The index is a table, committed as Spark commits any other; a
file that a lost task left half written is in no index row and so is never read.

Reading starts from the index: the selected records are sorted by file and offset, dealt out by file segment, and
neighbours closer than GAP bytes are fetched by one read of at most SPAN bytes.

Payloads that equal a smaller page's become revisit records. Which page that is comes from a count per digest, combined
map-side; pages join only the digests of groups of two and more, so no group meets in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Bytes of an archive file, about.
FILE = 256 << 20
#: Largest gap between records that one read bridges, and the most bytes of a read.
GAP, SPAN = 64 << 10, 8 << 20
#: Payloads smaller than this never become revisits.
LEAST = 100
#: Fixed: the profile of the WARC standard for payloads that are identical.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's block is not as long as its header says")
    return fields, block.partition(b"\r\n\r\n")[2]


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    record = _record(page_id, url, payload, digest, refers_to)
                    out.write(record)
                    rows.append((page_id, name, at, len(record), url, digest, "response" if refers_to is None else "revisit"))
                    at += len(record)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) under folder; the lazily computed index of all records."""
    store, root = fs.FileSystem.from_uri(folder) if folder.startswith("file:") else (None, "")
    if store is not None:
        store.create_dir(root, recursive=True)
    pages = pages.select("page_id", "url", "html")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha2(body, 256)
    first = (
        pages.filter(F.octet_length(body) >= LEAST)
        .groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    known = pages.join(first, digest == F.col("digest"), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return known.select("page_id", "url", "html", refers_to.alias("refers_to")).mapInArrow(_written(folder), INDEX)


def _fetched(folder: str):
    def records(store: fs.FileSystem, root: str, rows: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
        file, name, k = None, None, 0
        while k < len(rows):
            end, j = rows[k][1] + rows[k][2], k + 1
            while j < len(rows) and rows[j][0] == rows[k][0] and rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - rows[k][1] <= SPAN:
                end, j = max(end, rows[j][1] + rows[j][2]), j + 1
            if name != rows[k][0]:
                if file is not None:
                    file.close()
                name = rows[k][0]
                file = store.open_input_file(f"{root}/{name}")
            base = rows[k][1]
            span = file.read_at(end - base, base)
            for row in rows[k:j]:
                yield row, zlib.decompress(span[row[1] - base : row[1] - base + row[2]], 31)
            k = j
        if file is not None:
            file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for (_, _, _, digest), data in records(store, root, list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                fields, payload = parse(data)
                named = fields["warc-payload-digest"].removeprefix("sha256:")
                if named != digest or fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a record does not hold the payload that the index names")
                page = fields["warc-record-id"][1:-1].removeprefix(_PAGE)
                refers = fields.get("warc-refers-to", "<>")[1:-1].removeprefix(_PAGE)
                text = payload.decode() if fields["warc-type"] == "response" else None
                out.append((int(page) if page else None, int(fields["x-payload-length"]), digest, fields["warc-type"], int(refers) if refers else None, fields["warc-target-uri"], text))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of index select, read by coalesced ranges and checked against their digests.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, and html (null for revisits).
    """
    ordered = index.select("file", "offset", "length", "payload_digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(
        _fetched(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages and read them back.

    Defined cases: null html is the empty payload; a null url is written empty; an empty table gives an empty result;
    rows that repeat a page_id are a record each; a null page_id is a record without a number, and a revisit if its
    payload equals a numbered page's. Other columns of pages are ignored.
    """
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archive"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    index = scratch.write(write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), "index")
    return read_warc(index, folder).drop("url", "html")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.payload_bytes >= 100 AND p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.payload_bytes >= 100 AND p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
