"""WARC archives with an index: write records, then read chosen ones back by coalesced byte ranges.

Every writing task makes files of its own, one gzip member to a record, and returns the index rows (file, offset, length, url,
digest, page_id, record_type) of what it wrote. The index is stored as Parquet by the same job, so that only files of
successful attempts are ever referenced. Readers sort the index by file and offset, join neighbouring ranges into one
read, and parse the members.

Of records with equal payloads of `least` bytes or more, the one with the smallest page_id is a response and the others are
revisits of it; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url leaves the target header out; a null page_id counts as greater than any
other and comes back as null; rows that repeat the smallest page_id of their payload are all responses; line breaks in a url
are written as %0D and %0A; a very long payload is one member, read and checked in one piece; other columns are not looked at; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.store import new_path, small_batches, written

LEAST_BYTES = 100
FILE_BYTES = 256 << 20
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Of one reading job; with more, each task reads more ranges in turn.
MOST_TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without, when refers_to is given."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The RECORDS fields of one record; a response's digest is taken from its payload and must be the one in its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda urn: int(urn[len("<urn:page:") : -1] or -1) if urn not in (None, "<urn:page:>") else None
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _writer(path: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                revisit = page["refers_to"] is not None
                payload = (page["html"] or "").encode()
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(record(page["page_id"], page["url"], payload, page["digest"], page["refers_to"])) + pack.flush()
                out.write(member)
                rows.append((page["page_id"], page["url"], page["digest"], "revisit" if revisit else "response", name, at, len(member)))
                at += len(member)
            if rows:
                yield _columns(rows, INDEX)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of pages (page_id, url, html) under `path`, which all executors reach, and returns their index."""
    small_batches(pages.sparkSession, 256)
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("size"))
    shared = pages.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    joined = pages.join(written(shared, "payloads"), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))
    return written(rows.mapInArrow(_writer(path, file_bytes), INDEX), "warc-index")


def _reader(path: str, range_bytes: int, gap_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        held: list[tuple[int, int]] = []
        name, source = None, None

        def fetch() -> Iterator[pa.RecordBatch]:
            start, end = held[0][0], max(a + n for a, n in held)
            data = source.read_at(end - start, start)
            for i in range(0, len(held), 256):
                yield _columns([parse(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in held[i : i + 256]], RECORDS)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["file"] != name or row["offset"] > sum(held[-1]) + gap_bytes or row["offset"] + row["length"] > held[0][0] + range_bytes):
                    yield from fetch()
                    held = []
                if row["file"] != name:
                    name, source = row["file"], files.open_input_file(f"{folder}/{row['file']}")
                held.append((row["offset"], row["length"]))
        if held:
            yield from fetch()

    return run


def read(index: DataFrame, path: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the given index rows name, in any order; a revisit has a null payload.

    There is a task for every range_bytes of records, however small their index rows are, but no more than there are ranges.
    """
    small_batches(index.sparkSession, 256)
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / range_bytes).alias("part"))
    tasks = rows.groupBy("file", "part").agg(F.sum("length").alias("bytes")).agg(F.count(F.lit(1)), F.sum("bytes")).first()
    many = max(1, min(tasks[0], -(-(tasks[1] or 0) // range_bytes), MOST_TASKS))
    return rows.repartition(many, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(_reader(path, range_bytes, gap_bytes), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back, without payloads."""
    path = new_path(pages.sparkSession, "warc")
    return read(write(pages, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
shared AS (SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= {LEAST_BYTES} GROUP BY payload HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, sha256(p.payload) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN shared ON shared.payload = p.payload
"""
