"""WARC archives: written by tasks, indexed per record, read back by byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import filesystem, folder, stored

DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
INDEX = "file string, offset long, length long, id string, url string, digest string, record_type string"
RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


@dataclass
class Archive:
    """``index`` has a row per record: file, offset, length, id, url, digest, record_type."""

    root: str
    index: DataFrame
    id_type: str


def _record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """A record as WARC 1.1 prescribes; a revisit has the HTTP header and no payload."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(_IDS, x)}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(f'page/{page}')}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(f'page/{first}')}", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of the record and of its HTTP block, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archive(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 100, file_bytes: int = 1 << 28) -> Archive:
    """Write a record per row to gzip-per-record archives in the shared folder.

    Of rows whose payloads (the html as UTF-8, null as empty) are equal and have
    ``min_payload`` bytes, that with the smallest id is a response; the others are revisits
    that refer to it. Smaller payloads are all responses. Rows that repeat both that id
    and the payload are responses too; rows without an id are revisits of the row with
    the smallest id, or responses if none has an id. Null urls get no target header.

    Only (digest, id) pairs are aggregated to find the first of each payload, and the join
    that brings the first to its copies is one that Spark splits when a payload is hot.
    A task writes files of its own under new names, so a task that runs again leaves files
    that the index never names.
    """
    root = folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = rows.filter(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "first")
    joined = rows.join(shared, F.col("digest") == F.col("of"), "left")
    first = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    joined = joined.select(F.col("id").cast("string"), "url", "html", "digest", first.cast("string").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        out, name, offset = None, None, 0
        try:
            for batch in batches:
                index = []
                for page, target, text, digest, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(_record(page, target, text.encode(), digest, earlier)) + packer.flush()
                    out.write(raw)
                    index.append((name, offset, len(raw), page, target, digest, "response" if earlier is None else "revisit"))
                    offset += len(raw)
                if index:
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = stored(joined.mapInArrow(write, INDEX), "warc-index")
    return Archive(root, index, rows.schema["id"].dataType.simpleString())


def read_records(archive: Archive, selected: DataFrame | None = None, gap: int = 1 << 16, most: int = 1 << 23, payload: bool = False) -> DataFrame:
    """Records of ``selected`` (rows of the index; all by default), read from the archives.

    Ranges are sorted by file and offset; neighbours at most ``gap`` bytes apart are read
    at once, up to ``most`` bytes. Payloads are checked against their digests. Columns:
    page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload
    itself if asked for (null for revisits). An empty selection gives no rows.
    """
    index = archive.index if selected is None else selected
    spark, root = index.sparkSession, archive.root
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // (1 << 24)))
    ranges = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        for batch in batches:
            for name, start, stop, spans in coalesced(zip(*(c.to_pylist() for c in batch.columns), strict=True), gap, most):
                with files.open_input_file(f"{base}/{name}") as f:
                    raw = f.read_at(stop - start, start)
                found = []
                for offset, length in spans:
                    fields, http, body = parse_record(zlib.decompress(raw[offset - start: offset - start + length], 31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"payload at {offset} of {name} does not match its digest")
                    found.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), kind, int(http["Content-Length"]), digest, fields.get("X-Refers-To-Page-ID"), *([body if kind == "response" else None] if payload else [])))
                kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * payload
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload)

    out = ranges.mapInArrow(read, RECORDS + ", payload binary" * payload)
    return out.withColumns({c: F.col(c).cast(archive.id_type) for c in ("page_id", "refers_to")})


def coalesced(ranges, gap: int, most: int):
    """(file, start, stop, [(offset, length)]) of neighbouring ranges in sorted order."""
    name, start, stop, spans = None, 0, 0, []
    for file, offset, length in ranges:
        if spans and (file != name or offset - stop > gap or offset + length - start > most):
            yield name, start, stop, spans
            spans = []
        if not spans:
            name, start, stop = file, offset, offset
        spans.append((offset, length))
        stop = max(stop, offset + length)
    if spans:
        yield name, start, stop, spans
