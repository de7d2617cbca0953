"""WARC archives: write pages with revisits, chunked framing and segmented records, and read them back whole."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, segments int"
PARSED = RESULT + ", origin string, number int, total long, headers string, block binary, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; extensions after the size are ignored, a short or broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        piece = body[at : at + size]
        if len(piece) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def records_of(page_id, url, payload: bytes | None, n: int, digest: str, refers_to, refers_url: str | None, rid: str, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """Records of one page: a response, cut into segments where its block is longer, or a revisit without payload."""
    head = [
        ("WARC-Record-ID", f"<{rid}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", json.dumps(page_id)),
        ("WARC-URI-Missing", json.dumps(url is None)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        own = [("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page", json.dumps(refers_to))]
        if refers_url is not None:
            own.append(("WARC-Refers-To-Target-URI", _clean(refers_url)))
        yield record([*own, *head], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), *head], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *head], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<{rid}-{k}>"),
            ("WARC-Date", date),
            ("WARC-Segment-Origin-ID", f"<{rid}>"),
            ("WARC-Segment-Number", str(k)),
        ]
        if k == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(own, part)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record is cut off")
        yield headers, block


def decode(headers: dict[str, str], block: bytes, segments: int) -> tuple:
    """A result row, and the payload, of a whole record; digests are verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    page, url = json.loads(headers["warc-page-id"]), headers["warc-target-uri"]
    url = None if json.loads(headers.get("warc-uri-missing", "false")) else url
    if headers["warc-type"] == "revisit":
        return (page, int(fields["content-length"]), digest, "revisit", json.loads(headers["warc-refers-to-page"]), url, segments), None
    payload = dechunked(body) if fields.get("transfer-encoding") == "chunked" else body
    if base32_sha1(payload) != digest:
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return (page, len(payload), digest, "response", None, url, segments), payload


def write(pages: DataFrame, out: str | None = None, min_bytes: int = 0, segment_bytes: int = 8192, chunk_bytes: int = 4096) -> DataFrame:
    """Write a record per page and return the manifest of archives: path, records, bytes.

    The payload is the html in UTF-8, a null one empty. Of pages with equal
    payloads of ``min_bytes`` or more, those with the smallest page_id (nulls
    last; a repeated row is a response too) are responses and the others
    revisits of it; shorter ones are all responses. A task writes one archive
    under its own attempt's name; only archives in the manifest count, which
    is a written table, so tasks that run again leave nothing behind that is
    read. Html crosses the one shuffle compressed, once; payloads that very
    many pages share are looked up by a bounded broadcast. A revisit names the
    date and URI of its response in the standard's headers, and its page in
    one of ours. Other columns, of any name, are ignored; an empty table gives
    no archive; a payload has to fit a task.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    out = out or common.new_path(spark, "warc")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    run_id = uuid.uuid4().hex
    where, path = pafs.FileSystem.from_uri(out)
    where.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.sha1(html.cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), key.alias("key"))
    own = F.min_by(F.struct("url"), "page_id")
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), own.alias("of"), F.count("*").alias("uses"))
    first = common.materialize(first.where("uses > 1").select("key", "first", F.col("of.url").alias("first_url"), "uses"), "firsts")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = [h.encode("utf-8", "surrogatepass") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([z.compress(d) for d in data], pa.binary())], ["page_id", "url", "key", "data"])

    packed = rows.mapInArrow(squeeze, "page_id long, url string, key string, data binary")
    decided = common.lookup(packed, first, "key", "uses").select("page_id", "url", "data", "first", "first_url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        z, n, total = zstandard.ZstdDecompressor(), 0, 0
        target, base = pafs.FileSystem.from_uri(out)
        with target.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in batches:
                for page_id, url, data, first_id, first_url in zip(*(c.to_pylist() for c in b.columns)):
                    payload = z.decompress(data)
                    digest = base32_sha1(payload)
                    again = first_id is not None and page_id != first_id
                    rid = f"urn:uuid:{uuid.UUID(hashlib.md5(f'{run_id}:{name}:{n}'.encode()).hexdigest())}"
                    for r in records_of(page_id, url, None if again else payload, len(payload), digest, first_id, first_url, rid, date, segment_bytes, chunk_bytes):
                        f.write(r)
                        total += len(r)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["path", "records", "bytes"])

    return common.materialize(decided.mapInArrow(archive, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Read archives: a row per page, segmented records put together again.

    Whole records are decoded where they are read. Continuations are grouped
    by the identifier of their origin, ordered by segment number, checked for
    gaps and against the total length, and only then decoded; such a group is
    one record. A missing segment, a wrong length or digest is an error.
    ``payloads`` adds the payload bytes (null for revisits).
    """
    spark = manifest.sparkSession
    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, p = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with where.open_input_file(p) as f, gzip.GzipFile(fileobj=f) as g:
                    for headers, block in parse(io.BufferedReader(g, 1 << 20)):
                        number = int(headers.get("warc-segment-number", 0))
                        if number:
                            origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                            total = headers.get("warc-segment-total-length")
                            own = json.dumps(headers) if number == 1 else None
                            rows.append((None,) * 7 + (origin, number, int(total) if total else None, own, block, None))
                        else:
                            row, payload = decode(headers, block, 1)
                            rows.append(row + (None,) * 5 + (payload if payloads else None,))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts in b.column(0).to_pylist():
                parts = sorted(parts, key=lambda x: x["number"])
                if [x["number"] for x in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError("a segment is missing or there twice")
                block = b"".join(x["block"] for x in parts)
                if parts[-1]["total"] != len(block):
                    raise ValueError("segments don't have the total length")
                row, payload = decode(json.loads(parts[0]["headers"]), block, len(parts))
                rows.append(row + (None,) * 5 + (payload if payloads else None,))
            yield batch_of(rows)

    files = max(1, manifest.count())
    paths = manifest.where("records > 0").select("path").repartition(min(files, 4 * spark.sparkContext.defaultParallelism if files < 1000 else files))
    parsed = common.materialize(paths.mapInArrow(load, PARSED), "records")
    parts = parsed.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "headers", "block")).alias("parts"))
    whole = parts.select("parts").mapInArrow(assemble, PARSED)
    keep = [*(c.split()[0] for c in RESULT.split(", ")), *(["payload"] if payloads else [])]
    return parsed.where("origin is null").select(*keep).unionByName(whole.select(*keep))
