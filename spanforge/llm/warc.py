"""WARC archives: writing with segmentation and chunked framing, and reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, sliced

#: A block over this many bytes is cut into segments; a body is framed in chunks of this size.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ID = re.compile(r"<urn:uuid:([0-9a-f-]{36})>")


def record_id(page_id: int | None, sha: str, copy: str = "") -> str:
    """A record's URI: 64 bits of page_id, one digit for null, 15 digits of the payload's SHA-1 (with what tells copies of a page apart)."""
    tail = hashlib.sha1(f"{sha}{copy}".encode()).hexdigest() if copy else sha
    digits = f"{(page_id or 0) & (1 << 64) - 1:016x}{int(page_id is None)}{tail[:15]}"
    return f"<urn:uuid:{uuid.UUID(digits)}>"


def page_of(uri: str | None) -> int | None:
    if uri is None:
        return None
    digits = _ID.fullmatch(uri)[1].replace("-", "")
    n = int(digits[:16], 16)
    return None if digits[16] == "1" else n - (1 << 64) * (n >> 63)


def base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """The body in chunked transfer framing: extensions and trailers are passed over; a broken frame is an error."""
    at, parts = 0, []
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        parts.append(data[at : at + n])
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response_records(page_id: int | None, url: str | None, payload: bytes, sha: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The response record, in segments if it is long: number 1, then continuations by origin, the last with the total length."""
    block = _HTTP + chunked(payload)
    uri = record_id(page_id, sha)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{base32(sha)}"), ("Content-Type", "application/http; msgtype=response")]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", 1)], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri}{k}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", uri), ("WARC-Segment-Number", k)]
        if k == len(pieces):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield record(more, piece)


def revisit_record(page_id: int | None, url: str | None, size: int, sha: str, refers_to: int | None, copy: int = 1) -> bytes:
    """A revisit: response headers with the payload's full length, no payload. copy numbers those of one page_id, url and payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, sha, f"{copy}{url}")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{base32(sha)}"), ("WARC-Refers-To", record_id(refers_to, sha)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record([*head, ("Content-Type", "application/http; msgtype=response")], block)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record here")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        at = end + 8 + n


_ARCHIVE = "archive string, block long, data binary"


def _pack(kind: str, files: int, block_bytes: int, segment_bytes: int):
    """Records into the blocks of `files` archives a task; a record's segments go to one archive after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        open_: list[list[bytes]] = [[] for _ in range(files)]
        sizes, blocks, turn = [0] * files, [0] * files, 0

        def flush(f: int) -> pa.RecordBatch:
            row = [[f"{kind}-{task:06d}-{f}.warc"], [blocks[f]], [b"".join(open_[f])]]
            open_[f], sizes[f], blocks[f] = [], 0, blocks[f] + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary())], names=["archive", "block", "data"])

        for batch in sliced(batches, "payload") if kind == "response" else batches:
            for r in batch.to_pylist():
                records = response_records(r["page_id"], r["url"], r["payload"], r["sha"], segment_bytes) if kind == "response" else [revisit_record(r["page_id"], r["url"], r["n_bytes"], r["sha"], r["first"], r["copy"])]
                for one in records:
                    turn = (turn + 1) % files
                    open_[turn].append(one)
                    sizes[turn] += len(one)
                    if sizes[turn] > block_bytes:
                        yield flush(turn)
        for f in range(files):
            if open_[f]:
                yield flush(f)

    return run


def write_archives(pages: DataFrame, path: str, files: int = 4, block_bytes: int = 1 << 20, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a WARC record a row of pages, as a table of archive blocks that any store Spark writes to can hold.

    Of rows with equal payloads one with the largest page_id (null is the smallest) is the response, the others revisit it: also rows that
    repeat it. Payloads are grouped by SHA-1 without their bytes; only the join that picks the responses moves payloads, on (SHA-1,
    page_id, url), so a payload that many pages share makes no hot key there, and rows that are repeated are grouped by count.
    """
    # keys without nulls, so that the join and the grouping after it deal rows alike and payloads move once
    key = ["sha", "page", "no_page", "link", "no_link"]
    page, link = F.col("page_id").cast("long"), F.col("url").cast("string")
    named = [F.coalesce(page, F.lit(0)).alias("page"), page.isNull().alias("no_page"), F.coalesce(link, F.lit("")).alias("link"), link.isNull().alias("no_link")]
    keyed = pages.select(*named, F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    alike = keyed.groupBy(*key).agg(F.count("*").alias("copies"), F.max(F.octet_length("payload")).cast("long").alias("n_bytes"))
    largest = F.max(F.struct(~F.col("no_page"), "page", ~F.col("no_link"), "link"))
    groups = alike.groupBy("sha").agg(largest.alias("own")).select("sha", F.col("own.page").alias("page"), (~F.col("own.col1")).alias("no_page"), F.col("own.link").alias("link"), (~F.col("own.col3")).alias("no_link"))
    responses = keyed.join(groups, key, "left_semi").groupBy(*key).agg(F.first("payload").alias("payload"))
    first = groups.select("sha", *[F.col(c).alias(f"first_{c}") for c in key[1:]])
    own = (F.col("page") == F.col("first_page")) & (F.col("no_page") == F.col("first_no_page")) & (F.col("link") == F.col("first_link")) & (F.col("no_link") == F.col("first_no_link"))
    revisits = alike.join(first, "sha").withColumn("copies", F.col("copies") - own.cast("long")).filter("copies > 0")
    told = [F.when(~F.col("no_page"), F.col("page")).alias("page_id"), F.when(~F.col("no_link"), F.col("link")).alias("url"), F.lower(F.hex("sha")).alias("sha")]
    responses = responses.select(*told, "payload")
    revisits = revisits.select(*told, "n_bytes", F.when(~F.col("first_no_page"), F.col("first_page")).alias("first"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    blocks = responses.mapInArrow(_pack("response", files, block_bytes, segment_bytes), _ARCHIVE)
    blocks = blocks.unionByName(revisits.mapInArrow(_pack("revisit", files, block_bytes, segment_bytes), _ARCHIVE))
    blocks.write.parquet(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, segment, total, type, digest, refers_to, block) of each record."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = ["origin", "segment", "total", "type", "digest", "refers_to", "block"]
    for batch in batches:
        for data in batch.column("data"):
            out = []
            for h, block in parse_records(data.as_py()):
                number = int(h.get("WARC-Segment-Number", 0))
                if number == 0:
                    n, digest = _payload(block, h)
                    out.append((h["WARC-Record-ID"], 0, n, h["WARC-Type"], digest, h.get("WARC-Refers-To"), None))
                else:
                    out.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number, int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None, h["WARC-Type"], h.get("WARC-Payload-Digest"), None, block))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _payload(block: bytes, head: dict[str, str]) -> tuple[int, str]:
    """(bytes, digest) of the full payload; a response's digest is worked out and held against the header."""
    end = block.index(b"\r\n\r\n")
    http = block[:end].lower()
    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        return int(re.search(rb"content-length: (\d+)", http)[1]), said
    body = block[end + 4 :]
    if b"transfer-encoding: chunked" in http:
        body = dechunked(body)
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    if digest != said:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its digest says")
    return len(body), digest


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (origin, segment): unsegmented records pass; segments are put together, counted and decoded."""
    out: list[tuple] = []
    parts: list[bytes] = []
    first, total, number = None, None, 0

    def close() -> None:
        nonlocal parts, first
        if parts:
            block = b"".join(parts)
            if total != len(block):
                raise ValueError(f"{first['origin']}: {len(block)} bytes in segments of {total}")
            n, digest = _payload(block, {"WARC-Type": first["type"], "WARC-Record-ID": first["origin"], "WARC-Payload-Digest": first["digest"]})
            out.append((first["origin"], first["type"], n, digest, None))
        parts, first = [], None

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        rows = [(page_of(o), n, d, t, page_of(r)) for o, t, n, d, r in out]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["segment"] == 0:
                close()
                out.append((r["origin"], r["type"], r["total"], r["digest"], r["refers_to"]))
                continue
            if r["segment"] == 1 and (first is None or first["origin"] != r["origin"]):
                close()
                first, number, total = r, 0, None
            if first is None or r["origin"] != first["origin"]:
                raise ValueError(f"{r['origin']}: its first segment is missing")
            if r["segment"] != number + 1:
                raise ValueError(f"{r['origin']}: segment {number + 1} is missing")
            number, total = r["segment"], r["total"]
            parts.append(r["block"])
        if out:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Segments are grouped by origin, ordered by number and checked against the total length; then the chunked framing is
    decoded and the digest verified. Only segments carry bytes into the shuffle.
    """
    parsed = spark.read.parquet(path).mapInArrow(_parse, "origin string, segment long, total long, type string, digest string, refers_to string, block binary")
    ordered = parsed.repartition(partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return ordered.mapInArrow(_reassemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut(spark.range(0))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages into the session's shared folder and read them back.

    Null html is an empty payload; empty payloads are equal to each other; null page_id is a page (smallest); of rows
    repeated with the same page_id and html each has a record and a row, all but one of them revisits; an empty table gives no rows; columns besides page_id, url and html are not read.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


_NIBBLES = ", ".join(f"'{i:04b}'" for i in range(16))
ORACLE = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY s ORDER BY page_id DESC NULLS LAST)),
b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda h: [{_NIBBLES}][strpos('0123456789abcdef', h)]), '') AS bits FROM r)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
  CASE k WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM b"""
