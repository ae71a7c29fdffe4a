"""WARC archives and the monolithic gzip normaliser.

Records are written into archives that are one gzip stream each, as some crawlers leave them: nothing in them can be
reached without inflating all before it. The normaliser inflates such a stream once, chunk by chunk, finds the records
by their Content-Length, writes every record as a gzip member of its own and notes (record id, offset, length) in a
sidecar index. A reader then takes any record by its index row alone.

Archives and indexes are rows of Parquet tables in the shared folder (name, content; name, record, offset, length), so
that they live in whatever store the cluster has. An archive is closed when its records reach ``archive_bytes``;
partitions are streamed and hold one archive at most. Payloads with equal bytes are written once (response), by the
largest id; the others refer to it (revisit). The largest id by digest is a partial aggregate; the rows of a frequent
digest are split by the engine's skew join.

Cases: null payloads are empty; payloads shorter than ``revisit_from`` bytes are never revisits; repeated rows are
written each: of equal ids with equal payloads the first is no revisit of itself, so all are responses; null ids are
written as an empty id and are never referred to; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

ARCHIVE_BYTES = 8 << 20
REVISIT_FROM = 1000
LEVEL = 1


def record_bytes(record_id: str, url: str | None, kind: str, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, whole with their closing blank line, one at a time."""
    held = bytearray()
    need = -1
    for chunk in stream:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = [x for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = end + 4 + int(size[0].split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("archive ends inside a record")


def inflate(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file's bytes in chunks, whether it has one member or many; each byte is inflated once."""
    at = 0
    unzip = zlib.decompressobj(31)
    while at < len(content):
        out = unzip.decompress(content[at : at + step])
        at += step
        while out or unzip.eof:
            if out:
                yield out
            if not unzip.eof:
                break
            rest = unzip.unused_data
            unzip = zlib.decompressobj(31)
            out = unzip.decompress(rest) if rest else b""
            if not rest:
                break


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(content: bytes, level: int = LEVEL) -> tuple[bytes, list[tuple[str, int, int]]]:
    """A monolithic archive as one member a record, and its index (record id, offset, length)."""
    out, index = bytearray(), []
    for record in records_of(inflate(content)):
        head, _ = parse_record(record)
        member = gzip_member(record, level)
        index.append((head["warc-record-id"], len(out), len(member)))
        out += member
    return bytes(out), index


def read_member(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse_record(zlib.decompress(content[offset : offset + length], 31))


def with_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """pages (page_id, url, payload) with digest, size, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    same = rows.where(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(materialise(same, "warc-repeated"), ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_monolithic(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives (content) of the rows of with_revisits(), each one gzip stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, size = zlib.compressobj(level, zlib.DEFLATED, 31), bytearray(), 0
        text = lambda x: "" if x is None else str(x)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "record_type", "digest", "size", "refers_to", "payload")]
            for i in range(batch.num_rows):
                page, url, kind, digest, n, refers, payload = (c[i].as_py() for c in columns)
                data = record_bytes(text(page), url, kind, digest, n, text(refers), payload)
                out += z.compress(data)
                size += len(data)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([bytes(out + z.flush())], pa.binary())})
                    z, out, size = zlib.compressobj(level, zlib.DEFLATED, 31), bytearray(), 0
        if size:
            yield pa.RecordBatch.from_pydict({"content": pa.array([bytes(out + z.flush())], pa.binary())})

    return rows.mapInArrow(write, "content binary")


def normalise_archives(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Archives with a member a record and their sidecar index: content, index array<struct<record, offset, length>>."""
    schema = "content binary, index array<struct<record: string, offset: bigint, length: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for content in batch.column("content"):
                out, index = normalise(content.as_py(), level)
                found = [{"record": r, "offset": o, "length": n} for r, o, n in index]
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), pa.array([found], kind)], ["content", "index"])

    return archives.mapInArrow(run, schema)


def read_records(archives: DataFrame) -> DataFrame:
    """Every record by its index row: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    import hashlib

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content, index in zip(batch.column("content"), batch.column("index")):
                data, rows, held = content.as_py(), [], 0
                for x in index.as_py():
                    head, payload = read_member(data, x["offset"], x["length"])
                    kind = head["warc-type"]
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if f"sha1:{digest}" != head["warc-payload-digest"]:
                            raise ValueError(f"digest of {x['record']} is wrong")
                    else:
                        size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((bare(head["warc-record-id"]), head["warc-target-uri"], kind, size, digest, bare(head.get("warc-refers-to")), payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return archives.select("content", "index").mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    plain = materialise(write_monolithic(with_revisits(pages)), "warc-monolithic")
    read = read_records(materialise(normalise_archives(plain), "warc-normalised"))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long").alias(c)
    return read.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
e AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM e
"""
