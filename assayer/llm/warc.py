"""WARC archives: writing captures, reading records, assembling transactions.

An archive is text written by Spark, gzipped, one record behind the other; the
line separator of the writer is the blank line that ends a record. Each capture
gives a request, a response (or revisit) and a metadata record, which name each
other in WARC-Concurrent-To. Reading takes one file at a time, record by record
by Content-Length, so payloads may hold anything.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.llm import words
from assayer.session import durable

VERSION, END = "WARC/1.1", "\r\n"
RECORDS = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, headers map<string,string>, block_bytes bigint, payload_bytes bigint, payload_sha1 string"


def _base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hexadecimal, 40 bits at a time."""
    eights = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last line end; header values must be one line."""
    length = F.octet_length(block).cast("string")
    head = [F.lit(f"{VERSION}{END}WARC-Type: {kind}{END}")]
    for name, value in [*fields, ("Content-Length", length)]:
        head.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(""))
    return F.concat(*head, F.lit(END), block, F.lit(END))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with what their records need: payload, sha1, first (smallest page_id
    with this payload) and whether the page revisits it."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumn("sha1", F.sha1("html"))
    again = durable(keyed.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("__n")).where("__n > 1").select("sha1", "first"))
    return keyed.join(again, "sha1", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one trio of records per page to gzipped files under ``path``.

    The capture's name holds its page_id and a number that is unique in the job,
    so rows that repeat an id stay apart; a file is committed whole, so a trio is
    never torn or written twice when a task runs again. A page whose payload
    equals that of a page with a smaller id becomes a revisit without payload.
    A null html is an empty payload; line ends in a url become blanks.
    """
    rows = captures(pages).withColumn("name", F.concat(F.lit("urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.monotonically_increasing_id().cast("string")))
    name = lambda part: F.concat(F.lit("<"), F.col("name"), F.lit(f":{part}>"))
    uri = F.regexp_replace("url", "[\r\n]", " ")
    host = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    digest = F.concat(F.lit("sha1:"), _base32(F.col("sha1")))
    size = F.octet_length("html").cast("string")
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit("2026-01-01T00:00:00Z"))]
    request = _record("request", [("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", name("main")), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    main = [("WARC-Record-ID", name("main")), *common, ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest)]
    response = _record("response", main, F.concat(head, F.col("html")))
    refers = [("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))]
    revisit = _record("revisit", [*main, *refers], head)
    metadata = _record("metadata", [("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", name("main")), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), size, F.lit("\r\n")))
    text = F.concat(request, F.lit(END), F.when(F.col("revisit"), revisit).otherwise(response), F.lit(END), metadata)
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 10_000).text(path)


def _stream(raw: bytes) -> Iterator[bytes]:
    """Unpacked pieces of a file of one or more gzip members, or of a plain file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        unzip = zlib.decompressobj(31)
        view = memoryview(raw)
        for low in range(0, len(raw), 1 << 20):
            yield unzip.decompress(view[low : low + (1 << 20)])
        yield unzip.flush()
        raw = unzip.unused_data if unzip.eof else b""


class _Reader:
    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held, self.at = self.held[self.at :] + piece, 0
                return True
        return False

    def head(self) -> list[str] | None:
        while True:
            while self.held[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0 and end > self.at:
                lines = self.held[self.at : end].decode("utf-8", "replace").split("\r\n")
                self.at = end + 4
                return lines
            if not self._more():
                return None

    def block(self, size: int) -> bytes:
        parts = []
        while size:
            part = self.held[self.at : self.at + size]
            parts.append(part)
            size -= len(part)
            self.at += len(part)
            if size and not self._more():
                raise ValueError("a record ends before its Content-Length")
        return b"".join(parts)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of a file."""
    reader = _Reader(_stream(raw))
    while (lines := reader.head()) is not None:
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, reader.block(int(headers["content-length"]))


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payload

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for content in batch.column("content"):
            for headers, block in records(content.as_py()):
                kind = headers.get("warc-type", "")
                body = block
                if kind in ("response", "revisit", "request") and headers.get("content-type", "").startswith("application/http"):
                    body = block.partition(b"\r\n\r\n")[2]
                if kind == "metadata":
                    headers |= {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
                sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                yield (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, list(headers.items()), len(block), len(body), sha1, *([body] * payload))

    for batch in batches:
        held, size = [], 0
        for row in rows_of(batch):
            held.append(row)
            size += row[7] if payload else 0
            if len(held) >= 1000 or size > 4 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; payloads only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return words.small_batches(files).mapInArrow(partial(_read, payload=payload), RECORDS + ", payload binary" * payload)


def transactions(recs: DataFrame) -> DataFrame:
    """One row per capture: request, main (response or revisit) and metadata.

    Requests and metadata name their main record in WARC-Concurrent-To; a main
    record without one of them has a null there, and a record that names no main
    record in the archives gives no row. Grouping by the main record's id joins
    all three in one shuffle; ids are unique, so groups have three rows.
    """
    whole = F.struct(*[c for c in recs.columns])
    is_main = F.col("record_type").isin("response", "revisit", "resource")
    keyed = recs.select(F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"), "record_type", whole.alias("r"))
    pick = lambda cond: F.first(F.when(cond, F.col("r")), ignorenulls=True)
    out = keyed.where("capture_id is not null").groupBy("capture_id").agg(
        pick(F.col("record_type").isin("response", "revisit", "resource")).alias("main"), pick(F.col("record_type") == "request").alias("request"), pick(F.col("record_type") == "metadata").alias("metadata")
    )
    return out.where("main is not null")
