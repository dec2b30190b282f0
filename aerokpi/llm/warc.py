"""WARC archives written and read as tables of record chunks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.llm.common import written
from aerokpi.llm.heavy import keep_first
from aerokpi.llm.exact_dedup import CAPACITY

#: Payload bytes of one record; what is longer continues in further segments.
SEGMENT_BYTES = 256 << 10
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 100
END = b"\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'record:{key}')}>"


def segments(payload: bytes | memoryview, size: int) -> Iterator[memoryview]:
    """Slices of at most `size` bytes that end between UTF-8 characters (at least one slice)."""
    view, at = memoryview(payload), 0
    while True:
        to = min(len(view), at + size)
        while at < to < len(view) and view[to] & 0xC0 == 0x80:
            to -= 1
        yield view[at:to]
        at = to
        if at >= len(view):
            return


def record_texts(key: str | None, url: str | None, payload: memoryview, digest: str, first: str | None, is_revisit: bool,
                 date: str, size: int) -> Iterator[str]:
    """The records of one page, each without its closing line ends: one response and the
    segments that continue it, or one revisit without a payload."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n").encode()
    parts = [payload[:0]] if is_revisit else list(segments(payload, max(4, size)))
    for n, part in enumerate(parts, 1):
        block = (http if n == 1 else b"") + part
        own = record_id(key) if n == 1 else record_id(f"{key}/{n}")
        lines = ["WARC/1.1", f"WARC-Type: {('revisit' if is_revisit else 'response') if n == 1 else 'continuation'}",
                 f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
        if key is not None:
            lines.append(f"X-Record-Key: {quote(key)}")
        if n == 1:
            if url is not None:
                lines.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127))))
            lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
        if is_revisit:
            lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: {record_id(first)}"] + ([] if first is None else [f"X-Refers-To-Key: {quote(first)}"])
        if len(parts) > 1:
            lines.append(f"WARC-Segment-Number: {n}")
            if n > 1:
                lines.append(f"WARC-Segment-Origin-ID: {record_id(key)}")
            if n == len(parts):
                lines.append(f"WARC-Segment-Total-Length: {len(http) + len(payload)}")
        yield "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n" + bytes(block).decode()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT_BYTES, segment: int = SEGMENT_BYTES,
                   capacity: int = CAPACITY) -> None:
    """Write every row as WARC records into gzip archives below `path`, one per task.

    Of rows with equal payloads of at least `min_revisit` bytes, that with the smallest id
    is a response and the others revisit it; shorter payloads are all responses. Payloads
    are compared by SHA-256, and only ids and digests are grouped (frequent digests apart,
    see `keep_first`). A payload beyond `segment` bytes is written as segments, so no record
    holds more. A null payload is empty; a null id sorts last; repeated rows of the id that
    stays are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    narrow = written(pages.where(F.octet_length(payload) >= min_revisit).select(
        F.col(id_col).alias("id"), F.unhex(digest).alias("digest")), "payloads")
    same = keep_first(narrow, "digest", [F.col("id").isNull(), F.col("id")], "id", narrow.count(), capacity)
    again = same.where(~F.col("id").eqNullSafe(F.col("first"))).select(
        F.col("id").alias("again_id"), F.lower(F.hex("digest")).alias("again_digest"), F.col("first"),
        F.lit(True).alias("is_revisit")).distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), digest.alias("digest"))
    rows = rows.join(again, rows["id"].eqNullSafe(F.col("again_id")) & (rows["digest"] == F.col("again_digest")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, url, body, sha, first, is_revisit in zip(*(batch.column(i) for i in range(6))):
                texts: list[str] = []
                held = 0
                view = memoryview(body.as_buffer())
                for text in record_texts(key.as_py(), url.as_py(), view, sha.as_py(), first.as_py(), bool(is_revisit.as_py()), date, segment):
                    texts.append(text)
                    held += len(text)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
                        texts, held = [], 0
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    rows.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("first").cast("string"), "is_revisit") \
        .mapInArrow(work, "value string").write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


class RecordParser:
    """Turns the pieces between blank lines, in file order, into chunks of records."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None  # of the record being read
        self.left = 0  # bytes of its block still to come
        self.http = b""  # of a first segment, until its blank line
        self.in_http = False
        self.key: str | None = None
        self.sha, self.number, self.n_bytes = hashlib.sha256(), 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """Rows: key, record id, chunk number, chunk, bytes so far, digest so far, is last,
        type, full payload bytes, full digest, key referred to."""
        if self.head is None:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                return
            first, *lines = piece.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
            self.head = dict(x.split(": ", 1) for x in lines)
            self.left = int(self.head["Content-Length"])
            self.in_http = self.head["WARC-Type"] != "continuation"
            if self.in_http:
                self.http, self.start, self.sha, self.number, self.n_bytes = b"", self.head, hashlib.sha256(), 0, 0
            if not self.left:
                yield from self.close()
            return
        data = (piece + END)[: self.left]
        self.left -= len(data)
        if self.in_http:
            self.http, data, self.in_http = data, b"", False
        if data:
            self.sha.update(data)
            self.n_bytes += len(data)
            self.number += 1
            last = not self.left and self.final()
            yield self.row(data, last)
            if not self.left:
                self.head = None
        elif not self.left:
            yield from self.close()

    def final(self) -> bool:
        head = self.head or {}
        return "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head

    def close(self) -> Iterator[tuple]:
        if self.final():
            self.number += 1
            yield self.row(b"", True)
        self.head = None

    def row(self, data: bytes, last: bool) -> tuple:
        fields = dict(x.split(": ", 1) for x in self.http.decode().split("\r\n") if ": " in x)
        return (self.start.get("X-Record-Key"), self.start["WARC-Record-ID"], self.number, data, self.n_bytes, self.sha.hexdigest(), last,
                self.start["WARC-Type"], int(fields.get("Content-Length", 0)),
                self.start["WARC-Payload-Digest"].removeprefix("sha256:"), self.start.get("X-Refers-To-Key"))


CHUNK_SCHEMA = ("record_key string, record_id string, chunk_no long, chunk binary, bytes_so_far long, sha256_so_far string, "
                "is_last boolean, record_type string, payload_bytes long, payload_digest string, refers_to_key string")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunk table of gzip archives: one row per chunk of a payload, numbered from 1, with
    the byte count and SHA-256 of the payload up to there; the last (of an empty payload or a
    revisit: the only) chunk is marked. Archives are streamed by Spark's text reader; a gzip
    file is never split, and a task holds one batch of pieces, never a whole record."""
    from urllib.parse import unquote

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = RecordParser()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(),
                 pa.int64(), pa.string(), pa.string()]
        names = [x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for piece in batch.column(0):
                for row in parser.feed(memoryview(piece.as_buffer()).tobytes()):
                    held += len(row[3])
                    rows.append((None if row[0] is None else unquote(row[0]), row[1], row[2], row[3] if with_payload else None, *row[4:10],
                                 None if row[10] is None else unquote(row[10])))
                    if held > 4 << 20 and with_payload or len(rows) >= 20_000:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return spark.read.option("lineSep", END.decode()).text(path).mapInArrow(work, CHUNK_SCHEMA)


def archived(spark: SparkSession, path: str, id_col: str, id_type: str) -> DataFrame:
    """One row per record of the archives: id, payload_bytes, payload_digest (both of the full
    payload; of a response as read, of a revisit as stated), record_type, refers_to."""
    last = read_archives(spark, path, with_payload=False).where("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("record_key").cast(id_type).alias(id_col),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha256_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("refers_to_key").cast(id_type).alias("refers_to"))
