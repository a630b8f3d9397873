"""WARC archives: written from page rows, read back, and assembled into one row per capture.

Each page gives three records: a request, a response (or a revisit, if a page with a smaller key
has the same payload; it names that page's response record in WARC-Refers-To) and metadata.
Request and metadata name the response in WARC-Concurrent-To; the reader joins the three through
it and emits one nested row per capture.

Archives are plain WARC/1.1 files in a folder that all executors share. Spark's text writer
makes them (its separator is the blank line that ends a record), so files appear only when
their task is committed, and a lost executor's are written anew. Files hold at most
`records_per_file` records of payloads up to `large_bytes`, and one capture of a larger payload,
which bounds their bytes; the reader takes one file at a time into a task and parses it once: the
records are stored before they are joined. Digests are made twice, from the payloads where they
are: moving payloads or storing them again would cost more.

Edge cases: a null payload is empty; null urls are written as an empty target; rows that repeat
key, url and payload are one set of records and are given back as often as they came; equal
payloads are told by SHA-1, ties in the key are all responses; payloads may hold blank lines or
look like WARC records, as lengths are followed; a response without its request or metadata stays, with
nulls for them; an empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.batches import map_texts
from evalframe.llm.common import discard, materialize, new_path

_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


@dataclass(frozen=True)
class Settings:
    records_per_file: int = 3000
    large_bytes: int = 200_000
    date: str = "2024-01-01T00:00:00Z"
    min_revisit_bytes: int = 0  # payloads below this size are always written in full


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    name = "\x1f".join("" if p is None else str(p) for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>"


def _record(kind: str, ident: str, uri: str, mime: str, body: str, headers: list[tuple[str, str]], date: str) -> str:
    """One record without the blank line that ends it."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        *(f"{k}: {v}" for k, v in headers), f"Content-Type: {mime}", f"Content-Length: {len(body.encode())}",
    ]
    return "\r\n".join(lines) + "\r\n\r\n" + body


def target(url: str | None) -> str:
    return re.sub(r"[\r\n]", "", url or "")


def capture_records(key: object, url: str | None, html: str | None, digest: str, first: dict | None, copies: int, date: str) -> list[str]:
    """The response, or the revisit of the first page (key, url) of that payload, the request and the metadata of one page row."""
    uri = target(url)
    payload = html or ""
    size = len(payload.encode())
    main = record_id(key, url, digest, "response")
    host, _, path = re.sub(r"^[a-zA-Z]+://", "", uri).partition("/")
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    told = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        body = f"{status}Content-Length: {size}\r\n\r\n{payload}"
        held = _record("response", main, uri, "application/http;msgtype=response", body, told, date)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        told += [("WARC-Profile", profile), ("WARC-Refers-To", record_id(first["key"], first["url"], digest, "response"))]
        told += [("WARC-Refers-To-Target-URI", target(first["url"])), ("WARC-Refers-To-Date", date)]
        held = _record("revisit", main, uri, "application/http;msgtype=response", status + "\r\n", told, date)
    near = [("WARC-Concurrent-To", main)]
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n"
    named = "" if key is None else f"pageId: {quote(str(key), safe='')}\r\n"
    facts = f"{named}payloadBytes: {size}\r\ncopies: {copies}\r\n"
    return [
        held,
        _record("request", record_id(main, "request"), uri, "application/http;msgtype=request", ask, near, date),
        _record("metadata", record_id(main, "metadata"), uri, "application/warc-fields", facts, near, date),
    ]


def write_archives(pages: DataFrame, cfg: Settings = Settings(), path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the pages' records and return the folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")

    def digests():
        return lambda texts: [
            pa.array([sha1_base32(t or b"") for t in texts]), pa.array([len(t or b"") for t in texts], pa.int64())
        ]

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    named = map_texts(rows, digests, "digest string, size bigint", ["key", "url"], "html")
    named = materialize(named.groupBy("key", "url", "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "digests")
    first = named.where(F.col("size") >= cfg.min_revisit_bytes).groupBy("digest").agg(F.min(F.struct("key", "url")).alias("first"), F.max("key").alias("last"))
    # Only rows that differ from the plain case travel to the payloads: revisits and repeated rows.
    # Stored, so that the join with it can split the partition of a payload with very many copies.
    first = materialize(first.where("first.key <> last"), "first")
    odd = named.join(first.hint("merge"), "digest", "left").select(
        "key", "url", "digest", "copies", F.when(F.col("key") > F.col("first.key"), F.col("first")).alias("first")
    )
    odd = materialize(odd.where("copies > 1 or first is not null"), "revisits")
    n_odd = odd.count()

    def with_digests(rows: DataFrame) -> DataFrame:
        full = map_texts(rows, digests, "digest string, size bigint", ["key", "url", "html"], "html")
        same = (full.key.eqNullSafe(odd.key)) & (full.url.eqNullSafe(odd.url)) & (full.digest == odd.digest)
        return full.join(F.broadcast(odd) if n_odd <= 200_000 else odd.hint("merge"), same, "left").select(
            full.key, full.url, full.html, full.digest, odd["first"], F.coalesce(odd.copies, F.lit(1)).alias("copies")
        )

    date = cfg.date

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, cols = [], [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                out += capture_records(*row, date)
                if len(out) >= 600:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size = F.coalesce(F.octet_length("html"), F.lit(0))
    # Large payloads apart, one capture a file; told apart before they are hashed, so that each is hashed by one of the two.
    for part, most in ((rows.where(size <= cfg.large_bytes), cfg.records_per_file), (rows.where(size > cfg.large_bytes), 3)):
        out = with_digests(part).mapInArrow(records, "value string").write.mode("append")
        out.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)
    discard(named, first, odd)
    return path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record; lengths are followed, blank lines between records skipped."""
    at, view = 0, memoryview(data)
    while at < len(data):
        start = data.find(b"WARC/", at)
        if start < 0:
            return
        end = data.index(b"\r\n\r\n", start) + 4
        first = data.index(b"\r\n", start) + 2
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data[first : end - 2])}
        size = int(headers["content-length"])
        yield headers, view[end : end + size]
        at = end + size


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records, parsed once and stored: kind, record_id, concurrent_to, uri, fields, and of responses the payload and its digest as read.

    fields: of metadata as they are, of requests method, path and protocol.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    names = ["kind", "record_id", "concurrent_to", "uri", "told_digest", "refers_to", "read_digest", "read_bytes", "fields", "payload"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_archive(content.as_py()):
                    kind, digest, size, payload, fields = h["warc-type"], None, None, None, None
                    if kind == "response":
                        raw = bytes(block)
                        body = raw[raw.index(b"\r\n\r\n") + 4 :]
                        digest, size = sha1_base32(body), len(body)
                        payload = body.decode() if with_payload else None
                    elif kind == "metadata":
                        fields = [(k.decode(), unquote(v.decode()) if k == b"pageId" else v.decode()) for k, v in _HEADER.findall(bytes(block))]
                    elif kind == "request":
                        line = bytes(block[: bytes(block).index(b"\r\n")]).decode()
                        fields = list(zip(("method", "path", "protocol"), (line.split(" ", 1)[0], *line.split(" ", 1)[1].rsplit(" ", 1))))
                    told = h.get("warc-payload-digest")
                    refers = h.get("warc-refers-to")
                    rows.append((
                        kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"),
                        told and told.removeprefix("sha1:"), refers,
                        digest, size, fields, payload,
                    ))
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = ", ".join(f"{n} string" for n in names[:7]) + ", read_bytes bigint, fields map<string,string>, payload string"
    return materialize(files.mapInArrow(parse, schema), "records")


def assemble(records: DataFrame, key_type: str = "bigint") -> DataFrame:
    """One nested row per capture: page_id (of key_type, null if the page had none), url, response, request, metadata; repeated as often as it was captured.

    A response without its request or metadata is kept, with nulls for them.
    """
    main = records.where("kind in ('response', 'revisit')").select(
        "record_id", "uri",
        F.struct("kind", "record_id", "told_digest", "refers_to", "read_digest", "read_bytes", "payload").alias("response"),
    )
    # Repeated rows wrote equal records; one of each is joined and the copies come back at the end.
    main = main.dropDuplicates(["record_id"])
    ask = records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "uri", "fields").alias("request"))
    facts = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "fields").alias("metadata"))
    whole = main.join(ask.dropDuplicates(["record_id"]).hint("merge"), "record_id", "left")
    whole = whole.join(facts.dropDuplicates(["record_id"]).hint("merge"), "record_id", "left")
    copies = F.greatest(F.coalesce(F.col("metadata.fields")["copies"].cast("int"), F.lit(1)), F.lit(1))
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return whole.select(
        F.col("metadata.fields")["pageId"].cast(key_type).alias("page_id"), F.col("uri").alias("url"), "response", "request", "metadata"
    )


def with_referred(captures: DataFrame) -> DataFrame:
    """captures plus refers_to: the page_id of the response that a revisit's WARC-Refers-To names; null for responses."""
    captures = materialize(captures, "captures")
    named = captures.where("response.kind = 'response'").select(F.col("response.record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    # Stored, so that the join can split the partition of a response that very many revisits name.
    named = materialize(named.dropDuplicates(["_id"]), "responses")
    return captures.join(named.hint("merge"), F.col("response.refers_to") == F.col("_id"), "left").drop("_id")


def payload_facts(captures: DataFrame) -> tuple[Column, Column]:
    """Bytes and digest of a capture's full payload: as read from a response, as told of a revisit."""
    size = F.coalesce(F.col("response.read_bytes"), F.col("metadata.fields")["payloadBytes"].cast("long"))
    return size, F.coalesce("response.read_digest", "response.told_digest")
