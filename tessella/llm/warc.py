"""WARC archives: written from pages, read back and assembled into one nested row per capture.

A capture is a request record, a response or revisit record and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Reading yields one row per record; the transaction
of a record is found by following concurrent-to links (at most two, so that metadata may also name
the request, and either of request and response may be the one that is named), then the records of
a transaction become one nested row. Records are gzip members of shard files. Executors write to a
name of their own and then move the file.

Defined cases: a null html is an empty payload; payloads under min_revisit bytes are never revisits;
a page with a null id is a response; pages with equal ids and payloads are separate captures; an
empty table gives an archive without files. A record without a known transaction is one of its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.skew import split_join
from tessella.llm.storage import bounded_batches

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, record_id string, type string, concurrent_to string, refers_to string, uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + 2 * CRLF + block + 2 * CRLF) + gz.flush()


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def with_originals(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """id, uri, payload, digest and original: the least id with an equal payload, if it isn't the row's own."""
    slim = pages.select(F.col("id"), F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(f"n >= {min_revisit}").drop("n")
    least = slim.groupBy("digest").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = split_join(slim, least, "digest", "c", "id", "inner").where("id > original").distinct()
    # Rows go by id and digest, so that pages without ids are spread, too.
    return pages.withColumn("digest", F.sha2("payload", 256)).join(later, ["id", "digest"], "left")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """Writes pages as captures to path (a URI that pyarrow.fs opens on every executor); returns the list of files."""
    spark = pages.sparkSession
    bounded_batches(spark, 512)
    where, folder = pafs.FileSystem.from_uri(path)
    where.create_dir(folder, recursive=True)
    pages = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = with_originals(pages, id_col, payload_col, min_revisit).select("id", "uri", "payload", "digest", "original")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, own, n = TaskContext.get().partitionId(), None, uuid.uuid4().hex, 0
        fs, base = pafs.FileSystem.from_uri(path)
        seen: Counter = Counter()
        for batch in batches:
            out = out or fs.open_output_stream(f"{base}/_{own}")
            for page, uri, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                seen[page, digest] += 1
                again = f":{number}.{seen[page, digest]}" if seen[page, digest] > 1 or page is None else ""
                me = f"<urn:page:{page}:{digest[:16]}{again}:"
                common = {"WARC-Target-URI": one_line(uri)}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                said = common | {"WARC-Record-ID": me + "response>", "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
                if original is None:
                    out.write(record("response", said, http + payload))
                else:
                    said |= {"WARC-Refers-To": f"<urn:page:{original}:{digest[:16]}:response>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.write(record("revisit", said, http))
                link = common | {"WARC-Concurrent-To": me + "response>"}
                out.write(record("request", link | {"WARC-Record-ID": me + "request>", "Content-Type": "application/http;msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"))
                fields = {} if page is None else {"page-id": page}
                out.write(record("metadata", link | {"WARC-Record-ID": me + "metadata>", "Content-Type": "application/warc-fields"}, "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()))
                n += 1
        if out:
            out.close()
            name = f"pages-{number:06d}.warc.gz"
            fs.move(f"{base}/_{own}", f"{base}/{name}")
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "captures"])

    done = rows.mapInArrow(write, "file string, captures long").collect()
    return spark.createDataFrame([(f"{path}/{r.file}", r.captures) for r in done], "file string, captures long")


def members(stream: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members; memory holds one."""
    gz, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(gz.decompress(data))
            data = gz.unused_data if gz.eof else b""
            if gz.eof:
                yield b"".join(parts)
                gz, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def fields_of(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(CRLF) if b":" in line)
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in pairs}


def parse(data: bytes) -> Iterator[dict]:
    """The records in one member's bytes."""
    at = 0
    while at < len(data):
        stop = data.index(2 * CRLF, at)
        head = fields_of(data[at:stop])
        begin, size = stop + 4, int(head["content-length"])
        if begin + size > len(data):
            raise ValueError("the archive ends inside a record")
        block, at = data[begin : begin + size], begin + size + 4
        kind, said = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        out = {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "payload_digest": said, "payload_bytes": None, "fields": None, "payload": None}
        if kind == "response":
            payload = block.partition(2 * CRLF)[2]
            found = hashlib.sha256(payload).hexdigest()
            if said and found != said:
                raise ValueError(f"{out['record_id']}: the payload's digest is {found}")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
        elif kind == "revisit":  # the length of the payload that isn't repeated
            length = fields_of(block.partition(2 * CRLF)[0]).get("content-length")
            out["payload_bytes"] = int(length) if length else None
        elif kind == "metadata":
            out["fields"] = fields_of(block)
        yield out


def read_records(spark: SparkSession, files: list[str], payloads: bool = True) -> DataFrame:
    """One row per record; payloads are checked against their digests, and left out unless asked for."""
    bounded_batches(spark, 512)
    if not files:
        return spark.createDataFrame([], RECORD)
    types = {"payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    names = ["file", "record_id", "type", "concurrent_to", "refers_to", "uri", "payload_digest", "payload_bytes", "fields", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(files[i])
                with fs.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for data in members(stream):
                        for r in parse(data):
                            size += len(r["payload"] or b"") if payloads else 200
                            rows.append(r | {"file": files[i], "fields": list((r["fields"] or {}).items()) if r["fields"] is not None else None} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 2048 or size > 8 << 20:
                            yield pa.record_batch([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)
                            rows, size = [], 0
                    yield pa.record_batch([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture, request, response (also a revisit) and metadata (an array)."""
    linked = records.where("concurrent_to is not null")
    via = linked.select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("target"))
    capture = (
        F.when(F.col("target").isNull(), F.col("concurrent_to"))
        .when(F.col("target") == F.col("record_id"), F.least("record_id", "concurrent_to"))  # each names the other
        .otherwise(F.col("target"))
    )
    row = F.struct(*(c for c in records.columns if c not in ("concurrent_to", "fields")), "fields").alias("row")
    linked = linked.join(via, F.col("concurrent_to") == F.col("via"), "left").select(capture.alias("capture"), "type", row)
    every = linked.unionByName(records.where("concurrent_to is null").select(F.col("record_id").alias("capture"), "type", row))
    pick = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.col("row")), ignorenulls=True)
    return every.groupBy("capture").agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), F.collect_list(F.when(F.col("type") == "metadata", F.col("row"))).alias("metadata"))


def resolve(captures: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """captures with original: for a revisit the carried values of the capture whose response it refers to, else null.

    A revisit refers to a response's record id (WARC-Refers-To); of repeated record ids any is taken. A reference
    that isn't in the archives, or to a payload of another digest or length, fails the job.
    """
    response = F.col("response")
    kept = captures.withColumn("refers_to", F.when(response["type"] == "revisit", response["refers_to"]))
    values = F.struct(response["payload_digest"].alias("digest"), response["payload_bytes"].alias("bytes"), F.struct(*(c.alias(n) for n, c in carried.items())).alias("values"))
    named = kept.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    originals = captures.where(response["type"] == "response").groupBy(response["record_id"].alias("refers_to")).agg(F.first(values).alias("original"))
    revisits = split_join(kept.where("refers_to is not null"), named.join(originals, "refers_to", "left"), "refers_to", "n", "capture")
    same = (F.col("original.digest") == response["payload_digest"]) & (F.col("original.bytes") == response["payload_bytes"])
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("original.values")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), "refers_to")).cast(originals.schema["original"].dataType["values"].dataType))
    rest = kept.where("refers_to is null").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType["values"].dataType))
    return revisits.withColumn("original", checked).unionByName(rest.select(*revisits.columns)).drop("refers_to")
