"""Operator 8, WARC archives: writing captures and reading them back as transactions.

A capture is three records, a request, a response (or a revisit of an equal payload seen before)
and metadata. The request and the metadata name the response in WARC-Concurrent-To. Reading parses
records by Content-Length, joins the three by that identifier and gives one nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import partitions_for, stable, write_table

CRLF = "\r\n"
#: Payloads shorter than this many bytes are always stored.
REVISIT_BYTES = 100
#: Bytes of payloads in a file, about, so that one task can read it.
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, block binary"


def plan_captures(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row per page: rid, page_id, uri, body, n, digest, of_id and of_rid (the response that this page
    revisits, else null), dealt into partitions of file_bytes of bodies or so. Equal payloads are found
    by SHA-256 and length, without their bodies; a body is shuffled once, by rid, which is never a hot key."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = stable(pages, F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("n"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    light = write_table(rows.select("rid", "page_id", "n", "digest"), "payloads")
    long = light.where(F.col("n") >= REVISIT_BYTES)
    # Written, so that the join can split a payload that is in a large part of the rows.
    first = write_table(long.groupBy("digest", "n").agg(F.min(F.struct("page_id", "rid")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "first")
    again = long.join(first, ["digest", "n"]).where(F.col("first.rid") != F.col("rid")).select("rid", F.col("first.page_id").alias("of_id"), F.col("first.rid").alias("of_rid"))
    size = light.agg(F.sum("n")).first()[0] or 0
    files = max(partitions_for(pages), -(-size // file_bytes))
    return rows.repartition(files, "rid").join(again.repartition(files, "rid"), "rid", "left").select("rid", "page_id", "uri", "body", "n", "digest", "of_id", "of_rid")


def record_id(kind: str, rid: Column) -> Column:
    d = F.md5(F.concat_ws(":", F.lit(kind), rid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, rid: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without its closing empty lines. Headers that are null are left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields], F.lit(CRLF), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of pages.

    A null body is an empty payload, a null uri an empty one; white space in a uri is percent-coded
    as it would end the header. Of equal payloads of REVISIT_BYTES or more that with the smallest
    id is the response, others are revisits without the payload; of rows that repeat the id too,
    one is the response. A null id is the smallest. Other columns, whatever their names, are not read. An
    empty table gives an archive without records. A body may have up to a gigabyte, as a row holds it.
    """
    rows = plan_captures(pages, id_col, uri_col, body_col, file_bytes)
    revisit = F.col("of_rid").isNotNull()
    response = F.when(revisit, record_id("revisit", F.col("rid"))).otherwise(record_id("response", F.col("rid")))
    uri = ("WARC-Target-URI", F.regexp_replace("uri", r"\s", "%20"))
    head = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF)
    stored = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    request = F.concat(F.lit("GET / HTTP/1.1" + CRLF + "X-Target: "), uri[1], F.lit(CRLF + CRLF))
    meta = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    records = rows.select(
        F.explode(
            F.array(
                _record(F.lit("request"), record_id("request", F.col("rid")), [uri, ("WARC-Concurrent-To", response)], "application/http;msgtype=request", request),
                _record(
                    F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), response,
                    [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", record_id("response", F.col("of_rid")))],
                    "application/http;msgtype=response", stored,
                ),
                _record(F.lit("metadata"), record_id("metadata", F.col("rid")), [uri, ("WARC-Concurrent-To", response)], "application/warc-fields", meta),
            )
        ).alias("value")
    )
    # The two empty lines that end a record are the writer's separator.
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse_warc(content: bytes, blocks: bool = True) -> Iterator[dict]:
    """The records of one archive file, as rows of RECORD, one after the other: of what is compressed
    no more than a record is held. The block of a response or revisit is what follows its HTTP head
    (null without blocks); other blocks are whole."""
    import gzip
    import hashlib
    import io

    stream = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if content[:2] == b"\x1f\x8b" else stream
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            if line.strip():
                raise ValueError(f"no record begins with {line[:40]!r}")
            continue
        head = {}
        while (line := stream.readline()).strip(b"\r\n"):
            name, _, value = line.rstrip(b"\r\n").decode().partition(": ")
            head[name] = value
        n, kind = int(head["Content-Length"]), head["WARC-Type"]
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"{head['WARC-Record-ID']}: {len(block)} bytes of {n}")
        digest, size = None, None
        if kind in ("response", "revisit"):
            block = block.partition(b"\r\n\r\n")[2]
            digest = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
            if kind == "response":
                size = len(block)
                if digest != (found := hashlib.sha256(block).hexdigest()):
                    raise ValueError(f"{head['WARC-Record-ID']}: payload has digest {found}, not {digest}")
        yield {"record_id": head["WARC-Record-ID"], "type": kind, "target_uri": head.get("WARC-Target-URI", ""), "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to": head.get("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": size, "block": block if blocks or digest is None else None}


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row of RECORD per record of the archive files below path. Without blocks, payloads are
    checked and measured but not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                some, size = [], 0
                for record in parse_warc(content.as_py(), blocks):
                    some.append(record)
                    size += len(record["block"] or b"")
                    if len(some) == 1000 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                yield pa.RecordBatch.from_pylist(some, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, and the structs request, response and metadata. The request and
    the metadata are found through their WARC-Concurrent-To; one that is missing gives null. A
    revisit gets the payload size of the response that it refers to, and of_page_id, whose page
    that was."""
    whole = F.struct("record_id", "type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "block")
    part = lambda kind: records.where(F.col("type") == kind)
    page = F.nullif(F.regexp_extract(F.col("block").cast("string"), r"page_id: (-?\d+)", 1), F.lit("")).cast("long")
    requests = part("request").select(F.col("concurrent_to").alias("key"), whole.alias("request"))
    metadata = part("metadata").select(F.col("concurrent_to").alias("key"), whole.alias("metadata"), page.alias("page_id"))
    responses = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("key"), whole.alias("response"))
    captures = responses.join(requests, "key", "left").join(metadata, "key", "left")
    # Only responses that are referred to, written, so that the join can split one that many revisits name.
    named = part("revisit").select(F.col("refers_to").alias("of")).distinct()
    first = part("response").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("of_bytes")).join(named, "of", "left_semi")
    first = write_table(first.join(metadata.select(F.col("key").alias("of"), F.col("page_id").alias("of_page_id")), "of", "left"), "referred")
    # What refers to nothing is dealt out by its own id, and not by null.
    refers = F.when(F.col("response.type") == "revisit", F.col("response.refers_to"))
    return captures.withColumn("refers", F.coalesce(refers, F.col("key"))).join(first, F.col("refers") == F.col("of"), "left").select(
        "page_id", "request", F.col("response").withField("payload_bytes", F.coalesce("response.payload_bytes", "of_bytes")).alias("response"), "metadata", F.when(refers.isNotNull(), F.col("of_page_id")).alias("of_page_id")
    )
