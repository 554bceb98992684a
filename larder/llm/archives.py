"""Web archives: a converter from legacy ARC files to WARC, with writers and readers for both.

An ARC file begins with a version block, whose second line names the version; version 1 has five fields in every record
line and version 2 ten, and the last is the declared length of what follows.  Records are cut by that length alone.
The converter gives each one a WARC record id, timestamp, media type, block and payload digest; of records with
equal payloads, the first becomes a response and the others revisits that refer to it.

Archives are written by Spark's text writer, whose line separator is just what ends a record in either format, so they
go to any file system that Spark can write to, a bounded number of records to a file; they are read back as whole files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import text_blocks as tb

RECORDS_PER_FILE = 1000
FILE_BYTES = 64 << 20  # before compression; a file is read back whole, so this and one record bound a task's memory
OUT_BYTES = 1 << 22

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1: every five hex digits are four base32 letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def http_block(body: Column, headers: dict[str, Column]) -> Column:
    """An HTTP response: status line, headers, empty line, body."""
    lines = ["HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"]
    parts: list[Column] = [F.lit(lines[0])]
    for name, value in headers.items():
        parts += [F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")]
    return F.concat(*parts, F.lit("\r\n"), body)


def arc_lines(url: Column, when: Column, block: Column, version: Column) -> Column:
    """A record: its line in the given version, then the block.  White space in the URL is percent-encoded."""
    plain = F.coalesce(url, F.lit("about:blank"))
    for raw, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        plain = F.replace(plain, F.lit(raw), F.lit(code))
    plain = F.when(plain == "", "about:blank").otherwise(plain)
    middle = F.when(version == 1, "").otherwise("200 - - 0 - ")
    return F.concat(
        plain, F.lit(" 0.0.0.0 "), when, F.lit(" text/html "), middle, F.octet_length(block).cast("string"), F.lit("\n"), block
    )


def _with_heads(heads: list[str], records_per_file: int, file_bytes: int):
    """Put a head before every ``records_per_file`` records, where the writer begins a file: in turn, by partition.

    The writer counts records only.  A file that has ``file_bytes`` bytes gets empty records for those still missing: they
    leave nothing but line ends, which readers skip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, head = 0, 0, heads[TaskContext.get().partitionId() % len(heads)]
        for batch in batches:
            column, at = batch.column(0), 0
            lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            while at < len(column):
                if held == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([head], column.type)], names=["value"])
                step = min(len(column) - at, records_per_file - held)
                # The record that crosses the limit still goes in.
                step = min(step, int(np.searchsorted(np.cumsum(lengths[at : at + step]), file_bytes - size)) + 1)
                yield pa.RecordBatch.from_arrays([column.slice(at, step)], names=["value"])
                held, size = held + step, size + int(lengths[at : at + step].sum())
                at += step
                if size >= file_bytes and held < records_per_file:
                    yield pa.RecordBatch.from_arrays([pa.array([""] * (records_per_file - held), column.type)], names=["value"])
                    held = records_per_file
                if held == records_per_file:
                    held = size = 0

    return run


def arc_head(version: int, when: str) -> str:
    body = f"{version} 0 larder\n{ARC_FIELDS[version]}\n"
    extra = "" if version == 1 else "200 - - 0 - "
    return f"filedesc://larder.arc 0.0.0.0 {when} text/plain {extra}{len(body)}\n{body}"


def warc_head(when: str) -> str:
    body = "software: larder\r\nformat: WARC File Format 1.0\r\n"
    return (
        f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: {when}\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000000>"
        f"\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    )


def write_archive(
    records: DataFrame,
    path: str,
    heads: list[str],
    end: str,
    compress: bool,
    per_file: int = RECORDS_PER_FILE,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write one string column of records as archive files, every record ended by ``end``.

    A file is closed after ``per_file`` records or by the record that brings it to ``file_bytes`` bytes.

    Each file begins with a head; of several heads, partitions take one in turn by their number.
    """
    (
        records.mapInArrow(_with_heads(heads, per_file, file_bytes), "value string")
        .write.option("lineSep", end)
        .option("compression", "gzip" if compress else "none")
        .option("maxRecordsPerFile", per_file + 1)
        .text(path)
    )


def arc_records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(fields of the record line, block) of an ARC file, without its version block."""
    version, names, at = None, [], 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].rstrip(b"\r").split(b" ")
        begin, length = stop + 1, int(line[-1])
        block = data[begin : begin + length]
        if len(block) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(block)} are left")
        if version is None:
            if not line[0].startswith(b"filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            about, columns = block.split(b"\n")[:2]
            version = int(about.split(b" ")[0])
            names = columns.decode("ascii").split(" ")
            if version not in ARC_FIELDS or len(names) != len(ARC_FIELDS[version].split(" ")):
                raise ValueError(f"unknown ARC version {version} or fields {names}")
        else:
            # The URL is whatever stands before the fixed number of other fields.
            rest = line[len(line) - len(names) + 1 :]
            if len(rest) != len(names) - 1:
                raise ValueError(f"record line at byte {at} has {len(line)} fields, not {len(names)}")
            fields = dict(zip(names, [b" ".join(line[: len(line) - len(rest)]), *rest], strict=True))
            yield fields | {"version": b"%d" % version}, block
        at = begin + length


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of a WARC file; cut by Content-Length."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, length = stop + 4, int(fields["content-length"])
        block = data[begin : begin + length]
        if len(block) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(block)} are left")
        yield fields, block
        at = begin + length


def _unpacked(data: bytes) -> bytes:
    """Plain bytes of a file that may be gzip, of one member or many."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields by lower-case name, and the body."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _read(spark: SparkSession, path: str, parse, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``parse`` makes of each whole file, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                for row in parse(_unpacked(value.as_py())):
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
                    if held > OUT_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(tb.tidy(run), ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _arc_rows(bodies: bool):
    def parse(data: bytes):
        for fields, block in arc_records(data):
            _, body = payload_of(block)
            row = (
                fields["URL"].decode("utf-8"), fields["IP-address"].decode("ascii"), fields["Archive-date"].decode("ascii"),
                int(fields["version"]), sha1_base32(body), len(body), block[: len(block) - len(body)].decode("latin-1"),
            )
            yield (*row, body) if bodies else row

    return parse


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """url, ip, date (14 digits), version, digest and payload_bytes of the body, http head, and the body unless left out."""
    kinds = dict(
        url=pa.string(), ip=pa.string(), date=pa.string(), version=pa.int32(), digest=pa.string(), payload_bytes=pa.int64(), head=pa.string()
    )
    ddl = "url string, ip string, date string, version int, digest string, payload_bytes long, head string"
    if bodies:
        kinds["body"], ddl = pa.binary(), ddl + ", body binary"
    return _read(spark, path, _arc_rows(bodies), _schema(**kinds), ddl)


def warc_date(arc_date: Column) -> Column:
    """2024-01-02T03:04:05Z of 20240102030405."""
    cut = [F.substring(arc_date, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.concat(cut[0], F.lit("-"), cut[1], F.lit("-"), cut[2], F.lit("T"), cut[3], F.lit(":"), cut[4], F.lit(":"), cut[5], F.lit("Z"))


def record_id(*parts: Column) -> Column:
    """<urn:uuid:...> out of a hash of the parts, so that a repeated run names a record alike."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def http_field(head: str, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)\r\n{re.escape(name)}: *([^\r\n]*)", 1)


def arc_to_warc(spark: SparkSession, arc: str, order: Column, least_bytes: int = 0) -> DataFrame:
    """One column of WARC records for the ARC files at ``arc``.

    Of records whose payloads are equal and of at least ``least_bytes`` bytes, the one that is smallest by ``order``
    (an expression over the columns of ``read_arc``) is a response, the others revisits of it.  The files are read
    twice: once for the digests alone, once with their payloads.  Only payloads that occur twice go into the table of
    first records beside the files; its size is known to Spark when the payloads meet it, so that they need not be
    shuffled where it is small.
    """
    name = record_id(F.col("url"), F.col("date"), F.col("digest"), F.col("head"))
    path = arc.rstrip("/") + "-first-records"
    (
        read_arc(spark, arc, bodies=False)
        .where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(
            F.min(F.struct(order.alias("order"), name.alias("id"), "url", "date")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n > 1")
        .drop("n")
        .write.mode("overwrite")
        .parquet(path)
    )
    firsts = spark.read.parquet(path)
    known = F.col("first").isNotNull() & (order > F.col("first.order"))
    rows = read_arc(spark, arc).join(firsts, "digest", "left")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
        line("WARC-Refers-To", F.col("first.id")),
        line("WARC-Refers-To-Target-URI", F.col("first.url")),
        line("WARC-Refers-To-Date", warc_date(F.col("first.date"))),
    )
    size = F.octet_length("head") + F.when(known, 0).otherwise(F.col("payload_bytes"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.0\r\n"),
            line("WARC-Type", F.when(known, "revisit").otherwise("response")),
            line("WARC-Record-ID", name),
            line("WARC-Date", warc_date(F.col("date"))),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-IP-Address", F.col("ip")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(known, revisit).otherwise(""),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", size.cast("string")),
            F.lit("\r\n"),
            F.col("head"),
            F.when(known, "").otherwise(F.col("body").cast("string")),
        ).alias("value")
    )


def _warc_rows(data: bytes):
    for fields, block in warc_records(data):
        if fields["warc-type"] == "warcinfo":
            continue
        http, body = payload_of(block)
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and sha1_base32(body) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        yield (
            fields["warc-record-id"], fields["warc-type"], fields["warc-date"], fields.get("warc-target-uri"), digest,
            fields.get("warc-refers-to"), "\r\n".join(["", *(f"{k}: {v}" for k, v in http.items()), ""]),
            len(body) if fields["warc-type"] == "response" else None,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, date, url, digest, refers_to (a record id), the HTTP head and the bytes of a response's
    payload; payloads are checked."""
    names = ("record_id", "record_type", "date", "url", "digest", "refers_to", "head")
    ddl = ", ".join(f"{n} string" for n in names) + ", payload_bytes long"
    return _read(spark, path, _warc_rows, _schema(**dict.fromkeys(names, pa.string()), payload_bytes=pa.int64()), ddl)


def page_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as ARC files (both versions), convert them to WARC files, and read those back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), record_id and url, one row per
    page; the payload of a revisit is that of the record it refers to.  A null html is an empty payload, a null url ``about:blank``; white space in a URL is percent-encoded.  Equal
    payloads, empty ones included, are one response (the smallest page_id) and revisits.  Rows that repeat a page_id and
    a payload are all responses.  A page without an id is archived under an empty one: it comes back with page_id null
    and is revisited by none unless no row of its payload has an id.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    when, stamp = "20240101000000", "2024-01-01T00:00:00Z"
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = {"Content-Length": F.octet_length(body), "X-Page-Id": F.coalesce(F.col(page_id).cast("string"), F.lit(""))}
    # Partitions take the two versions of the old format in turn.
    version = F.pmod(F.spark_partition_id(), F.lit(2)) + 1
    lines = pages.select(arc_lines(F.col(url), F.lit(when), http_block(body, head), version).alias("value"))
    write_archive(lines, f"{folder}/arc", [arc_head(1, when), arc_head(2, when)], "\n", compress=True)
    page = F.nullif(http_field("head", "X-Page-Id"), F.lit("")).try_cast("long")
    # A page without an id sorts behind all others.
    order = F.struct(page.isNull().alias("unnamed"), page.alias("page"))
    write_archive(arc_to_warc(spark, f"{folder}/arc", order), f"{folder}/warc", [warc_head(stamp)], "\r\n\r\n", compress=True)
    back = read_warc(spark, f"{folder}/warc").withColumn("page_id", page)
    named = back.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("first_bytes")
    ).dropDuplicates(["refers_to"])
    return back.join(named, "refers_to", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("first_id").alias("refers_to"),
        "record_id",
        "url",
    )
