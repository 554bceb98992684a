"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every partition of the input sorts the fingerprints (the first 64 bits of SHA-256) of its texts, cuts them by ranges,
Golomb-codes the gaps of each range and sends it to the range's owner.  An owner merges what it was sent and answers
every partition with a bitmap: which of its fingerprints occur more than once anywhere.  A partition then reads its rows
again, and only texts with a marked fingerprint, the suspects, are shuffled: grouping them by the text itself compares
bytes.  Texts that occur once never leave their partition.

The answers reach the partition that asked by ``RDD.zip``: no DataFrame join can bring a row to a partition without
moving that partition too.  The input therefore has to be read in the same partitions twice, as files are; a partition
that meets a fingerprint it did not send stops with an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from larder.llm import text_blocks as tb
from larder.llm.shared import stored

PRINT_BITS = 64
OWNER_ROWS = 4 << 20  # fingerprints that one owner merges, on average
BLOB_BYTES = 1 << 17  # of text; RDD.zip holds a hundred blobs at a time
HEAVY_SHARE = 1000  # texts with more than one in so many rows, so fewer texts than this, are joined by broadcast

_U = np.uint64


def golomb(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """(shift, quotients in unary, remainders of ``shift`` bits) of non-negative gaps: the Golomb code for 2^shift."""
    mean = float(gaps.astype(np.float64).mean()) if len(gaps) else 0.0
    shift = max(0, min(63, int(math.log2(max(mean * math.log(2), 1.0)))))
    ends = np.cumsum((gaps >> _U(shift)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(gaps) else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(shift, dtype=np.uint64)) & _U(1)).astype(np.uint8)
    return shift, np.packbits(unary).tobytes(), np.packbits(low.reshape(-1)).tobytes()


def ungolomb(n: int, shift: int, unary: bytes, low: bytes) -> np.ndarray:
    """The gaps that ``golomb`` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << _U(shift)
    bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * shift).reshape(n, shift)
    for k in range(shift):
        gaps |= bits[:, k].astype(np.uint64) << _U(k)
    return gaps


def coded(prints: np.ndarray, first: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct fingerprints of a range that begins at ``first``."""
    gaps = np.diff(prints, prepend=_U(first))
    gaps[1:] -= _U(1)
    return golomb(gaps)


def decoded(n: int, shift: int, unary: bytes, low: bytes, first: int) -> np.ndarray:
    gaps = ungolomb(n, shift, unary, low)
    gaps[1:] += _U(1)
    return np.cumsum(gaps, dtype=np.uint64) + _U(first)


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    flat = memoryview(data.tobytes())
    return [hashlib.sha256(flat[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _prints(digests: list[bytes], bits: int) -> np.ndarray:
    heads = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
    return heads >> _U(64 - bits)


_MESSAGE = pa.schema(
    [
        ("part", pa.int32()), ("owner", pa.int32()), ("blobs", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()),
        ("unary", pa.binary()), ("low", pa.binary()), ("repeated", pa.binary()),
    ]
)
_MESSAGE_SQL = "part int, owner int, blobs int, n int, shift int, unary binary, low binary, repeated binary"


def _send(bits: int, owner_bits: int):
    """One message for every owner of whose range this partition has fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = [], 0
        for batch in batches:
            for _, _, data, offsets in tb.text_blocks(batch.column("text"), BLOB_BYTES):
                held.append(_prints(_digests(data, offsets), bits))
                blobs += 1
        if not held:
            return
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        part = TaskContext.get().partitionId()
        owners = (prints >> _U(bits - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(prints), np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1, [len(prints)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            owner = int(owners[a])
            shift, unary, low = coded(prints[a:b], owner << (bits - owner_bits))
            row = (part, owner, blobs, int(b - a), shift, unary, low, np.packbits(counts[a:b] > 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MESSAGE, strict=True)], schema=_MESSAGE)

    return run


def _answer(bits: int, owner_bits: int):
    """What an owner was sent, with the bitmaps of fingerprints that occur more than once."""

    def run(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        first = rows[0]["owner"] << (bits - owner_bits)
        lists = [decoded(r["n"], r["shift"], r["unary"], r["low"], first) for r in rows]
        marks = np.concatenate([np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]) for r in rows])
        prints = np.concatenate(lists)
        order = np.argsort(prints, kind="stable")
        equal = prints[order[1:]] == prints[order[:-1]]
        marks[order[1:][equal]] = 1
        marks[order[:-1][equal]] = 1
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        bitmaps = [np.packbits(m).tobytes() for m in np.split(marks, cuts)]
        return messages.set_column(messages.schema.get_field_index("repeated"), "repeated", pa.array(bitmaps, pa.binary()))

    return run


def _packed(bits: int):
    """Rows of a partition as Arrow streams, one for every block of text, with digests and fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column("text"), BLOB_BYTES):
                digests = _digests(data, offsets)
                block = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array(_prints(digests, bits).view(np.int64)),
                        pa.array([d.hex() for d in digests]),
                        batch.column("text").slice(start, stop - start),
                    ],
                    names=["doc_id", "print", "text_sha256", "text"],
                )
                yield pa.RecordBatch.from_arrays([pa.array([_written(block)], pa.binary())], names=["blob"])

    return run


def _written(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


def _dealt(rows: Iterator[Row]) -> Iterator[list | None]:
    """The answers of a partition beside its first blob, and nothing beside the others."""
    answers = [row.asDict() for row in rows]
    if answers:
        yield answers
        for _ in range(answers[0]["blobs"] - 1):
            yield None


def _suspects(bits: int, owner_bits: int):
    """The blobs of a partition without the texts that occur only once."""

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        own, twice = np.zeros(0, np.uint64), np.zeros(0, bool)
        for (blob,), answers in pairs:
            if answers:
                answers.sort(key=lambda r: r["owner"])
                lists = [decoded(r["n"], r["shift"], r["unary"], r["low"], r["owner"] << (bits - owner_bits)) for r in answers]
                own = np.concatenate(lists)
                twice = np.concatenate(
                    [np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]) for r in answers]
                ).astype(bool)
            block = _read(blob)
            prints = block.column("print").to_numpy().view(np.uint64)
            place = np.minimum(np.searchsorted(own, prints), len(own) - 1)
            if (own[place] != prints).any():
                raise RuntimeError("the input came in other partitions when it was read again; write it to files first")
            texts = pa.compute.fill_null(block.column("text"), "")
            suspect = pa.compute.if_else(pa.array(twice[place]), texts, pa.scalar(None, texts.type))
            columns = [block.column(c) for c in ("doc_id", "print", "text_sha256")]
            yield (_written(pa.RecordBatch.from_arrays([*columns, suspect], names=["doc_id", "print", "text_sha256", "text"])),)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob"):
            yield _read(blob.as_buffer())


def exact_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = PRINT_BITS, owner_rows: int = OWNER_ROWS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are copies when their texts are byte for byte the same; a null text counts as empty.  keep_id is the largest
    doc_id among the copies, group_size the number of rows, kept whether this row has that id.  Rows that repeat an id
    and its text cannot be told apart: each counts in group_size, and all of them are kept if the id is.  A row without
    doc_id is kept only where none of its copies has one; keep_id is null there.  An empty table gives an empty result;
    columns other than the two named ones are not read.  ``bits`` is the length of the fingerprints: shorter ones make
    more suspects, never another result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, rows_in = docs.sparkSession, docs.count()
    if not rows_in:
        nothing = docs.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
        return nothing.select("doc_id", "keep_id", "group_size", _kept().alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    owner_bits = min(bits, max(0, math.ceil(math.log2(max(rows_in, 1) / owner_rows)))) if rows_in > owner_rows else 0
    sent = docs.select("text").mapInArrow(tb.tidy(_send(bits, owner_bits)), _MESSAGE_SQL)
    answers = stored(sent.groupBy("owner").applyInArrow(_answer(bits, owner_bits), _MESSAGE_SQL))

    packed = docs.mapInArrow(tb.tidy(_packed(bits)), "blob binary").rdd
    returned = answers.repartitionById(max(1, packed.getNumPartitions()), "part").rdd.mapPartitions(_dealt)
    marked = packed.zip(returned).mapPartitions(_suspects(bits, owner_bits))
    rows = stored(
        spark.createDataFrame(marked, "blob binary").mapInArrow(
            tb.tidy(_unpacked), "doc_id long, print long, text_sha256 string, text string"
        )
    )

    # Equal bytes; a hot text is one row of each map task here.
    groups = rows.where("text is not null").groupBy("print", "text")
    groups = groups.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_print = stored(
        groups.groupBy("print").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    suspects = rows.where("text is not null")
    alike = by_print.where("texts = 1").drop("texts")
    heavy, light = (alike.where(c) for c in (f"group_size * {HEAVY_SHARE} > {rows_in}", f"group_size * {HEAVY_SHARE} <= {rows_in}"))
    found = [
        rows.where("text is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"),
        suspects.drop("text").join(F.broadcast(heavy), "print"),
        suspects.drop("text").join(F.broadcast(heavy.select("print")), "print", "left_anti").join(light, "print"),
    ]
    # Fingerprints that stand for several texts: here the text itself decides.
    mixed = by_print.where("texts > 1").select("print")
    if not mixed.isEmpty():
        found.append(suspects.join(mixed, "print", "left_semi").join(groups.join(mixed, "print", "left_semi"), ["print", "text"]))
    out = None
    for part in found:
        part = part.select("doc_id", "keep_id", "group_size", _kept().alias("kept"), "text_sha256")
        out = part if out is None else out.unionByName(part)
    return out


def _kept() -> Column:
    return F.when(F.col("keep_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
