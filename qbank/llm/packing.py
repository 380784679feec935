"""Packing of documents along a space-filling curve.

Each document's token ids are hashed into a vector that is projected to a few
dimensions; the documents are range-sorted by the Hilbert key of the projected
point, and packed in that order, so that neighbours in a sequence are
neighbours in content.  Sequences are gapless: a document goes on in the next
sequence where one is full, so only the very last sequence is padded.

Three bounded steps: (1) ids, key and length of each document, once, as a table
in the shared folder; (2) keys, lengths and row numbers alone are range-sorted
(equal keys, such as a hot group of copies, are dealt out by row number) and
summed up, and one total for each partition reaches the driver; (3) each
document's ids meet its place by row number, and are cut.

Defined results: null text is an empty document (its end id alone); repeated
rows are packed each; ties in the key are ordered by row number; an empty table
gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.llm import tokens
from qbank.llm.common import mix, partitions, table, text_batches


@dataclass(frozen=True)
class Packing:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    length: int = 4096
    #: The hashed vector's width, the dimensions it is projected to, and the bits of each.
    width: int = 1024
    dimensions: int = 4
    bits: int = 12


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points (n, d) of unsigned ``bits``-bit coordinates; d * bits <= 63.

    Skilling's transform (2004): inverse undo, Gray encoding, then the bits of
    all coordinates interleaved, highest first.
    """
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(d):
            hit = (x[i] & np.uint64(q)) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def directions(width: int, dimensions: int) -> np.ndarray:
    """A fixed +-1 projection, from hashed places: no state, the same in every task."""
    at = mix(np.arange(width * dimensions, dtype=np.uint64) + np.uint64(0x51ED27))
    return np.where((at >> np.uint64(7)) & np.uint64(1), 1.0, -1.0).reshape(width, dimensions)


def curve_keys(ids: list[np.ndarray], p: Packing) -> np.ndarray:
    """Hilbert keys of documents: hashed counts, damped and of unit length, projected, spread evenly."""
    if not ids:
        return np.zeros(0, np.int64)
    spread = directions(p.width, p.dimensions)
    slot = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(p.width)).astype(np.int64)
    points = np.empty((len(ids), p.dimensions))
    for k, x in enumerate(ids):
        at = slot[x] if x.dtype.itemsize == 2 else slot[x & 0xFFFF]
        v = np.log1p(np.bincount(at, minlength=p.width))
        points[k] = v @ spread / max(1e-9, float(np.sqrt(v @ v)))
    # A projected coordinate is nearly normal; its distribution function spreads it over [0, 1).
    even = 1 / (1 + np.exp(-1.702 * points))
    top = (1 << p.bits) - 1
    return hilbert(np.clip((even * (top + 1)).astype(np.int64), 0, top), p.bits)


def encoded(docs: DataFrame, p: Packing) -> DataFrame:
    """``doc_id``, ``ids`` (packed integers), ``n`` and ``key`` of each document."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.words(p.vocabulary, p.end_id)
        for whole in got:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = words.encode(b.column(1).to_pylist())
                arrays = [np.frombuffer(x, words.dtype) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(ids, pa.binary()),
                        pa.array([len(a) for a in arrays], pa.int64()),
                        pa.array(curve_keys(arrays, p)),
                    ],
                    names=["doc_id", "ids", "n", "key"],
                )

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, n long, key long"
    )


def _running(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets inside a sorted partition."""
    part, total = TaskContext.get().partitionId(), 0
    for b in got:
        n = b.column("n").to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(ends - n), b.column("n"), pa.array(np.full(len(n), part, np.int32))],
            names=["row", "start", "n", "part"],
        )
        total = int(ends[-1]) if len(ends) else total


def placed(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """``doc_id, ids, n, at``: each document's ids and its place in the one long stream."""
    spark = docs.sparkSession
    ids = table(encoded(docs, p).withColumn("row", F.monotonically_increasing_id()), "ids")
    order = (
        ids.select("key", "row", "n")
        .repartitionByRange(partitions(spark), "key", "row")
        .sortWithinPartitions("key", "row")
        .mapInArrow(_running, "row long, start long, n long, part int")
    )
    order = table(order, "order")
    totals = {r[0]: r[1] for r in order.groupBy("part").agg(F.sum("n")).collect()}  # a row a partition
    bases, total = [], 0
    for part in sorted(totals):
        bases.append((part, total))
        total += totals[part]
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    order = order.join(bases, "part").select("row", (F.col("base") + F.col("start")).alias("at"))
    return ids.join(order, "row").select("doc_id", "ids", "n", "at")


def pieces(docs: DataFrame, p: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """Every document cut into pieces of sequences, with their places and ids' checksums.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    unless they are not wanted, ``ids``: the piece's little-endian unsigned
    32-bit ids.
    """
    length = p.length
    width = tokens.Words(p.vocabulary, p.end_id).dtype.itemsize
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary())] * with_ids
    )

    def cut(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            rows: list[list] = [[] for _ in schema]
            for doc, raw, n, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    own = ids[start : start + size].tobytes()
                    row = (doc, start, size, zlib.crc32(own), n, sequence, offset, own)
                    for c, v in zip(rows, row[: len(rows)], strict=True):
                        c.append(v)
                    start += size
                if len(rows[0]) >= 2048:
                    yield _batch(rows, schema)
                    rows = [[] for _ in schema]
            if rows[0]:
                yield _batch(rows, schema)

    return placed(docs, p).mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids binary" * with_ids,
    )


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sequences(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Whole sequences: ``sequence_id``, padded ``ids`` matrices' rows and piece bounds, for writing."""
    size = p.length

    def join(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, bounds = None, [], [0]
        def done():  # noqa: ANN202
            flat = b"".join(own)
            n = len(flat) // 4
            full = n if n and n & (n - 1) == 0 else size
            return to_row(now, flat + bytes(4 * (full - n)), n, bounds)
        for b in got:
            for sequence, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sequence != now:
                    if now is not None:
                        yield done()
                    now, own, bounds = sequence, [], [0]
                own.append(ids)
                bounds.append(bounds[-1] + len(ids) // 4)
        if now is not None:
            yield done()

    def to_row(sequence: int, ids: bytes, n: int, bounds: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([sequence]), pa.array([ids], pa.binary()), pa.array([n]), pa.array([bounds], pa.list_(pa.int32()))],
            names=["sequence_id", "ids", "n_ids", "bounds"],
        )

    return (
        pieces(docs, p)
        .select("sequence_id", "ids", "offset")
        .repartition(partitions(docs.sparkSession), "sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
        .mapInArrow(join, "sequence_id long, ids binary, n_ids long, bounds array<int>")
    )
