"""Training sequences by best-fit-decreasing packing, as id matrices.

Documents longer than a sequence are split without loss into full pieces and a
rest; rests and shorter documents are packed best-fit-decreasing: each, longest
first, into the fullest open sequence that still has room, which a segment tree
over free capacities finds in logarithmic time.  A sequence is written as one
row of a fixed-width id matrix (padded), the cumulative lengths of its segments,
and position ids that start anew with each segment.

Packing works inside a partition, in windows of bounded tokens, so memory is
bounded and a lost task is simply packed again, with the same result.  Sequence
ids number the sequences of a partition from ``partition << 40``.

Defined results: null text is an empty document (its end id alone); ties are
packed in order of row; repeated rows are packed each; an empty table gives no
sequences; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.llm import tokens
from qbank.llm.common import text_batches


@dataclass(frozen=True)
class Output:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    pad_id: int = 0
    length: int = 4096
    #: Tokens in a window of packing (bounds a task's memory).
    window: int = 1 << 22


class Capacities:
    """Open sequences by free capacity; a segment tree of counts finds the tightest fit."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, name: int) -> None:
        self.open[free].append(name)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """The open sequence of least free capacity >= needed, removed; None if there is none."""
        at = needed + self.size
        count = self.count
        if not count[at]:
            # up to the first right sibling with a sequence, then down its left side
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        free = at - self.size
        name = self.open[free].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return free, name


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Groups of places of ``lengths`` (each at most ``length``), best-fit-decreasing."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    bins: list[list[int]] = []
    room = Capacities(length)
    for k in order:
        got = room.take(lengths[k])
        free, name = got if got is not None else (length, len(bins))
        if got is None:
            bins.append([])
        bins[name].append(k)
        if free > lengths[k]:
            room.add(free - lengths[k], name)
    return bins


SEGMENTS = "array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint>>"
SCHEMA = f"sequence_id long, ids binary, n_ids int, cu_seqlens array<int>, segments {SEGMENTS}"
ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
        ("segments", pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens")]))),
    ]
)


def sequences(docs: DataFrame, p: Output = Output()) -> DataFrame:
    """``sequence_id, ids, n_ids, cu_seqlens, segments``; ``ids`` is a padded row of 32-bit ids."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.words(p.vocabulary, p.end_id)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = [
                (doc, start, min(p.length, len(ids) - start), ids) for doc, ids in held for start in range(0, len(ids), p.length)
            ]
            rows: list[tuple] = []
            for group in best_fit([x[2] for x in parts], p.length):
                row = np.full(p.length, p.pad_id, "<u4")
                ends, segments = [0], []
                for k in group:
                    doc, start, size, ids = parts[k]
                    row[ends[-1] : ends[-1] + size] = ids[start : start + size]
                    ends.append(ends[-1] + size)
                    segments.append({"doc_id": doc, "start": start, "length": size, "doc_tokens": len(ids)})
                rows.append((number, row.tobytes(), ends[-1], ends, segments))
                number += 1
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for whole in got:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for doc, raw in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                    held.append((doc, np.frombuffer(raw, words.dtype)))
                    total += len(held[-1][1])
                if total >= p.window:
                    yield from pack()
                    held, total = [], 0
        if held:
            yield from pack()

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of a row: they start anew at each segment; padding counts as one more."""
    out = np.arange(length, dtype=np.int32)
    for start, end in zip(cu_seqlens, [*cu_seqlens[1:], length], strict=True):
        out[start:end] -= start
    return out


def with_positions(packed: DataFrame, p: Output = Output()) -> DataFrame:
    """``packed`` and ``position_ids``, a row of little-endian 32-bit integers beside each row of ids."""
    length = p.length

    @F.pandas_udf("binary")
    def of(ends):  # noqa: ANN001, ANN202
        return ends.map(lambda x: positions(list(x), length).tobytes())

    return packed.withColumn("position_ids", of("cu_seqlens"))


def write(docs: DataFrame, path: str, p: Output = Output()) -> None:
    """Id matrices, cumulative segment lengths and position resets as Parquet rows in file order."""
    with_positions(sequences(docs, p), p).write.mode("overwrite").parquet(path)


def pieces(packed: DataFrame) -> DataFrame:
    """Each segment of the packed rows, with the checksum of its ids, and of its position ids if there are any, as they stand in the matrix."""
    placed = [c for c in ("position_ids",) if c in packed.columns]
    rows = packed.select("sequence_id", "ids", *placed, "cu_seqlens", F.posexplode("segments").alias("k", "s"))
    at = F.get("cu_seqlens", F.col("k"))

    def own(matrix: str) -> Column:
        return F.crc32(F.substring(matrix, at * 4 + 1, (F.col("s.length") * 4).cast("int")))

    return rows.select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.start").alias("start"), F.col("s.length").alias("length"),
        own("ids").alias("ids_crc32"), F.col("s.doc_tokens").alias("doc_tokens"), "sequence_id", at.cast("long").alias("offset"),
        *(own(c).alias("positions_crc32") for c in placed),
    )
