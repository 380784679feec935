"""Importance resampling towards a target by hashed n-grams, counted over word-id suffix arrays.

Every task cuts its texts into blocks of bounded size.  A block's words get ids,
and its suffix array orders the places of all words by the next ``longest`` ids
(prefix doubling, cut at document ends).  Common prefixes of neighbours part the
array into runs: a run of prefixes of n or more ids is one n-gram with all its
places.  Each n-gram is therefore hashed once a run, and its bucket id is
scattered back to the places, from which documents are counted and scored.

Two passes over the texts: bucket counts of the corpus and of the target, summed
up by Spark to one row a bucket; then the documents' weights under the buckets'
log ratios (a list of ``buckets`` numbers).  The draw perturbs each weight with
Gumbel noise keyed by the document's id and takes the highest scores: narrow
rows are range-sorted, one count a range reaches the driver, and no task sees
all rows.

Defined results: null text and text without words have no features and weight 0;
identical rows are drawn each for itself, in any order among themselves; a null
doc_id is keyed as an empty one and comes after its equals; an empty corpus or
target counts nothing; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import partitions, table, text_batches

#: A-Z to a-z; every byte that belongs to no word to a space. Bytes of letters beyond ASCII stay.
_FOLD = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)


@dataclass(frozen=True)
class Target:
    #: n-grams of 1 to so many words.
    longest: int = 1
    buckets: int = 10_000
    #: Documents with fewer words are not drawn.
    min_words: int = 20
    percent: int = 10
    seed: int = 2024
    #: Bytes of text in a block (a longer text is a block of its own).
    block: int = 4 << 20


def suffix_array(ids: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by their next ``depth`` ids, and the common prefix with the one before (at most ``depth``).

    ``ends`` is, for each place, where its document ends; nothing reaches beyond.
    """
    n = len(ids)
    here = np.arange(n)
    rank = ids.astype(np.int64) + 1
    order, have = np.argsort(rank, kind="stable"), 1
    while have < depth:
        step = min(have, depth - have)
        ahead = here + step
        then = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], 0)
        order = np.lexsort((then, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (then[order[1:]] != then[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        have += step
    common = np.zeros(n, np.int32)
    alike = np.ones(max(0, n - 1), bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        alike &= (a < ends[order[:-1]]) & (b < ends[order[1:]])
        alike &= ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)]
        common[1:] += alike
    return order, common


def block_buckets(parted: list[list[bytes]], p: Target) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each document's words begin (and the last end), and each place's bucket for n = 1, 2, ... (-1: none)."""
    counts = np.fromiter(map(len, parted), np.int64, len(parted))
    starts = np.r_[0, counts.cumsum()]
    n = int(starts[-1])
    if not n:
        return starts, [np.zeros(0, np.int64)] * p.longest
    known: dict[bytes, int] = {}
    for words in parted:
        known.update(dict.fromkeys(words))
    spelt = list(known)
    known = dict(zip(spelt, range(len(spelt)), strict=True))
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(parted)), np.int32, n)
    ends = np.repeat(starts[1:], counts)
    order, common = suffix_array(ids, ends, p.longest)
    out = []
    for k in range(1, p.longest + 1):
        first = np.flatnonzero(common < k)
        whole = order[first] + k <= ends[order[first]]
        hashed = np.full(len(first), -1, np.int64)
        for r in np.flatnonzero(whole).tolist():
            at = order[first[r]]
            gram = spelt[ids[at]] if k == 1 else b" ".join([spelt[i] for i in ids[at : at + k].tolist()])
            hashed[r] = zlib.crc32(gram) % p.buckets
        bucket = np.empty(n, np.int64)
        bucket[order] = np.repeat(hashed, np.diff(np.r_[first, n]))
        out.append(bucket)
    return starts, out


def _blocks(column: pa.Array, p: Target) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of a batch's texts, in blocks, with the place of the first."""
    first, size, parted = 0, 0, []
    for k, text in enumerate(column):
        raw = text.as_py() or b""
        if parted and size + len(raw) > p.block:
            yield first, parted
            first, size, parted = k, 0, []
        parted.append(raw.translate(_FOLD).split())
        size += len(raw)
    if parted:
        yield first, parted


def bucket_counts(texts: DataFrame, p: Target = Target(), column: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all ``texts`` fall into each bucket."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in got:
            for _, parted in _blocks(b.column(0), p):
                for bucket in block_buckets(parted, p)[1]:
                    total += np.bincount(bucket[bucket >= 0], minlength=p.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = text_batches(texts).select(F.col(column).cast("string").cast("binary")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, p: Target = Target()) -> np.ndarray:
    """Each bucket's log ratio of target to corpus, smoothed by one, in thousandths rounded down."""
    found = []
    for counts in (corpus, target):
        one = np.zeros(p.buckets, np.int64)
        for r in counts.collect():  # a row for each bucket at most
            one[r.bucket] = r.n
        found.append(one)
    s, t = found
    all_s, all_t = float(s.sum() + p.buckets), float(t.sum() + p.buckets)
    ratio = ((t + 1.0) * all_s) / ((s + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, p: Target = Target()) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            for first, parted in _blocks(b.column(1), p):
                starts, of_length = block_buckets(parted, p)
                features = np.zeros(len(parted), np.int64)
                weight = np.zeros(len(parted), np.int64)
                for bucket in of_length:
                    there = bucket >= 0
                    for out, each in ((features, there), (weight, np.where(there, gain[bucket], 0))):
                        summed = np.r_[0, np.cumsum(each, dtype=np.int64)]
                        out += summed[starts[1:]] - summed[starts[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(parted)), pa.array(np.diff(starts)), pa.array(features), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(rows: DataFrame, p: Target = Target()) -> DataFrame:
    """``rows`` (as ``weighted`` gives them) with ``score`` and, for those drawn, ``rank``."""
    key = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = rows.withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= p.min_words)
    scored = table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    spark = rows.sparkSession
    dealt = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # An id that counts up inside a partition: the partition's number stands in the bits from 33 on.
    dealt = table(dealt.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes, fit = 0, [], 0
    for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).orderBy("part").collect():
        sizes.append((r.part, before))
        before += r.n
        fit += r.fit
    bases = spark.createDataFrame(sizes, "part long, before long")  # one row a partition of the sort
    place = F.col("before") + inside + 1
    drawn = place <= F.lit(fit * p.percent // 100)  # those that fit come first
    return dealt.withColumn("part", part).join(F.broadcast(bases), "part").select("doc_id", "n_features", "weight", "score", F.when(drawn, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, p: Target = Target()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of all ``docs``; ``rank`` is null where it isn't drawn."""
    return draw(weighted(docs, gains(bucket_counts(docs, p), bucket_counts(target, p), p), p), p)
