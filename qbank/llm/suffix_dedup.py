"""Removal of passages that repeat anywhere, by column-wise construction of a collection's suffix order.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere
else, in the same text or in another.  Texts are UTF-8 bytes.

Segments.  Each string of ``length`` bytes has an anchor: the leftmost of its
``anchor``-byte strings of least hash.  Equal strings have equal anchors at equal
offsets, so all starts with one anchor form a segment (the text that they
cover), segments are dealt out by their anchor's hash, and lined up at their
anchors, equal strings start in the same column.  An anchor that occurs once
holds no repeat, and its segment goes no further; equal segments are one string
of the collection with a number of copies.

Columns.  A task takes its segments in batches (all of an anchor in one) and goes
through their columns from the last to the first.  Each round inserts one symbol
of every segment: the symbols before the suffixes in their sorted order are the
column of the collection's Burrows-Wheeler transform, and its stable sort is the
order of the suffixes that are one symbol longer.  The common prefix of two new
neighbours is one more than the least common prefix between their old places.
A start repeats if its suffix shares ``length`` symbols with a neighbour, or its
segment has copies.  Since suffixes of different columns never hold the same
string, the order is kept by column, which is what lets a round take time in
proportion to the segments rather than to the whole transform.  Columns, order
and prefixes are buffers that each round reads and writes once from end to end;
a batch is bounded, so they stay in the task's memory and nothing lies in a
folder that other executors can't see.

Hot anchors.  An anchor inside a widespread passage has many different segments
(its surroundings).  Anchors with more than ``crowd`` of them, and more than a
quarter of a partition's share (so at most four a partition), are parted by more of their own text: first by
windows of 16 starts, keyed by the bytes that all strings of the window share,
then start by start, where all strings of a key are equal.

Then the repeated runs of each segment go back to all its places (places of hot
segments are dealt out by ``join_hot``), and each text is cut once.

Defined results: null text is empty; texts shorter than ``length`` lose nothing;
equal texts and repeated rows repeat each other and lose all of their starts;
a null doc_id is kept as it is; an empty table gives no rows; other columns,
whatever their names, pass through.
Segments are told apart by 128-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import Table, join_hot, mix, partitions, small, text_batches


@dataclass(frozen=True)
class Repeats:
    #: Bytes that two places must share.
    length: int = 400
    #: Bytes of an anchor.
    anchor: int = 128
    #: Anchors with more different segments are parted further, if they also hold a large share.
    crowd: int = 2048
    #: Starts in a window of the first and second further parting.
    windows: tuple[int, ...] = (16, 1)
    #: Segments in a partition, about.
    share: int = 100_000
    #: Segments in a batch of columns, at least (a batch ends where an anchor ends).
    batch: int = 12_000
    #: Starts of a text that are looked at together.
    stretch: int = 1 << 19


# -- segments ---------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Rolling:
    """Hashes of all substrings of a stretch of bytes: a polynomial over 64-bit integers, finalised."""

    def __init__(self, raw: np.ndarray) -> None:
        global _powers
        n = len(raw) + 1
        if _powers is None or len(_powers[0]) < n:
            size = 1 << (n - 1).bit_length()
            _powers = _power(_BASE, size), _power(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        return mix((self.sums[size:] - self.sums[:-size]) * _powers[1][: len(self.sums) - size])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * _powers[1][start])


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The place of the least hash (its 40 high bits) in each window, the leftmost of equals."""
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: -(window - span)], least[window - span :])
    return (least & low).astype(np.int64)


def _segments(raw: np.ndarray, p: Repeats, hot: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Key, first start, end and anchor of the segments; with hot keys, only of those that they are parted into."""
    rolling = Rolling(raw)
    hashes = rolling.all(p.anchor)
    place = anchors(hashes, p.length - p.anchor + 1)
    starts = np.arange(len(place))
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.r_[0, cut]
    key, last, place = hashes[place[first]], np.r_[cut, len(starts)], place[first]
    for level, keys in enumerate(hot):
        chosen = np.isin(key, keys)
        first, last, place = first[chosen], last[chosen], place[chosen]
        size = p.windows[level]
        runs = last - first
        each = np.repeat(place - first, runs) - np.arange(runs.sum()) + np.repeat(np.cumsum(runs) - runs, runs)
        held = np.repeat(place, runs)
        group = each // size  # the window of offsets that a start's anchor lies in
        new = np.ones(len(each), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(held) != 0)
        at = np.flatnonzero(new)
        first = held[at] - each[at]
        last = first + np.diff(np.r_[at, len(each)])
        place, group = held[at], group[at]
        core = place - group * size
        key = mix(rolling.at(core, p.length - size + 1) + group.astype(np.uint64) + np.uint64(level + 1))
    return key.view(np.int64), first, last + p.length - 1, place


def segments(texts: DataFrame, p: Repeats, hot: tuple[np.ndarray, ...] = ()) -> DataFrame:
    """``key, content, t1, t2, d, start, size, offset``: the segments of all texts (t1, t2, d, bytes).

    ``start`` is the segment's place in its text, ``offset`` its anchor's place in the segment.
    """
    import xxhash

    names = ["key", "content", "t1", "t2", "d", "start", "size", "offset"]

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            out: list[list] = [[] for _ in names]
            rows = 0
            whose = [b.column(k).to_numpy() for k in range(3)]
            for row in range(b.num_rows):
                data = b.column(3)[row].as_py()
                whole = np.frombuffer(data, np.uint8)
                for at in range(0, len(whole) - p.length + 1, p.stretch):
                    end = min(len(whole), at + p.stretch + p.length - 1)
                    key, first, last, place = _segments(whole[at:end], p, hot)
                    offset = place - first
                    first, last = first + at, last + at
                    out[1] += [xxhash.xxh3_128_digest(data[i:j], k) for i, j, k in zip(first.tolist(), last.tolist(), offset.tolist(), strict=True)]
                    n = len(key)
                    for k, part in ((0, key), *((2 + k, np.full(n, w[row])) for k, w in enumerate(whose)), (5, first), (6, last - first), (7, offset)):
                        out[k].append(part)
                    rows += n
                    if rows > 100_000:
                        yield _batch(names, out)
                        out, rows = [[] for _ in names], 0
            if rows:
                yield _batch(names, out)

    return texts.mapInArrow(run, "key long, content binary, t1 long, t2 long, d long, start long, size int, offset int")


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    arrays = []
    for name, parts in zip(names, columns, strict=True):
        if name == "content":
            arrays.append(pa.array(parts, pa.binary()))
        else:
            arrays.append(pa.array(np.concatenate(parts).astype(np.int32 if name in ("size", "offset") else np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names=names)


# -- columns ----------------------------------------------------------------------------------------


def _least_between(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values low..high (both included), from minima over powers of two."""
    depth = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), levels[0].dtype)
    for d in range(len(levels)):
        some = depth == d
        if some.any():
            a, b = low[some], high[some] - (1 << d) + 1
            out[some] = np.minimum(levels[d][a], levels[d][b])
    return out


def columns(strings: list[bytes], offsets: np.ndarray, copies: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """For each string with a repeated start: its number, and whether each of its starts repeats.

    ``offsets`` are the anchors' places; only strings that are lined up alike are compared.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    before = int(offsets.max())
    width = int((sizes - offsets).max()) + before
    shift = before - offsets  # the column of a string's first symbol
    ends = shift + sizes
    rows = np.zeros((m, width), np.uint8)
    for i, (string, low, high) in enumerate(zip(strings, shift.tolist(), ends.tolist(), strict=True)):
        rows[i, low:high] = np.frombuffer(string, np.uint8)
    table = np.ascontiguousarray(rows.T)  # one column of symbols after another, as the rounds read them
    del rows
    number = np.int16 if width < 1 << 15 else np.int32
    entering = np.argsort(-ends, kind="stable")
    arrives = np.searchsorted(-ends[entering], -np.arange(width + 1), side="right")  # strings that end at column x or later
    repeats = np.zeros((before + 1, m), bool)
    order = np.zeros(0, np.int64)
    common = np.zeros(0, number)
    for x in range(width - 1, -1, -1):
        new = entering[arrives[x + 2] if x + 2 <= width else 0 : arrives[x + 1]]
        if len(new):  # their suffix is empty as yet and sorts before all others
            order = np.r_[new, order]
            common = np.r_[np.zeros(len(new), number), common]
        if not len(order):
            continue
        here = np.flatnonzero(shift[order] <= x)  # strings that have begun before leave
        if not len(here):
            order, common = order[:0], common[:0]
            continue
        symbols = table[x, order[here]]  # the transform's column
        place = here[np.argsort(symbols, kind="stable")]
        sorted_symbols = table[x, order[place]]
        levels = [common]
        joined = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        longer = np.zeros(len(place), number)
        if len(joined):
            low, high = place[joined - 1] + 1, place[joined]
            reach = int((high - low).max()) + 1
            while 2 << (len(levels) - 1) <= reach:
                half = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
            longer[joined] = _least_between(levels, low, high) + 1
        order, common = order[place], longer
        if x <= before:
            shared = common >= length
            shared[:-1] |= shared[1:]
            alone = (copies[order] > 1) & (ends[order] - x >= length)
            repeats[x, order] = shared | alone
    hit = np.flatnonzero(repeats.any(0))
    return [(int(i), repeats[shift[i] : shift[i] + sizes[i] - length + 1, i]) for i in hit]


def _runs(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the flagged starts cover, as maximal runs."""
    at = np.flatnonzero(flags)
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + length


def _repeated(p: Repeats):  # noqa: ANN202
    """Rows ``key, content, offset, copies, text``, sorted by key, to ``content, copies, runs``: the repeated bytes of each string."""

    def solve(rows: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        content = list(rows)
        offset, copies, text = zip(*rows.values(), strict=True)
        found = columns(list(text), np.array(offset, np.int64), np.array(copies, np.int64), p.length)
        if found:
            runs = [np.stack(_runs(flags, p.length), 1).ravel().tolist() for _, flags in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([content[i] for i, _ in found], pa.binary()),
                    pa.array([copies[i] for i, _ in found], pa.int64()),
                    pa.array(runs, pa.list_(pa.int64())),
                ],
                names=["content", "copies", "runs"],
            )

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, tuple] = {}  # a text whose rows are repeated sends its segments more than once
        last = None
        for b in got:
            for key, content, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if len(rows) >= p.batch and key != last:
                    yield from solve(rows)
                    rows = {}
                rows[content] = row
                last = key
        if rows:
            yield from solve(rows)

    return run


# -- the operator -----------------------------------------------------------------------------------


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    """``t1, t2`` stand for a text (equal texts are one) and ``d`` for its document; ``data`` are its bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64("doc_id").alias("d"), text.alias("data"), *more)


def spans(docs: DataFrame, p: Repeats = Repeats()) -> Table:
    """``t1, t2, spans``: the maximal runs ``(from, to)`` of repeated bytes of each text that has some."""
    spark = docs.sparkSession
    texts = text_batches(_hashed(docs)).where(F.length("data") >= p.length)
    parts: list[Table] = []
    hot: tuple[np.ndarray, ...] = ()
    while True:
        cut = Table(segments(texts, p, hot), "segments")
        common = Table(cut.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchors")
        places = Table(cut.df.join(small(common.df, common.df.count(), 48), "key"), "places")
        cut.drop()
        common.drop()
        one = F.min(F.struct("t1", "t2", "d", "start", "size", "offset"))
        strings = Table(places.df.groupBy("key", "content").agg(F.count("*").alias("copies"), one.alias("one")), "strings")
        total = strings.df.count()
        dealt = max(partitions(spark), total // p.share)
        crowded = []
        if len(hot) < len(p.windows) and total > p.crowd:
            most = max(p.crowd, total // (4 * dealt))
            crowded = [r.key for r in strings.df.groupBy("key").count().where(F.col("count") > most).select("key").collect()]
        kept, at = strings.df, places.df
        if crowded:
            listed = F.broadcast(spark.createDataFrame([(k,) for k in crowded], "key long"))  # at most four for each partition
            kept, at = kept.join(listed, "key", "left_anti"), at.join(listed, "key", "left_anti")
        parts.append(Table(_returned(kept, at, texts, total, dealt, p), "runs"))
        places.drop()
        strings.drop()
        if not crowded:
            break
        hot = (*hot, np.array(crowded, np.int64).view(np.uint64))
    found = parts[0].df
    for part in parts[1:]:
        found = found.unionByName(part.df)
    gathered = found.groupBy("t1", "t2").agg(F.collect_set("runs").alias("runs"))
    merged = Table(gathered.mapInArrow(_merged, "t1 long, t2 long, spans array<struct<from: long, to: long>>"), "spans")
    for part in parts:
        part.drop()
    return merged


def _returned(strings: DataFrame, places: DataFrame, texts: DataFrame, total: int, dealt: int, p: Repeats) -> DataFrame:
    """``t1, t2, runs``: the repeated runs of the segments, at all their places."""
    fields = [F.col(f"one.{c}").alias(c) for c in ("start", "size", "offset")]
    wanted = strings.groupBy("one.t1", "one.t2", "one.d").agg(F.collect_list(F.struct("key", "content", "copies", *fields)).alias("wanted"))
    rows = texts.join(wanted, ["t1", "t2", "d"]).select("data", F.explode("wanted").alias("w"))
    text = F.substring(F.col("data"), F.col("w.start").cast("int") + 1, F.col("w.size"))
    rows = rows.select("w.key", "w.content", "w.offset", "w.copies", text.alias("text")).repartition(dealt, "key").sortWithinPartitions("key")
    solved = Table(rows.mapInArrow(_repeated(p), "content binary, copies long, runs array<long>"), "repeated")
    total = solved.df.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    back = join_hot(places.select("content", "t1", "t2", "start"), solved.df, "content", "copies", total)
    return back.select("t1", "t2", F.transform("runs", lambda x: x + F.col("start")).alias("runs")).distinct()


def _merged(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs become one."""
    for b in got:
        out = []
        for lists in b.column(2).to_pylist():
            runs = np.concatenate([np.array(x, np.int64) for x in lists]).reshape(-1, 2)
            runs = runs[np.argsort(runs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(runs[:, 1])
            first = np.r_[0, np.flatnonzero(runs[1:, 0] > reach[:-1]) + 1]
            last = np.r_[first[1:] - 1, len(runs) - 1]
            out.append([{"from": i, "to": j} for i, j in zip(runs[first, 0].tolist(), reach[last].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["t1", "t2", "spans"])


def dedup(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """``_row`` (all columns of ``docs``), ``n_bytes``, ``spans`` (the removed runs) and ``kept`` (the bytes that stay)."""
    found = spans(docs, p).df
    row = F.struct(*docs.columns).alias("_row")
    rows = _hashed(docs, row).join(found, ["t1", "t2"], "left")
    gone = F.coalesce("spans", F.array().cast("array<struct<from: long, to: long>>"))
    n = F.length("data").cast("long")
    # What stays: from the end of each run, or the text's start, to the next run, or the text's end.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda s: s["to"]))
    stops = F.concat(F.transform("gone", lambda s: s["from"]), F.array(n))
    rows = rows.select("_row", "data", gone.alias("gone"))
    piece = lambda a, b: F.hex(F.substring(F.col("data"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.size("gone") == 0, F.col("data")).otherwise(F.unhex(F.array_join(F.zip_with(starts, stops, piece), "")))
    return rows.select("_row", n.alias("n_bytes"), F.col("gone").alias("spans"), kept.alias("kept"))


def clean(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """``docs`` without repeated passages; columns as before. A character that is cut through becomes U+FFFD."""
    out = dedup(docs, p)
    text = F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") == 0, F.col("_row.n_chars")).otherwise(F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
