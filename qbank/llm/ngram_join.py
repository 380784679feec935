r"""N-gram Jaccard self-join by signature trees, exact.

Documents are sets of five-word shingles; two link when
``100 * |intersection| >= 75 * |union|``.  The result names each document's
component, not the pairs of a group of copies.

1.  One pass gives each text its set's size, digest and signature, and adds its
    shingles to a document-frequency sketch of fixed size.  Texts with equal
    sets are one class from here on, whatever their number.
2.  A second pass emits each class's prefix: its rarest shingles by the
    sketch, then by hash, as many as any partner must share one of.  The order
    may be any fixed one, so the sketch's errors cost time only.  Classes that
    share a prefix shingle form a unit; units with the same members are one.
3.  Each unit's classes are put into a signature tree: a node holds the
    OR-combined token bitmaps and the size range of what is below.  A dual
    traversal of the tree prunes node pairs whose maximum possible overlap is
    too small for their sizes, or that are one component already.  Units above
    a bounded number of classes are cut by size, and dealt out as pairs of
    blocks whose sizes allow a link.
4.  The first traversal yields a spanning forest of each unit's candidate
    links (of a large unit, within its blocks and between neighbouring ones),
    which are verified on the whole sets; the second one yields every candidate
    between classes that are still apart.  All links that could join two
    components are thus verified, and none is taken on trust.

A shingle that the sketch says to be frequent is dealt out over salts; large
units and classes with many partners are joined and sent in bounded parts.

Token bitmaps are thermometers: 256 slots of 8 bits; the k-th token of a set in
a slot sets the slot's k-th bit (they are sent as levels), so the overlap of two sets is at most the
common bits plus the lesser overflow, and OR-ing bitmaps keeps that a bound for
all below.

``links_of`` gives every link between classes instead, without step 4's forest and
components.

Defined results: null or wordless text has an empty set, n_shingles 0, and links
with nothing; with one to four words the whole sequence is one shingle; rows
that repeat a doc_id are told apart by their sets; rows without a doc_id link
with nothing; an empty table gives an empty result; other columns are not read.
``clean`` leaves one row of each doc_id that stays, and all rows without one.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import NARROW, Table, components, join_hot, mix, partitions, scratch, small, table, text_batches

SLOTS, LEVELS = 256, 8


@dataclass(frozen=True)
class Join:
    words: int = 5
    #: 100 * intersection >= percent * union
    percent: int = 75
    #: Cells of the document-frequency sketch (a byte each in the broadcast): fixed, whatever the corpus.
    cells: int = 1 << 22
    #: Classes in a block of a unit; larger units are dealt out as pairs of blocks.
    block: int = 1024
    leaf: int = 16
    #: Partners of a class that are sent together, and the bytes of a batch of sets.
    partners: int = 256
    #: Classes of a shingle that one task may have in any case.
    unsalted: int = 256
    batch_bytes: int = 4 << 20
    #: Prefix shingles of a task that are sorted and packed together, and the packs' buckets for each partition.
    packed: int = 1 << 20
    buckets: int = 8


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, percent: int):  # noqa: ANN201
    """The smallest intersection with which sets of these sizes link."""
    total = (x + y) * percent
    return -(-total // (100 + percent))


def signature(tokens: np.ndarray) -> tuple[bytes, int]:
    """The levels of a set's slots, two in a byte, and the tokens beyond them."""
    load = np.bincount((tokens & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    level = np.minimum(load, LEVELS)
    return (level[::2] | level[1::2] << 4).astype(np.uint8).tobytes(), int((load - level).sum())


#: The thermometers of two slots, by the byte of their levels.
_THERMOMETERS = np.array([[(1 << min(x, LEVELS)) - 1 for x in (b & 15, b >> 4)] for b in range(256)], np.uint8)


def bitmaps(signatures: list[bytes]) -> np.ndarray:
    """The thermometer bitmaps of some signatures, a row of words for each."""
    return _THERMOMETERS[np.frombuffer(b"".join(signatures), np.uint8)].reshape(len(signatures), -1).view(np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the first one, and the steps to the others in as few bytes each as the largest needs."""
    steps = np.diff(keys)
    wide = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpacked(raw: bytes, many: int) -> np.ndarray:
    steps = np.zeros((many, 8), np.uint8)
    steps[0] = np.frombuffer(raw[:8], np.uint8)
    steps[1:, : (len(raw) - 8) // max(1, many - 1)] = np.frombuffer(raw[8:], np.uint8).reshape(many - 1, -1) if many > 1 else 0
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if x.max() < 1 << 16 else np.uint32).tobytes()


def _widened(raw: bytes, many: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * many else np.uint32).astype(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, p: Join) -> DataFrame:
    """Of each document ``doc_id, n, cls, sig, over``; besides, rows of the frequency sketch (``block, counts``)."""
    size, cells, step = p.words, p.cells, min(p.cells, 1 << 16)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, dtype=np.int32)
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        held = 0
        for whole in got:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                n, cls, sig, over = [], [], [], []
                for text in b.column(1).to_pylist():
                    t = shingles(text, size)
                    d = _digest(t)
                    s, o = signature(t)
                    n.append(len(t))
                    cls.append(d)
                    sig.append(s)
                    over.append(o)
                    if d not in seen:  # copies inside a task count once
                        seen.add(d)
                        pending.append((t >> np.uint64(20)) & np.uint64(cells - 1))
                        held += len(t)
                        if held > 1 << 20:
                            count += np.bincount(np.concatenate(pending).astype(np.int64), minlength=cells).astype(np.int32)
                            pending, held = [], 0
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), pa.array(over, pa.int32()),
                     none.cast(pa.int32()), none.cast(pa.binary())],
                    names=["doc_id", "n", "cls", "sig", "over", "block", "counts"],
                )
        if pending:
            count += np.bincount(np.concatenate(pending).astype(np.int64), minlength=cells).astype(np.int32)
        if not seen:
            return
        small_counts = np.minimum(count, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
        for k in range(0, cells, step):
            one = pa.nulls(1)
            yield pa.RecordBatch.from_arrays(
                [one.cast(pa.int64()), one.cast(pa.int64()), one.cast(pa.int64()), one.cast(pa.binary()), one.cast(pa.int32()),
                 pa.array([k // step], pa.int32()), pa.array([zlib.compress(small_counts[k : k + step].T.tobytes(), 1)], pa.binary())],
                names=["doc_id", "n", "cls", "sig", "over", "block", "counts"],
            )

    return _texts(docs).mapInArrow(
        run, "doc_id long, n long, cls long, sig binary, over int, block int, counts binary"
    )


def _frequencies(rows: DataFrame, p: Join) -> np.ndarray:
    """The sketch's cells as ranks of one byte: halves of log2 of the counts.  Fixed size (``p.cells`` bytes)."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for b in t["counts"]:
            low, high = np.frombuffer(zlib.decompress(b.as_py()), np.uint8).reshape(2, -1).astype(np.float64)
            x = low + 256 * high
            total = x if not len(total) else total + x
        rank = np.round(2 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "rank": pa.array([rank.tobytes()], pa.binary())})

    got = rows.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, rank binary").collect()
    return np.frombuffer(b"".join(r[1] for r in sorted(got)), np.uint8) if got else np.zeros(p.cells, np.uint8)


def _salts(rank: np.ndarray, parts: int, unsalted: int) -> np.ndarray:
    """By rank of a sketch's cell: over how many tasks its shingles are dealt, so that none holds more than a fraction of a task's share.

    The sketch counts no shingle too low, and a class has a quarter of its shingles in its prefix or less.
    """
    most = 2.0 ** (np.arange(256) / 2 + 0.25) - 1  # a rank is the rounded double of log2(1 + count)
    total = float((np.bincount(rank, minlength=256) * (2.0 ** (np.arange(256) / 2) - 1)).sum())
    return np.clip(np.ceil(most / max(unsalted, total / (16 * parts))), 1, parts).astype(np.int64)


def _prefixes(docs: DataFrame, rank, p: Join) -> DataFrame:  # noqa: ANN001
    """The prefix shingles of each class, in the global order, packed by buckets: ``bucket, keys, tokens, cls, n, pos``.

    A row holds shingles of many classes, sorted by key: the shingle itself, or, where
    it is dealt out, a hash of it and its salt, with the shingles in ``tokens``.
    """
    size, percent, cells = p.words, p.percent, p.cells
    parts_of_all, unsalted = partitions(docs.sparkSession), p.unsalted
    buckets, most = p.buckets * parts_of_all, p.packed

    def packs(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        long = [len(x[0]) for x in parts]
        token, salts = np.concatenate([x[0] for x in parts]), np.concatenate([x[3] for x in parts])
        cls = np.repeat(np.array([x[1] for x in parts], np.int64), long)
        n = np.repeat(np.array([x[2] for x in parts], np.int64), long)
        pos = np.concatenate([np.arange(k) for k in long])
        dealt = salts > 1
        salt = np.mod(cls, salts).astype(np.uint64)
        for chosen in (np.flatnonzero(~dealt), np.flatnonzero(dealt)):
            if not len(chosen):
                continue
            salted = bool(dealt[chosen[0]])
            key = mix(token[chosen] ^ mix(salt[chosen] + np.uint64(1))) if salted else token[chosen]
            order = np.argsort(key)
            key, chosen = key[order], chosen[order]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            rows: list[tuple] = []
            held = 0
            for i, j in zip(cuts, cuts[1:], strict=False):
                of = chosen[i:j]
                rows.append((int(bucket[i]), packed(key[i:j]), token[of].tobytes() if salted else None, cls[of].tobytes(), _narrow(n[of]), _narrow(pos[of])))
                held += j - i
                if held > 1 << 17 or j == len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=names)
                    rows, held = [], 0

    names = ["bucket", "keys", "tokens", "cls", "n", "pos"]

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen = rank.value, set()
        salts_of = _salts(by, parts_of_all, unsalted)
        parts: list[tuple] = []
        held = 0
        for whole in got:
            for at in range(0, whole.num_rows, 256):
                for text in whole.column(1).slice(at, 256).to_pylist():
                    t = shingles(text, size)
                    d = _digest(t)
                    if len(t) and d not in seen:  # copies inside a task emit once
                        seen.add(d)
                        long = len(t) - (-(-len(t) * percent // 100)) + 1
                        rare = by[((t >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64)]
                        order = np.lexsort((t, rare))[:long]
                        parts.append((t[order], d, len(t), salts_of[rare[order]]))
                        held += long
                        if held >= most:
                            yield from packs(parts)
                            parts, held = [], 0
        if parts:
            yield from packs(parts)

    return _texts(docs).mapInArrow(run, "bucket int, keys binary, tokens binary, cls binary, n binary, pos binary")


def _units(prefixes: DataFrame, p: Join) -> DataFrame:
    """``unit, cls, n, pos``: classes that share a prefix shingle; units of the same members are one.

    A task works one bucket after the other; a shingle of one class alone, or of
    two that cannot link by size and place, is dropped.  Salted shingles are
    named by an aggregation over their salts.
    """
    percent = p.percent
    names = ["unit", "token", "cls", "n", "pos"]

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[tuple], list[tuple]] = ([], [])  # of a bucket: single shingles, salted ones
        now = None
        for b in got:
            for bucket, keys, tokens, cls, n, pos in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if bucket != now:
                    yield from grouped(held)
                    held, now = ([], []), bucket
                many = len(cls) // 8
                key = unpacked(keys, many)
                token = key if tokens is None else np.frombuffer(tokens, np.uint64)
                held[tokens is not None].append((key, token, np.frombuffer(cls, np.int64), _widened(n, many), _widened(pos, many)))
        yield from grouped(held)

    def grouped(held: tuple[list[tuple], list[tuple]]) -> Iterator[pa.RecordBatch]:
        for salted, packs in enumerate(held):
            if not packs:
                continue
            key, token, cls, n, pos = (np.concatenate(x) for x in zip(*packs, strict=True))
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])  # a class from several tasks
            key, cls, order = key[fresh], cls[fresh], order[fresh]
            token, n, pos = token[order], n[order], pos[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            good = (sizes > 1) | bool(salted)
            pair = (sizes == 2) & (not salted)
            two = starts[pair]
            most = np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1])
            good[pair] = most >= least_overlap(n[two].astype(np.int64), n[two + 1].astype(np.int64), percent)
            if not good.any():
                continue
            name = np.add.reduceat(mix(cls.view(np.uint64)), starts) ^ sizes.astype(np.uint64)
            keep = np.repeat(good, sizes)
            many = int(keep.sum())
            none = pa.nulls(many, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    none if salted else pa.array(np.repeat(name, sizes)[keep].view(np.int64)), pa.array(token[keep].view(np.int64)) if salted else none,
                    pa.array(cls[keep]), pa.array(n[keep]), pa.array(pos[keep]),
                ],
                names=names,
            )

    spark = prefixes.sparkSession
    rows = prefixes.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    rows = table(rows.mapInArrow(run, "unit long, token long, cls long, n int, pos int"), "shared")
    salted = rows.where("token is not null").select("token", "cls", "n", "pos")
    named = table(
        salted.groupBy("token").agg(F.count("*").alias("many"), F.expr("bit_xor(xxhash64(cls))").alias("x"))
        .where("many > 1").select("token", "many", F.xxhash64("x", "many", F.lit("salted")).alias("unit")),
        "named",
    )
    total = named.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    rows = rows.where("token is null").select("unit", "cls", "n", "pos")
    if total:
        rows = rows.unionByName(join_hot(salted, named, "token", "many", total).select("unit", "cls", "n", "pos"))
    return rows.groupBy("unit", "cls").agg(F.first("n").alias("n"), F.min("pos").alias("pos"))


class Node:
    __slots__ = ("bits", "children", "high", "label", "low", "over", "pos", "rows")

    def __init__(self, rows: np.ndarray, children: list[Node], s: Sets) -> None:
        self.rows, self.children = rows, children
        if children:
            self.bits = np.bitwise_or.reduce([c.bits for c in children])
            self.over = max(c.over for c in children)
            self.low, self.high = min(c.low for c in children), max(c.high for c in children)
            self.pos = min(c.pos for c in children)
            labels = {c.label for c in children}
        else:
            self.bits = np.bitwise_or.reduce(s.bits[rows])
            self.over = int(s.over[rows].max())
            self.low, self.high = int(s.n[rows].min()), int(s.n[rows].max())
            self.pos = int((s.pos[rows] - s.n[rows]).min())
            labels = set(s.label[rows].tolist())
        self.label = labels.pop() if len(labels) == 1 else None


class Sets:
    """The classes of one block pair of a unit, as arrays sorted by component and size."""

    def __init__(self, t: pa.Table) -> None:
        cls, n, pos, over, label, side = (t[c].to_numpy(zero_copy_only=False) for c in ("cls", "n", "pos", "over", "label", "side"))
        bits = bitmaps(t["sig"].to_pylist())
        order = np.lexsort((cls, n, label))
        self.cls, self.n, self.pos, self.over = cls[order], n[order].astype(np.int64), pos[order].astype(np.int64), over[order].astype(np.int64)
        self.label, self.side, self.bits = label[order], side[order], bits[order]


def _tree(s: Sets, rows: np.ndarray, leaf: int) -> Node:
    """A tree over neighbours in (component, size): eight children a node."""
    level = [Node(rows[i : i + leaf], [], s) for i in range(0, len(rows), leaf)]
    while len(level) > 1:
        level = [Node(np.concatenate([c.rows for c in level[i : i + 8]]), level[i : i + 8], s) for i in range(0, len(level), 8)]
    return level[0]


def _pairs(s: Sets, p: Join) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs by dual traversal: of a unit with itself, or between its two blocks."""
    sides = np.unique(s.side)
    a = _tree(s, np.flatnonzero(s.side == sides[0]), p.leaf)
    b = _tree(s, np.flatnonzero(s.side == sides[1]), p.leaf) if len(sides) == 2 else a
    found, going = [], [(a, b)]
    while going:
        x, y = going.pop()
        if x.label is not None and x.label == y.label:
            continue
        if x is not y:
            # sizes: the overlap is at most the smaller set
            need = least_overlap(x.low, y.low, p.percent)
            if x.high * 100 < p.percent * y.low or y.high * 100 < p.percent * x.low:
                continue
            most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.over, y.over)
            if min(most, x.high, y.high, -x.pos, -y.pos) < need:
                continue
        if not x.children and not y.children:
            found.append(_leaf(s, x.rows, y.rows, x is y, p.percent))
        elif x is y:
            c = x.children
            going += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
        elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
            going += [(c, y) for c in x.children]
        else:
            going += [(x, c) for c in y.children]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _leaf(s: Sets, x: np.ndarray, y: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    if same:
        i, j = np.triu_indices(len(x), 1)
        x, y = x[i], x[j]
    else:
        x, y = np.repeat(x, len(y)), np.tile(y, len(x))
    need = least_overlap(s.n[x], s.n[y], percent)
    fit = (s.label[x] != s.label[y]) & (np.minimum(s.n[x] - s.pos[x], s.n[y] - s.pos[y]) >= need)
    x, y, need = x[fit], y[fit], need[fit]
    most = np.bitwise_count(s.bits[x] & s.bits[y]).sum(1).astype(np.int64) + np.minimum(s.over[x], s.over[y])
    return x[most >= need], y[most >= need]


def _forest(x: np.ndarray, y: np.ndarray, s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of candidate pairs: each tree takes its pair to the tree of the smallest class, until none is left."""
    rank = np.empty(len(s.cls), np.int64)
    rank[np.argsort(s.cls)] = label = np.arange(len(s.cls))
    low, high = np.minimum(rank[x], rank[y]), np.maximum(rank[x], rank[y])
    going, keep = np.arange(len(x)), []
    while len(going):
        one, two = label[low[going]], label[high[going]]
        apart = one != two
        going, small, big = going[apart], np.minimum(one, two)[apart], np.maximum(one, two)[apart]
        if not len(going):
            break
        order = np.lexsort((high[going], low[going], small, big))
        first = order[np.r_[True, big[order][1:] != big[order][:-1]]]
        keep.append(going[first])
        up = np.arange(len(label))
        up[big[first]] = small[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    taken = np.concatenate(keep) if keep else going
    return x[taken], y[taken]


#: Blocks of a unit are numbered by size bucket, then within it.
IN_BUCKET = 1 << 20


def _blocks(units: DataFrame, labels: DataFrame | None, p: Join, chained: bool) -> DataFrame:
    """``unit, lo, hi, side, cls, n, pos, label``: the units' classes, dealt out as pairs of blocks.

    Sets link only if their sizes lie in one bucket or two neighbouring ones.
    A unit of at most ``block`` classes is one block.
    """
    rows = units.withColumn("label", F.col("cls"))
    if labels is not None:
        rows = units.join(labels, "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
        rows = table(rows, "labelled")
    width = 1.0001 * max(0.01, math.log(100 / p.percent))
    rows = rows.withColumn("bucket", F.floor(F.log("n") / width).cast("int"))
    counts = rows.groupBy("unit", "bucket").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("r"))
    entry = F.struct("bucket", F.ceil(F.col("m") / p.block).cast("int").alias("nb"))
    whole = counts.groupBy("unit").agg(  # a bucket for each power of 4/3: some dozens at most
        F.sum("m").alias("many"), F.min("l").alias("l"), F.max("r").alias("r"), F.map_from_entries(F.collect_list(entry)).alias("nbs")
    )
    whole = whole.where("many > 1 and l <> r").select("unit", "many", F.when(F.col("many") > p.block, F.col("nbs")).alias("nbs"))
    whole = table(whole, "whole")
    total = whole.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    rows = join_hot(rows, whole, "unit", "many", total)
    mine = F.col("bucket") * IN_BUCKET + F.pmod(F.xxhash64("cls"), F.col("nbs")[F.col("bucket")]).cast("int")
    rows = rows.withColumn("blk", F.when(F.col("nbs").isNull(), F.lit(0)).otherwise(mine))
    if chained:
        near = F.filter(
            F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1),
            lambda x: (x >= F.col("bucket") * IN_BUCKET) & (x < F.col("bucket") * IN_BUCKET + F.col("nbs")[F.col("bucket")]),
        )
    else:
        near = F.flatten(
            F.transform(
                F.filter(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1), lambda k: F.col("nbs")[k].isNotNull()),
                lambda k: F.transform(F.sequence(F.lit(0), F.col("nbs")[k] - 1), lambda j: k * IN_BUCKET + j),
            )
        )
    others = F.when(F.col("nbs").isNull(), F.array(F.lit(0))).otherwise(near)
    return rows.withColumn("other", F.explode(others)).select(
        "unit", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), F.col("blk").alias("side"), "cls", "n", "pos", "label"
    )


def _candidates(units: DataFrame, classes: DataFrame, labels: DataFrame | None, p: Join, all_pairs: bool) -> DataFrame:
    """``a, b``: distinct candidate pairs of classes (a < b) in different components: all, or a forest of them."""
    spark = units.sparkSession
    rows = table(_blocks(units, labels, p, chained=not all_pairs), "blocks")
    uses = rows.groupBy("cls").agg(F.count("*").alias("uses"))
    total = rows.count()
    rows = join_hot(rows, uses.join(classes.select("cls", "sig", "over"), "cls"), "cls", "uses", total)
    rows = rows.select("unit", "lo", "hi", "side", "cls", "n", "pos", "label", "sig", "over")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def units_of(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units follow each other in a sorted partition; each is worked when it is whole."""
        held: list[pa.RecordBatch] = []
        key = None
        told: set[tuple[int, int]] = set()
        out: tuple[list[int], list[int]] = ([], [])
        for b in got:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                this = tuple(keys[:, i].tolist())
                if this != key and held:
                    work(held, told, out)
                    held = []
                key = this
                held.append(b.slice(i, j - i))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], schema=schema)
                out = ([], [])
                if len(told) > 1 << 20:
                    told = set()
        if held:
            work(held, told, out)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], schema=schema)

    def work(held: list[pa.RecordBatch], told: set, out: tuple[list, list]) -> None:
        s = Sets(pa.Table.from_batches(held))
        x, y = _pairs(s, p)
        if len(x) and not all_pairs:
            x, y = _forest(x, y, s)
        for i, j in zip(np.minimum(s.cls[x], s.cls[y]).tolist(), np.maximum(s.cls[x], s.cls[y]).tolist(), strict=True):
            if (i, j) not in told:
                told.add((i, j))
                out[0].append(i)
                out[1].append(j)

    rows = rows.repartition(partitions(spark) * 2, "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi")
    return rows.mapInArrow(units_of, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, p: Join) -> DataFrame:
    """The pairs that do link, by their whole sets, recomputed from one text of each class.

    Each pair's ``b`` comes to ``a``'s set.  A class with many partners, on
    either side, is dealt out in parts of about ``partners`` of them.
    """
    spark = docs.sparkSession
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    total = pairs.count()
    salts = F.ceil(F.col("many") / p.partners).cast("int")
    salted = join_hot(pairs, many, "a", "many", total, NARROW).select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), "b")
    own = salted.select("a", "salt").distinct().select(F.col("a").alias("cls"), F.struct("a", "salt", F.lit(True).alias("own")).alias("to"))
    partner = salted.select(F.col("b").alias("cls"), F.struct("a", "salt", F.lit(False).alias("own")).alias("to"))
    to = table(own.unionByName(partner), "to")
    uses = to.groupBy("cls").agg(F.count("*").alias("many")).join(heads, "cls")
    to = join_hot(to, uses, "cls", "many", 2 * total, NARROW).withColumn("part", F.pmod(F.xxhash64("to"), F.ceil(F.col("many") / p.partners)))
    wanted = table(to.groupBy("cls", "doc_id", "part").agg(F.collect_list("to").alias("to")).drop("part"), "wanted")
    texts = _texts(docs).where("text is not null")
    wanted = small(wanted, *_sizes(wanted))
    size, percent = p.words, p.percent
    schema = "a long, salt int, other boolean, cls long, tokens binary"
    names, kinds, most = ["a", "salt", "other", "cls", "tokens"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()], p.batch_bytes

    def send(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in got:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows: list[list] = [[], [], [], [], []]
                held = 0
                for text, cls, to in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    t = shingles(text, size)
                    if _digest(t) != cls:  # another row of the same id
                        continue
                    raw = t.tobytes()
                    for x in to:
                        for c, v in zip(rows, (x["a"], x["salt"], not x["own"], cls, raw), strict=True):
                            c.append(v)
                        held += len(raw)
                        if held > most:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)
                            rows, held = [[], [], [], [], []], 0
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    sent = texts.join(wanted, "doc_id").select("text", "cls", "to").mapInArrow(send, schema)
    sent = sent.repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "other", "cls")

    def test(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, last = None, None, None
        for whole in got:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: tuple[list[int], list[int]] = ([], [])
                for a, salt, other, cls, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if not other:
                        now, mine, last = (a, salt), np.frombuffer(raw, np.uint64), None
                        continue
                    if (a, salt) != now or cls == last:  # a repeated row
                        continue
                    last = cls
                    theirs = np.frombuffer(raw, np.uint64)
                    place = np.searchsorted(mine, theirs)
                    both = int((mine[np.minimum(place, len(mine) - 1)] == theirs).sum())
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        rows[0].append(a)
                        rows[1].append(cls)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], names=["a", "b"])

    return sent.mapInArrow(test, "a long, b long")


def _sizes(wanted: DataFrame) -> tuple[int, int]:
    rows, entries = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("to")), F.lit(0))).first()
    return rows, 40 + 40 * entries // max(1, rows)


def _prepared(docs: DataFrame, p: Join):  # noqa: ANN202
    """Each row's set, the classes with their least ``doc_id``, the units, and the broadcast ranks."""
    rows = table(_sets(docs, p), "sets")
    mine = rows.where("block is null")
    rank = docs.sparkSession.sparkContext.broadcast(_frequencies(rows, p))
    classes = table(
        mine.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("over").alias("over")),
        "classes",
    )
    units = table(_units(_prefixes(docs, rank, p), p), "units")
    return mine, classes, units, rank


def links_of(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``doc_a, doc_b``: every link between different sets, each class named by its least ``doc_id``.

    No forest and no pruning of components: the pairs of a group of m near copies are all verified.
    """
    _, classes, units, rank = _prepared(docs, p)
    heads = classes.select("cls", "doc_id")
    links = table(_verified(table(_candidates(units, classes, None, p, all_pairs=True), "pairs"), docs, heads, p), "links")
    rank.unpersist()
    a, b = heads.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), heads.select(F.col("cls").alias("b"), F.col("doc_id").alias("y"))
    return links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def components_of(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    mine, classes, units, rank = _prepared(docs, p)
    heads = classes.select("cls", "doc_id")
    tried = table(_candidates(units, classes, None, p, all_pairs=False), "pairs")
    links = table(_verified(tried, docs, heads, p), "links")
    labels = table(components(links), "labels")
    rest = _candidates(units, classes, labels.withColumnRenamed("node", "cls"), p, all_pairs=True)
    rest = table(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = table(links.unionByName(_verified(rest, docs, heads, p)), "links")
        labels = table(components(links), "labels")
    rank.unpersist()
    named = labels.join(heads.withColumnRenamed("cls", "node"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = heads.join(
        labels.withColumnRenamed("node", "cls").join(least, "component").select("cls", "component_id"), "cls", "left"
    ).select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    return mine.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def clean(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """Exactly one row of each component stays: that with the least doc_id. Columns as before, of any type.

    Rows are told apart by numbers of their own (in a table, so that they are
    fixed), not by their ids: of rows that share the least id of a component one
    stays, and a row without text or words is a component of its own. Rows
    without a doc_id are in no group and all stay.
    """
    row = F.struct(*docs.columns).alias("_doc")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    with scratch(docs.sparkSession) as keep:
        kept = Table(rows, "rows")
        named = kept.df.where("_id is not null")
        found = components_of(named.select(F.col("_row").alias("doc_id"), F.col("_text").alias("text")), p).select(F.col("doc_id").alias("_row"), "component_id")
        least = found.join(named.select("_row", "_id"), "_row").groupBy("component_id").agg(F.min(F.struct("_id", "_row")).alias("least"))
        stay = Table(least.select(F.col("least._row").alias("_row")), "stay")
        keep(kept, stay)
    left = named.join(small(stay.df, stay.df.count(), 48), "_row", "left_semi")
    return kept.df.where("_id is null").select("_doc.*").unionByName(left.select("_doc.*"))
