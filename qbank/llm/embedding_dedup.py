"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks, one for each half of the vectors, form a product grid
of cells; each length of vectors that occurs has a grid of its own.  Every
vector is filed in one cell and asks the nearest cells in multi-sequence order:
as many as reach the target recall on pairs at the very threshold, measured on
the bounded sample that the codebooks are fitted on.  If too many cells would be
needed, or there are no more vectors of a length than a block has members, all
vectors of that length are compared.  Every candidate is then verified by its
cosine in double precision.

Neighbouring cells are searched together, as groups of some hundred vectors, so a vector travels once to each group that it asks, and as it was read.  A
group is worked in blocks of bounded numbers of members and askers, so a hot
cell is spread over tasks; a block returns counts and a spanning set of its
links, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing (n_links 0, a component of their own, kept), and
vectors of different lengths not with each other; any other finite vector counts,
however long or short it is; of rows of equal vec_id the least vector counts, and
rows without one link with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qbank.llm.common import components, partitions, small, table

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Index:
    cosine: float = 0.95
    #: Bound of the fitted sample of each length: the rows with the smallest hashes of vec_id.
    sample: int = 20_000
    #: Vectors in a cell, on average, that the codebooks' size aims at; and its bound.
    per_cell: int = 64
    most_codes: int = 512
    rounds: int = 10
    #: Recall of pairs at the threshold that the number of asked cells must reach on the sample.
    recall: float = 0.97
    #: If more cells than this are needed, the codebooks are made coarser, until as many reach the recall.
    most_cells: int = 2048
    #: A length with fewer vectors has a single cell: too few to fit a grid on.
    least: int = 48
    #: All vectors of a length are compared, whatever that costs; never chosen by itself.
    exact: bool = False
    #: Vectors in a group of neighbouring cells, and in a block of a group.
    per_group: int = 512
    members: int = 2000
    askers: int = 4000


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    cells: int
    #: The group of each cell.
    groups: np.ndarray | None = None
    #: The share of the sample's pairs at the threshold that the asked cells hold.
    recall: float = 1.0

    @property
    def size(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return _squares(unit[:, :half], self.first), _squares(unit[:, half:], self.second)

    def cell(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return (a.argmin(1) * len(self.second) + b.argmin(1)).astype(np.int32)

    def nearest(self, unit: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` of the multi-sequence traversal, nearest first, shape (n, cells).

        The traversal can only take the pair of ranks (i, j) after the
        (i+1)(j+1)-1 pairs that are no worse in both, so its first T cells lie
        among the pairs with (i+1)(j+1) <= T.
        """
        a, b = self.distances(unit)
        cells = min(cells, a.shape[1] * b.shape[1])
        ra, rb = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        sa, sb = np.take_along_axis(a, ra, 1), np.take_along_axis(b, rb, 1)
        i, j = np.array(
            [(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], cells // (i + 1)))], dtype=int
        ).T
        total = sa[:, i] + sb[:, j]
        best = np.argsort(total, 1, kind="stable")[:, :cells]
        return (ra[np.arange(len(unit))[:, None], i[best]] * len(self.second) + rb[np.arange(len(unit))[:, None], j[best]]).astype(np.int32)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def _codes(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; an empty code keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _squares(x, centres).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(own, x[:, d], minlength=len(centres))
            centres[:, d] = np.where(count > 0, sums / np.maximum(count, 1), centres[:, d])
    if centres.shape[1]:  # along their main axis, so that neighbours in number are near each other
        centres = centres[np.argsort(centres @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0], kind="stable")]
    return centres


def units(vectors: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square leaves the range of doubles."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit(sample: np.ndarray, total: int, p: Index) -> Grid:
    """Codebooks of a grid for ``total`` vectors, and the number of cells to ask."""
    k = int(min(p.most_codes, max(2, round(math.sqrt(total / p.per_cell))), max(2, len(sample) // 8)))
    # Pairs at the very threshold: each of up to 2000 sampled vectors, turned by the greatest allowed angle.
    some = sample[:: max(1, len(sample) // 2000)]
    noise = np.random.default_rng(7).standard_normal(some.shape)
    noise -= (noise * some).sum(1)[:, None] * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    turned = p.cosine * some + math.sqrt(1 - p.cosine**2) * noise
    while (grid := _reaching(sample, some, turned, k, p)) is None:
        k = max(1, k // 2)
    filed = np.bincount(grid.cell(sample), minlength=grid.size) * (total / len(sample))
    grid.groups = ((filed.cumsum() - filed) // p.per_group).astype(np.int32)
    return grid


def _reaching(sample: np.ndarray, some: np.ndarray, turned: np.ndarray, k: int, p: Index) -> Grid | None:
    """A grid of k codes a half with the number of cells that reaches the recall; none if that is more than ``most_cells``."""
    half = sample.shape[1] // 2
    grid = Grid(_codes(sample[:, :half], k, p.rounds), _codes(sample[:, half:], k, p.rounds), 1)
    bound = min(p.most_cells, grid.size)
    most = min(64, bound)
    while True:
        there = grid.nearest(some, most) == grid.cell(turned)[:, None]
        back = grid.nearest(turned, most) == grid.cell(some)[:, None]
        rank = lambda hit: np.where(hit.any(1), hit.argmax(1), most)  # noqa: B023, E731
        needed = np.sort(np.minimum(rank(there), rank(back)))
        at = int(needed[min(len(needed) - 1, math.ceil(p.recall * len(needed)) - 1)])
        if at < most:
            grid.cells, grid.recall = at + 1, float((needed <= at).mean())
            return grid
        if most >= bound:
            return None
        most = min(4 * most, bound)


def whole(length: int) -> Grid:
    """A single cell."""
    return Grid(np.zeros((1, length // 2)), np.zeros((1, length - length // 2)), 1, np.zeros(1, np.int32))


def grids(rows: DataFrame, p: Index) -> dict[int, tuple[Grid, int]]:
    """The grid of each length, and the number of its first group."""
    out, groups = {}, 0
    for length, total in sorted(map(tuple, rows.groupBy(F.size("v")).count().collect())):
        if p.exact or total < p.least:
            grid = whole(length)
        else:
            taken = rows.where(F.size("v") == length).orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).toArrow()
            grid = fit(units(taken["v"].to_pylist()), total, p)
        log.info("%d vectors of length %d: %d of %d cells asked, recall %.3f on the sample", total, length, grid.cells, grid.size, grid.recall)
        out[length] = grid, groups
        groups += int(grid.groups.max()) + 1
    return out


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(fine)


def linked(vectors: DataFrame, p: Index = Index(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, other``: link counts to add up, and links that span what a block found."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[column].dataType, T.ArrayType) and isinstance(vectors.schema[column].dataType.elementType, T.FloatType)
    number = np.dtype(np.float32 if single else np.float64)
    rows = _valid(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast(f"array<{'float' if single else 'double'}>").alias("v")), "v")
    rows = table(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")  # the same one in each pass
    of_length = grids(rows, p)
    if not of_length:
        return spark.createDataFrame([], "vec_id long, n_links long, other long")
    n_groups = sum(int(grid.groups.max()) + 1 for grid, _ in of_length.values())

    def file(got):  # noqa: ANN001, ANN202
        for all_rows in got:
            for at in range(0, all_rows.num_rows, 1024):
                some = all_rows.slice(at, 1024)
                lengths = some.column(1).value_lengths().to_numpy()
                for length in np.unique(lengths).tolist():
                    b = some.take(pa.array(np.flatnonzero(lengths == length)))
                    grid, first = of_length[length]
                    raw = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(number)
                    u = units(raw)
                    asked = np.sort(grid.groups[grid.nearest(u, grid.cells)] + np.int32(first), 1)
                    new = np.ones(asked.shape, bool)
                    new[:, 1:] = asked[:, 1:] != asked[:, :-1]
                    ends = np.r_[0, new.sum(1).cumsum()].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(grid.groups[grid.cell(u)] + np.int32(first)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(asked[new])),
                        ],
                        names=["vec_id", "v", "cell", "asked"],
                    )

    filed = table(rows.select("vec_id", "v").mapInArrow(file, "vec_id long, v binary, cell int, asked array<int>"), "filed")
    asks = filed.select("vec_id", F.explode("asked").alias("at"))
    inside = filed.groupBy(F.col("cell").alias("at")).agg(F.count("*").alias("m"))
    sizes = asks.groupBy("at").agg(F.count("*").alias("q")).join(inside, "at")
    sizes = sizes.select(
        "at", F.ceil(F.col("m") / p.members).cast("int").alias("ms"), F.ceil(F.col("q") / p.askers).cast("int").alias("qs")
    )
    sizes = small(table(sizes, "groups"), n_groups, 32)  # no more rows than cells: most_codes squared a length at most
    split = F.xxhash64(F.col("vec_id"), F.lit("block"))
    members = filed.join(sizes, filed["cell"] == sizes["at"]).select(
        "at", F.pmod(split, F.col("ms")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"),
        F.lit(True).alias("member"), "vec_id", "v", "cell", "asked",
    )
    askers = filed.select("*", F.explode("asked").alias("at")).join(sizes, "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), F.pmod(split, F.col("qs")).cast("int").alias("qb"),
        F.lit(False).alias("member"), "vec_id", "v", "cell", F.lit(None).cast("array<int>").alias("asked"),
    )
    cosine = p.cosine

    def verify(t: pa.Table) -> pa.Table:
        return _block(t, cosine, number)

    both = members.unionByName(askers).repartition(partitions(spark) * 4, "at", "mb", "qb")
    return both.groupBy("at", "mb", "qb").applyInArrow(verify, "vec_id long, n_links long, other long")


def _block(t: pa.Table, cosine: float, number: np.dtype = np.dtype(np.float64)) -> pa.Table:
    """Links between a block's askers and members: counts, and for each node the least node it hangs with."""
    is_member = t["member"].to_numpy(zero_copy_only=False)
    ids = t["vec_id"].to_numpy()
    cell = t["cell"].to_numpy()
    u = units(np.frombuffer(b"".join(t["v"].to_pylist()), number).reshape(len(ids), -1))
    m, q = np.flatnonzero(is_member), np.flatnonzero(~is_member)
    if not len(m) or not len(q):
        return pa.table({"vec_id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    lists = t["asked"].combine_chunks().take(pa.array(m)).to_pylist()
    asked = np.full((len(m), max(map(len, lists))), -1, np.int32)
    for k, x in enumerate(lists):
        asked[k, : len(x)] = x
    mask = np.empty((len(q), len(m)), dtype=bool)
    for at in range(0, len(q), 512):
        some = q[at : at + 512]
        mask[at : at + 512] = (u[some] @ u[m].T >= cosine) & (ids[some][:, None] != ids[m][None])
    by_q, by_m = mask.sum(1), np.zeros(len(m), dtype=np.int64)
    # A member that doesn't ask this asker's group can't count the link itself.
    for c in np.unique(cell[q[by_q > 0]]):
        deaf = ~(asked == c).any(1)
        if deaf.any():
            by_m[deaf] += mask[np.ix_(cell[q] == c, deaf)].sum(0)
    rows, columns = np.flatnonzero(by_q), np.flatnonzero(mask.any(0))
    mask = mask[np.ix_(rows, columns)]
    q, m = q[rows], m[columns]
    lq, lm = ids[q].copy(), ids[m].copy()
    top = np.iinfo(np.int64).max
    while len(q):
        before = (lq.sum(), lm.sum())
        for at in range(0, len(q), 512):
            lq[at : at + 512] = np.minimum(lq[at : at + 512], np.where(mask[at : at + 512], lm[None], top).min(1))
        for at in range(0, len(q), 512):
            lm = np.minimum(lm, np.where(mask[at : at + 512], lq[at : at + 512, None], top).min(0))
        if before == (lq.sum(), lm.sum()):
            break
    return pa.table(
        {
            "vec_id": np.concatenate([ids[q], ids[m]]),
            "n_links": np.concatenate([by_q[rows], by_m[columns]]).astype(np.int64),
            "other": np.concatenate([lq, lm]),
        }
    )


def dedup(vectors: DataFrame, p: Index = Index(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    found = table(linked(vectors, p, id_column, column), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    spans = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    every = vectors.select(F.col(id_column).cast("long").alias("vec_id"))
    out = every.join(counts, "vec_id", "left").join(spans.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )
