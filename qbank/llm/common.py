"""Helpers shared by the operators: shared-folder tables, components, Arrow glue."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the runs of bytes outside these (space, \t \n \v \f \r).
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java/RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A side of at most this many bytes is broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session sets none and all runs in one process (local tests)
    an own folder is made; on a cluster there is no other way.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and "cluster" not in master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="qbank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the process ends  # noqa: BLE001
        pass


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most 1,000 rows from here on: whole texts are long.

    The default of 10,000 rows would hold tens of megabytes of text at once on
    both sides of the pipe; a setting other than the default is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


_paths: set[str] = set()
_sessions: list[SparkSession] = []


@atexit.register
def _clear() -> None:
    for path in _paths if _sessions else ():
        _delete(_sessions[0], path)


class Table:
    """A result written as Parquet into the shared folder, so that lineage ends there.

    Lost executors then cost a reread, not a recomputation.  ``drop`` removes the
    files at once, the end of the driver process otherwise.
    """

    def __init__(self, df: DataFrame, tag: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/qbank-{tag}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        _paths.add(self.path)
        _sessions[:] = [self.spark]

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _paths.discard(self.path)


def table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Table(df, tag).df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables made inside are removed at the end, but for those that the given function has been told to keep."""
    before, kept = set(_paths), set()
    yield lambda *tables: kept.update(t.path for t in tables)
    for path in _paths - before - kept:
        _delete(spark, path)
        _paths.discard(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows one, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, few: int = 4096) -> DataFrame:
    """``rows`` joined with ``keyed`` by ``key``, without dealing a hot key's rows into one task.

    ``keyed`` has a row for each key, with the number of its rows in ``count``;
    ``total`` is their sum.  Keys above a quarter of a partition's share are at
    most four for each partition: those are broadcast, and their rows stay where
    they are.  The others are joined by a shuffle, and so is everything if there
    are no more than ``few`` rows: 4,096 rows of any kind, or ``NARROW`` (262,144,
    some 12 MB) rows of two or three numbers, which any one task can take.  Both ways
    give the same rows.
    """
    if total <= few:
        return rows.join(keyed, key)
    hot = F.col(count) > max(1, total // (4 * partitions(rows.sparkSession)))
    broad = F.broadcast(keyed.where(hot))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti")
    return rows.join(broad, key).unionByName(rest.join(keyed.where(~hot), key))


#: Rows of two or three numbers that one task takes at ease: some megabytes.
NARROW = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges(a, b)`` to ``(node, component)``.

    Alternating large-star and small-star rounds: joins and minimum
    aggregations only, and a hub's neighbours are dealt by ``join_hot``, so
    neither they nor a component are ever gathered in one task.  The rounds end
    when nothing moves.  ``component`` is the smallest node of a component;
    nodes without edges are absent.  Self loops are allowed and ignored.
    """
    pair = lambda df, u, v: df.select(F.col(u).alias("u"), F.col(v).alias("v"))
    last = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    many, before = last.df.count(), None
    while True:
        both = pair(last.df, "u", "v").unionByName(pair(last.df, "v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))
        large = join_hot(both, least, "u", "degree", 2 * many, NARROW).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Table(large.where("u <> v").distinct(), "cc")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        moved = join_hot(large.df, least, "u", "degree", large.df.count(), NARROW).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        sign = new.df.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        last.drop()
        large.drop()
        last, many = new, sign[0]
        if sign == before:
            break
        before = sign
    roots = last.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return last.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def fence(column: Column) -> Column:
    """``column`` as it is, but no filter on it is pushed below its projection.

    A pushed filter takes the expression along and writes out, inside each
    lambda, the arrays that the projections below hold as columns: work that
    was linear in a text's length would become quadratic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
