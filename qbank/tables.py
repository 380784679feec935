"""Intermediate results written to the folder that all executors share, so that lineage ends there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_folders: list[_Folder] = []


@atexit.register
def _clear() -> None:
    """What is left is removed when the driver's process ends, as far as its session still answers."""
    for folder in [*_folders]:
        with contextlib.suppress(Exception):
            folder.drop()
    for path in _made:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and all runs in one process, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="qbank-"))
    return _made[0]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by keys over all cores: a file of few row groups is read by few tasks, whatever the work on a row."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's 10,000: whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


class _Folder:
    """A new folder in the shared one; ``drop`` removes it."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/qbank-{tag}-{uuid.uuid4().hex}"
        _folders.append(self)

    def drop(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        with contextlib.suppress(ValueError):
            _folders.remove(self)


class Written(_Folder):
    """``df`` as Parquet in the shared folder: lost executors cost a reread."""

    def __init__(self, df: DataFrame, tag: str) -> None:
        super().__init__(df.sparkSession, tag)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)


class WrittenText(_Folder):
    """The column ``value`` as lines of text, in a folder for each value of ``by`` if that is given."""

    def __init__(self, df: DataFrame, tag: str, by: str | None = None) -> None:
        super().__init__(df.sparkSession, tag)
        (df.write.partitionBy(by) if by else df.write).text(self.path)
