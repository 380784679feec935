"""Window-shaped operators: keep-first and keep-last, numbering, runs, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_by(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row of each key with the greatest rank tuple, by aggregation alone."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*rank)).alias("_r")).select("_r.*")


def renumber(df: DataFrame, keys: list[str], order: list[Column], start: int = 1) -> DataFrame:
    """Consecutive numbers from ``start``."""
    return df.withColumn("n", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) + (start - 1)).cast("int"))


def running_sequence(df: DataFrame, keys: list[str], order: str, number: Column, start: int = 1) -> DataFrame:
    """next = max(next + 1, number + 1), closed: place + running max(start, number - place)."""
    w = W.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(w) - 1
    out = df.withColumn("_p", place).withColumn("_lead", number - F.col("_p"))
    before = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.greatest(F.lit(start), F.coalesce(F.max("_lead").over(before), F.lit(start)))
    return out.withColumn("seq", (F.col("_p") + base).cast("int")).drop("_p", "_lead")


def expected_prefix(numbers: Column, start: Column) -> Column:
    """How many leading numbers are start, start + 1, ..."""
    hit = F.transform(numbers, lambda x, i: x == start + i)
    first_miss = F.array_position(hit, False)
    return F.when(first_miss == 0, F.size(numbers)).otherwise((first_miss - 1).cast("int"))


def unique_codes(df: DataFrame, base: str, order: str) -> DataFrame:
    """``base``, ``base-2``, ``base-3``, ... in order."""
    n = F.row_number().over(W.partitionBy(base).orderBy(order))
    return df.withColumn("code", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def suffixed(df: DataFrame, keys: list[str], marker: str, order: str) -> DataFrame:
    """Repeated markers (whatever their case) get ``-2``, ``-3``, ... within their keys."""
    n = F.row_number().over(W.partitionBy(*keys, F.lower(F.col(marker))).orderBy(order))
    return df.withColumn("unique_marker", F.when(n == 1, F.col(marker)).otherwise(F.concat_ws("-", F.col(marker), n.cast("string"))))


def joins_previous(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """A fragment joins the row before if that one breaks off and this one goes on in lower case."""
    before = F.trim(F.lag(text).over(W.partitionBy(*keys).orderBy(order)))
    breaks = before.isNotNull() & (before != "") & ~F.rlike(before, F.lit(r"[.!?:)]$"))
    return df.withColumn("joins_previous", F.coalesce(breaks & F.rlike(F.trim(F.col(text)), F.lit("^[a-záéíóúüñ,;]")), F.lit(False)))


def columns_of(df: DataFrame, keys: list[str], centre: Column, least_gap: float = 80.0, least_share: float = 0.12, least_boxes: int = 4) -> DataFrame:
    """Two columns where the widest gap between neighbouring centres is wide enough."""
    w = W.partitionBy(*keys).orderBy("_c")
    out = df.withColumn("_c", centre)
    gaps = out.withColumn("_next", F.lead("_c").over(w)).withColumn("_gap", F.col("_next") - F.col("_c"))
    cut = gaps.groupBy(*keys).agg(
        F.max_by("_c", F.struct(F.coalesce("_gap", F.lit(-1.0)), -F.col("_c"))).alias("_cut"),
        F.max("_gap").alias("_widest"), (F.max("_c") - F.min("_c")).alias("_span"), F.count("*").alias("_boxes"),
    )
    two = (F.col("_boxes") >= least_boxes) & (F.col("_widest") >= F.greatest(F.lit(least_gap), F.col("_span") * least_share))
    return out.join(cut, keys).withColumn("column_no", F.when(two & (F.col("_c") > F.col("_cut")), 1).otherwise(0)).drop("_c", "_cut", "_widest", "_span", "_boxes")


def runs(df: DataFrame, keys: list[str], order: str, active: Column, close_gap: int = 0, least: int = 1) -> DataFrame:
    """Runs of active rows, gaps up to ``close_gap`` closed, short runs dropped: first, last, rows."""
    w = W.partitionBy(*keys).orderBy(order)
    on = df.where(active).withColumn("_prev", F.lag(order).over(w))
    fresh = F.when(F.col("_prev").isNull() | (F.col(order) - F.col("_prev") > close_gap + 1), 1).otherwise(0)
    on = on.withColumn("_new", fresh)
    on = on.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = on.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))
    return out.where(F.col("last") - F.col("first") + 1 >= least)
