"""Sort keys, top-k, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qbank.functions.similarity import l2_distance

#: The place of a missing or negative page or box: after all others.
LAST = 10**9


def natural_key(c: Column) -> Column:
    """O3: lower case, runs of digits by value: each is padded to twelve places."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.lpad(F.ltrim(p, F.lit("0")), 12, "0")).otherwise(p)), "")


def place(c: Column) -> Column:
    """A page or box number, the last place if it is missing or negative."""
    return F.coalesce(F.when(c >= 0, c), F.lit(LAST))


def ranked(c: Column, ranks: dict[str, int], default: int = 9) -> Column:
    """O2: the rank of a state."""
    out = F.lit(default)
    for value, rank in ranks.items():
        out = F.when(c == value, rank).otherwise(out)
    return out


def running(df: DataFrame, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """The running sum of ``weight`` (1: the rank) over all rows in ascending ``order``, which should tell rows apart.

    Rows are dealt out over ranges of the order, and one total for each range reaches the driver, so no task sees all
    rows. The bounds are values, not the places of an exchange: whatever is computed again deals out alike.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))).withColumn("_w", F.lit(1) if weight is None else weight)
    kinds = [f.dataType for f in rows.schema["_key"].dataType]
    some = sorted_keys(rows, 20 * n)
    bounds = [F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(some[len(some) * k // n], kinds, strict=True)))) for k in range(1, n)] if len(some) >= n else []

    def place_in(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_key") < bounds[mid], place_in(lo, mid)).otherwise(place_in(mid + 1, hi))

    rows = rows.withColumn("_range", place_in(0, len(bounds)))
    totals, before = dict(rows.groupBy("_range").agg(F.sum("_w")).collect()), {}
    for k in sorted(totals):
        before[k] = sum(totals[j] for j in totals if j < k)
    bases = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "_range int, _before long"))
    own = F.sum("_w").over(W.partitionBy("_range").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_own", own).join(bases, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_key", "_w", "_range", "_own", "_before")


def sorted_keys(rows: DataFrame, n: int) -> list[tuple]:
    """The ``_key`` of the ``n`` rows with the smallest hashes, in order."""
    return [tuple(r[0]) for r in rows.select("_key").orderBy(F.xxhash64("_key")).limit(n).orderBy("_key").collect()]


def sample_key(seed: int | str, *keys: str) -> list[Column]:
    """A seeded order that SQL engines share: the md5 of seed and key, then the key itself, for each key in turn."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    return [x for k in keys for x in (F.md5(F.concat_ws(":", F.lit(str(seed)), text(k))), text(k))]


def sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """N rows in a seeded order, the same for the same seed whatever the partitioning: n rows of each task meet, no more."""
    return df.orderBy(*sample_key(seed, key)).limit(max(1, n))


def grown_sample(old: DataFrame, more: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """The sample of ``n`` of all rows, from that of the rows before and the rows that came since.

    Samples of the smallest hashes merge. A full sample's largest hash is a
    threshold: rows above it are dropped where they are read, unordered, so a
    later run sorts only what can still come in.
    """
    order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sample_key(seed, *keys))))
    held = old.agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
    if held.n >= n:
        bound = F.struct(*(F.lit(x).alias(f"k{i}") for i, x in enumerate(held["last"])))
        more = more.where(order < bound)
    return old.unionByName(more).orderBy(*sample_key(seed, *keys)).limit(max(1, n))


def incremental_sample(rows: DataFrame, known: DataFrame, key: str, group: str, usable: Column, limit: int, seed: int) -> DataFrame:
    """Rows that are usable and not known yet, groups in a seeded order and rows in one within them, up to the cap (0: all)."""
    left = rows.where(usable).join(known.select(key).distinct(), key, "left_anti")
    ordered = left.orderBy(*sample_key(seed, group), *sample_key(seed, key))
    return ordered.limit(limit) if limit > 0 else ordered


def nearest(df: DataFrame, vector: str, query: list[float], k: int, tie: str) -> DataFrame:
    """The k nearest by L2 distance, ties by id: one pass, k rows a task (TakeOrderedAndProject)."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return df.withColumn("distance", l2_distance(F.col(vector), target)).orderBy("distance", tie).limit(k)


def page_window(df: DataFrame, keys: list[str], order: str, current: int, edge: int = 24, around: int = 12) -> DataFrame:
    """The first and last ``edge`` rows of a group and those near ``current``, with the number hidden."""
    up, down = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys).orderBy(F.desc(order))
    out = df.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down), "_n": F.count("*").over(W.partitionBy(*keys))})
    shown = (F.col("_a") <= edge) | (F.col("_b") <= edge) | (F.abs(F.col(order) - current) <= around)
    out = out.where(shown)
    return out.withColumn("hidden", F.col("_n") - F.count("*").over(W.partitionBy(*keys))).drop("_a", "_b", "_n")
