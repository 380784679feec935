"""Join shapes: top-1 lookups, tiered identities, semi and anti joins, fuzzy matches.

Catalog sides are hinted for broadcast only where a bounded count shows that they
are small; otherwise Catalyst and AQE choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Catalogs up to this many rows are broadcast.
CATALOG_ROWS = 50_000


def catalog(df: DataFrame, rows_at_most: int = CATALOG_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more rows; the count ends one row beyond that."""
    return F.broadcast(df) if df.limit(rows_at_most + 1).count() <= rows_at_most else df


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (a lateral join's LIMIT 1 as a window)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup_id_else_code(left: DataFrame, right: DataFrame, id_key: tuple[str, str], code_key: tuple[str, str], value: str, order: str) -> DataFrame:
    """``value`` of the right row with the id, else of the first one with the code: two equi joins, not an OR."""
    by_id = right.select(F.col(id_key[1]).alias("_i"), F.col(value).alias("_vi"))
    by_code = top_one(right, [code_key[1]], [F.col(order)]).select(F.col(code_key[1]).alias("_c"), F.col(value).alias("_vc"))
    out = left.join(by_id, left[id_key[0]] == F.col("_i"), "left").join(by_code, left[code_key[0]] == F.col("_c"), "left")
    return out.withColumn(value, F.coalesce("_vi", "_vc")).drop("_i", "_vi", "_c", "_vc")


def existing(ids: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The ids that exist, and the missing rest."""
    return ids.join(table.select(key), key, "left_semi"), ids.join(table.select(key), key, "left_anti")


def resolve_identity(rows: DataFrame, known: DataFrame, book: str, instance: str, number: str, file: str, key: str) -> DataFrame:
    """book+instance+number without fallback where the instance is known; else book+number+file, number+file, number."""
    out = rows
    tiers = [("_t1", [book, instance, number]), ("_t2", [book, number, file]), ("_t3", [number, file]), ("_t4", [number])]
    for name, keys in tiers:
        hit = known.groupBy(*keys).agg(F.min(key).alias(name))
        out = out.join(hit, keys, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    chosen = (
        F.when(~blank(book) & ~blank(instance), F.col("_t1"))
        .when(~blank(book), F.coalesce("_t2", "_t3", "_t4"))
        .when(~blank(file), F.coalesce("_t3", "_t4"))
        .otherwise(F.col("_t4"))
    )
    return out.withColumn(key, chosen).drop(*(t for t, _ in tiers))


def sync_actions(source: DataFrame, target: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """What to do with each key of two tables: insert, update, skip, or extra in the target."""
    s = source.select(key, F.struct(*compared).alias("_s"), F.lit(True).alias("_in_s"))
    t = target.select(key, F.struct(*compared).alias("_t"), F.lit(True).alias("_in_t"))
    action = (
        F.when(F.col("_in_t").isNull(), "insert").when(F.col("_in_s").isNull(), "extra")
        .when(F.col("_s").eqNullSafe(F.col("_t")), "skip").otherwise("update")
    )
    return s.join(t, key, "full_outer").select(key, action.alias("action"))


def continuation_groups(df: DataFrame, keys: list[str], order: str, continues: Column) -> DataFrame:
    """Rows that continue the one before share its group (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("group_no", F.sum(F.when(continues, 0).otherwise(1)).over(w))
