"""Names resolved to catalogue rows, equal keys first, then the nearest by trigrams, through an index of prefixes.

Two trigram sets that share ``least`` of their union share a trigram among the
first ``n - ceil(least * n) + 1`` of each in any common order. Ordered by rarity,
those are each name's rarest trigrams, and only they are joined, together with
the size class that the threshold allows, so common trigrams bring no pairs. A
trigram that is still in many prefixes is dealt out by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.functions.similarity import trigram_similarity, trigrams

#: Names of one side that meet one trigram in a task, about.
SHARE = 4096


def _prefixes(names: DataFrame, seen: DataFrame, groups: list[str], least: float) -> DataFrame:
    """``*groups, id, g, n``: the rarest trigrams of each name, enough of them for the threshold, and the set's size."""
    each = names.select(*groups, "id", F.size("t").alias("n"), F.explode("t").alias("g")).join(seen, "g")
    kept = each.groupBy(*groups, "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("by_rarity"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1
    return kept.select(*groups, "id", "n", F.explode(F.slice("by_rarity", F.lit(1), length)).alias("p")).select(*groups, "id", "n", "p.g")


def similar_names(left: DataFrame, right: DataFrame, least: float, within: list[str] | None = None) -> DataFrame:
    """Pairs of different names ``(*within, l, r, score)`` of two tables ``(*within, name)`` with a trigram similarity of ``least`` or more."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity is a share above 0")
    groups = list(within or ())
    sides = [x.select(*groups, F.col("name").alias("id"), trigrams(F.col("name")).alias("t")).distinct().where(F.size("t") > 0) for x in (left, right)]
    seen = sides[0].unionByName(sides[1]).select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    a, b = (_prefixes(x, seen, groups, least) for x in sides)
    # Sizes within a factor of the threshold: classes of that ratio, each left name looks into its own and the two beside it.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-9, -_ln(least)))) if least < 1 else F.col("n").cast("long")
    a = a.withColumn("c", F.explode(F.array(size_class - 1, size_class, size_class + 1) if least < 1 else F.array(size_class)))
    b = b.withColumn("c", size_class)
    keys = [*groups, "g", "c"]
    parts = a.groupBy(*keys).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts")).where("parts > 1")
    a = a.join(parts, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    b = b.join(parts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = a.withColumnsRenamed({"id": "l", "n": "nl"}).join(b.withColumnsRenamed({"id": "r", "n": "nr"}), [*keys, "salt"])
    fits = (F.least("nl", "nr") >= F.greatest("nl", "nr") * F.lit(least) - 1e-9)
    pairs = met.where(fits).select(*groups, "l", "r").distinct()
    score = trigram_similarity(trigrams(F.col("l")), trigrams(F.col("r")))
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def _ln(x: float) -> float:
    import math

    return math.log(x)


def resolve(
    left: DataFrame, right: DataFrame, key: str, name: str, area: str | None = None, within: str | None = None, least: float = 0.8, least_area: float = 0.5
) -> DataFrame:
    """``left_key, right_key, score, how`` of each left row that names a right one.

    ``exact``: the same name, area and group; the least key of equals. Otherwise
    ``similar``: the most similar name of the group, the most similar area among
    equals, then the least key, taken if the name is ``least`` and the area
    ``least_area`` similar (a blank left area is not compared). Names are keys
    already; a null or blank name resolves to nothing.
    """
    groups = ["w"] if within else []
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("")
    named = lambda x: x.select(F.col(key).alias("key"), text(name).alias("name"), text(area).alias("area"), *([F.col(within).alias("w")] if within else []))
    a, b = named(left).where("name <> ''"), named(right).where("name <> ''")
    catalogue = b.groupBy(*groups, "name", "area").agg(F.min("key").alias("right_key"))
    same = a.join(catalogue, [*groups, "name", "area"], "left")
    exact = same.where("right_key is not null").select(F.col("key").alias("left_key"), "right_key", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    open_ = same.where("right_key is null").drop("right_key")
    asked = open_.select(*groups, "name", "area").distinct()
    near = similar_names(asked.select(*groups, "name"), catalogue.select(*groups, "name"), least, groups)
    # The best names of each name, then all of their areas.
    top = near.groupBy(*groups, F.col("l").alias("name")).agg(F.max("score").alias("score"))
    top = near.withColumnRenamed("l", "name").join(top, [*groups, "name", "score"])
    areas = asked.join(top, [*groups, "name"]).join(catalogue.withColumnsRenamed({"name": "r", "area": "other"}), [*groups, "r"])
    alike = trigram_similarity(trigrams(F.col("area")), trigrams(F.col("other")))
    best = areas.groupBy(*groups, "name", "area").agg(F.max_by(F.struct("score", alike.alias("alike"), "right_key"), F.struct(alike, -F.col("right_key"))).alias("best"))
    taken = best.where((F.col("area") == "") | (F.col("best.alike") >= least_area))
    similar = open_.join(taken, [*groups, "name", "area"]).select(F.col("key").alias("left_key"), "best.right_key", "best.score", F.lit("similar").alias("how"))
    return exact.unionByName(similar)


def nearest_area(areas: DataFrame, known: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """The search's step: each asked area to the most similar known one, ``least`` or more: ``name, area, score``."""
    a, b = (x.select(F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name")).where("name <> ''").distinct() for x in (areas, known))
    same = a.join(b, "name", "left_semi").select("name", F.col("name").alias("area"), F.lit(1.0).alias("score"))
    near = similar_names(a.join(b, "name", "left_anti"), b, least)
    order: Column = F.struct("score", F.col("r"))
    best = near.groupBy(F.col("l").alias("name")).agg(F.max(order).alias("best")).select("name", F.col("best.r").alias("area"), "best.score")
    return same.unionByName(best)
