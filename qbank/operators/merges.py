"""Upserts, replacements and record merges over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.functions.text import ACCENTED, text_key


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def upsert(old: DataFrame, new: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """``replace``, ``keep_if_null``, ``keep_if_blank`` or ``fill`` (the old one wins) for each column."""
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in policies), F.lit(True).alias("_old"))
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in policies), F.lit(True).alias("_new"))

    def value(c: str, policy: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if policy == "replace":
            return F.when(F.col("_new"), b).otherwise(a)
        if policy == "keep_if_null":
            return F.coalesce(b, a)
        if policy == "keep_if_blank":
            return F.coalesce(blank_to_null(b), a)
        if policy == "fill":
            return F.coalesce(a, b)
        raise ValueError(policy)

    return o.join(n, key, "full_outer").select(key, *(value(c, p).alias(c) for c, p in policies.items()))


def insert_ignore(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """U4: new keys only are added."""
    return old.unionByName(new.join(old, key, "left_anti"))


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows of the sources that come anew are replaced whole."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def delete_obsolete(rows: DataFrame, kept: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Of groups with kept numbers, the others go; groups without any are left alone."""
    groups = kept.select(*keys).distinct().withColumn("_has", F.lit(True))
    marked = rows.join(groups, keys, "left").join(kept.select(*keys, number).distinct().withColumn("_kept", F.lit(True)), [*keys, number], "left")
    return marked.where(F.col("_has").isNull() | F.col("_kept").isNotNull()).drop("_has", "_kept")


def cascade_delete(parents: DataFrame, gone: DataFrame, children: list[tuple[DataFrame, str]], key: str) -> list[DataFrame]:
    """U8: parents without the deleted ones, and each child table without theirs."""
    out = [parents.join(gone.select(key), key, "left_anti")]
    return out + [c.join(gone.select(F.col(key).alias(k)), k, "left_anti") for c, k in children]


def swapped(c: Column, mapping: dict[str, str]) -> Column:
    """Values exchanged in one pass, without a temporary value."""
    out = c
    for a, b in mapping.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def merge_maps(primary: Column, other: Column) -> Column:
    """Per key the primary's value unless it is blank."""
    return F.map_zip_with(primary, other, lambda k, a, b: F.coalesce(blank_to_null(a), b))


def numeric_elements(json: Column) -> Column:
    """The whole-number elements of a JSON array, as integers."""
    parts = F.from_json(json, "array<string>")
    return F.transform(F.filter(parts, lambda x: F.rlike(x, F.lit("^[0-9]+$"))), lambda x: x.cast("int"))


def best_display(values: DataFrame, value: str) -> DataFrame:
    """Of each key the best spelling: more accents, then longer, then fewer capitals, then the smaller string."""
    v = F.trim(F.col(value))
    accents = F.length(v) - F.length(F.translate(v, ACCENTED, ""))
    capitals = F.length(v) - F.length(F.regexp_replace(v, "[A-ZÁÉÍÓÚÜÑ]", ""))
    rows = values.where(v != "").select(v.alias("value"), text_key(v).alias("key"), (-accents).alias("a"), (-F.length(v)).alias("l"), capitals.alias("c"))
    return rows.groupBy("key").agg(F.min(F.struct("a", "l", "c", "value")).alias("r")).select("key", F.col("r.value").alias("value"))


def fold_records(df: DataFrame, identity: str, order: str, fill: list[str], errors: str, created: str) -> DataFrame:
    """Records of one identity as one: the first non-blank of each field in order, all errors sorted, earliest start.

    Aggregation only: ``min_by`` over the order replaces gathering a group.
    """
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col(order))).alias(c) for c in fill]
    return df.groupBy(identity).agg(
        *firsts,
        F.sort_array(F.collect_set(blank_to_null(F.col(errors)))).alias("errors"),
        F.min(created).alias("created_at"),
        F.count("*").alias("merged"),
    )


