"""Cross-site boilerplate lines: distinct-site spread by mergeable sketches.

Each line's hash carries a HyperLogLog sketch of the sites it occurs on; the
sketches merge by aggregation, first inside each task.  A line whose estimate
lies clearly above ``min_sites`` is boilerplate, one clearly below is not, and
the near-threshold lines between get exact distinct counts.  Boilerplate stays
once, in the first document that holds it (smallest id, then place), and goes
everywhere else.

Defined results: null text has no lines and stays null; lines without a word are
never counted nor removed; lines compare by their text without surrounding
white space; a null site is a site of its own; identical rows are one document
(each keeps what the other keeps), and so are rows without a doc_id that have the same text, which come first; empty tables give empty results; other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import SPACE, fence, small, table


@dataclass(frozen=True)
class Spread:
    min_sites: int = 8
    #: log2 of the sketch's registers; the relative error is about 0.83 / sqrt(2 ** this).
    registers: int = 11
    #: Estimates within this share of min_sites are counted exactly: over five standard errors.
    near: float = 0.25
    site: str = "source"


def _lines(docs: DataFrame, site: Column) -> DataFrame:
    line = F.btrim(F.col("line"), F.lit(SPACE))
    return (
        docs.select("doc_id", site.alias("site"), F.xxhash64("text").alias("form"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        .where(line != "")
        .select("doc_id", "site", "form", "place", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))
    )


def boilerplate(docs: DataFrame, p: Spread = Spread()) -> DataFrame:
    """The lines of wide spread: their hashes ``h, g`` and the place ``first`` that keeps them."""
    site = F.coalesce(F.col(p.site).cast("string"), F.lit(""))
    lines = _lines(docs.where("text is not null"), site)
    seen = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", p.registers)).alias("sites"),
        F.min(F.struct("doc_id", "form", "place")).alias("first"),
    )
    low, high = p.min_sites * (1 - p.near), p.min_sites * (1 + p.near)
    seen = table(seen.where(F.col("sites") >= low), "spread")
    near = seen.where(F.col("sites") <= high)
    exact = (
        lines.join(small(near.select("h", "g"), near.count(), 40), ["h", "g"], "left_semi")
        .select("h", "g", "site")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= p.min_sites)
        .select("h", "g")
    )
    wide = seen.where(F.col("sites") > high)
    return table(wide.unionByName(near.join(exact, ["h", "g"], "left_semi")).select("h", "g", "first"), "wide")


def dedup(docs: DataFrame, p: Spread = Spread()) -> DataFrame:
    """``docs`` with ``deduped_text``, ``n_lines`` and ``n_removed`` (which replace such columns)."""
    wide = boilerplate(docs, p)
    wide = small(wide, wide.count(), 80)
    lines = _lines(docs.where("text is not null"), F.lit(""))
    gone = (
        lines.join(wide, ["h", "g"])
        .where(F.struct("doc_id", "form", "place") != F.col("first"))
        .groupBy("doc_id", "form")
        .agg(F.collect_set("place").alias("_gone"))
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("form"), F.col("text")
    )
    gone = gone.withColumnsRenamed({"doc_id": "_id", "form": "_form"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("form") == F.col("_form"))
    rows = rows.join(gone, same, "left").withColumn("_lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    added = {
        "deduped_text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left),
        "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }
    return rows.select(
        *(F.col("_row")[c].alias(c) for c in docs.columns if c not in added), *(fence(v).alias(c) for c, v in added.items())
    )


def clean(docs: DataFrame, p: Spread = Spread()) -> DataFrame:
    """Documents without repeated boilerplate; those of which no word is left go. Columns as before."""
    out = dedup(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", p.site), p)
    out = out.where((F.col("n_removed") == 0) | (F.btrim("deduped_text", F.lit(SPACE)) != ""))
    new = {"text": F.col("deduped_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("deduped_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
