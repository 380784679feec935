"""Greedy matching and suppression of boxes, by a grid over each page and rounds of local maxima.

Boxes that overlap by a share ``least`` of their union are alike in size: neither
side of one is less than ``least`` of the other's. So each box is filed under
cells of its own size and of the next few coarser ones (at most four cells a
size), and only boxes of the same cell meet; a pair is taken from the cell that
holds its overlap's corner. A greedy choice by falling priority takes what is
first among all that it excludes; every round takes all such at once, and what
they exclude goes. The pairs left are written to the shared folder each round,
so a round's plan doesn't grow, and no page is gathered in one task. That is the way of crowded pages; on one
with up to ``CROWD`` boxes all meet, and its pairs are one short list, gone
through in order, so that a table of such pages is dealt out once, by page.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.functions import geometry
from qbank.tables import Written

BOX = ("x1", "y1", "x2", "y2")
#: Pages with more boxes than this, those of both sides together, go through the grid.
CROWD = 64
#: The least overlap of a matched pair.
LEAST = 0.25


def _filed(boxes: DataFrame, page: str, least: float) -> DataFrame:
    """Boxes with an area, once for each cell: ``page, level, cx, cy`` and ``own``, the level of their size."""
    deeper = math.ceil(math.log2(1 / least))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("double")
    rows = boxes.where("x2 > x1 and y2 > y1").withColumn("own", F.floor(F.log2(side)).cast("int") + 1)
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + deeper)))
    reach = lambda low, high: F.sequence(_cell(F.col(low)), _cell(F.col(high)))
    return rows.withColumn("cx", F.explode(reach("x1", "x2"))).withColumn("cy", F.explode(reach("y1", "y2")))


def _cell(c, level: str = "level"):  # noqa: ANN001, ANN202
    return F.floor(c / F.pow(F.lit(2.0), F.col(level)))


def overlaps(left: DataFrame, right: DataFrame, page: str, least: float, clamp: bool) -> DataFrame:
    """Pairs of boxes of a page whose intersection over union is ``least`` or more: ``page, a, b, score, shift``.

    ``left`` and ``right`` have the columns page, ``n`` (what ``a`` and ``b`` tell) and the box.
    """
    if not 0 < least <= 1:
        raise ValueError("the least overlap is a share above 0")
    a, b = (_filed(x.select(page, "n", *BOX), page, least).alias(k) for x, k in ((left, "a"), (right, "b")))
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (page, "level", "cx", "cy")])
    corner = [F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("x1", "y1")]
    once = (F.greatest("a.own", "b.own") == F.col("a.level")) & (_cell(corner[0], "a.level") == F.col("a.cx")) & (_cell(corner[1], "a.level") == F.col("a.cy"))
    return _scored(met.where(once), page, least, clamp)


def _scored(met: DataFrame, page: str, least: float, clamp: bool) -> DataFrame:
    box_a, box_b = ([F.col(f"{k}.{c}") for c in BOX] for k in "ab")
    told = F.col(f"a.{page}").alias(page), F.col("a.n").alias("a"), F.col("b.n").alias("b")
    score, shift = geometry.iou(box_a, box_b, clamp), geometry.largest_shift(box_a, box_b)
    return met.select(*told, score.alias("score"), shift.alias("shift")).where(F.col("score") >= least)


def _met(left: DataFrame, right: DataFrame, page: str, least: float, clamp: bool) -> DataFrame:
    """The same as ``overlaps``, with all boxes of a page met."""
    if not 0 < least <= 1:
        raise ValueError("the least overlap is a share above 0")
    a, b = (x.select(page, "n", *BOX).where("x2 > x1 and y2 > y1").alias(k) for x, k in ((left, "a"), (right, "b")))
    return _scored(a.join(b, F.col(f"a.{page}") == F.col(f"b.{page}")), page, least, clamp)


def _parted(page: str, *sides: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The sides' boxes of small pages, and those of crowded ones if there are any."""
    pages = sides[0].select(page)
    for x in sides[1:]:
        pages = pages.unionByName(x.select(page))
    crowded = Written(pages.groupBy(page).count().where(F.col("count") > CROWD).select(page), "crowded")
    if crowded.df.isEmpty():
        crowded.drop()
        return list(sides), None
    return [x.join(crowded.df, page, "left_anti") for x in sides], [x.join(crowded.df, page, "left_semi") for x in sides]


def match_boxes(left: DataFrame, right: DataFrame, page: str, least: float = LEAST) -> DataFrame:
    """One-to-one pairs of boxes ``(page, id, x1, y1, x2, y2)``, the best overlap first, later ids on ties."""
    return _matched(left, right, page, least).drop("shift")


def _matched(left: DataFrame, right: DataFrame, page: str, least: float) -> DataFrame:
    """The pairs with the largest shift of a coordinate."""
    named = lambda x: x.withColumn("n", F.col("id").cast("long"))
    small, crowded = _parted(page, named(left), named(right))
    pairs = _met(*small, page, least, clamp=False).groupBy(page).agg(F.sort_array(F.collect_list(F.struct("score", "a", "b", "shift")), asc=False).alias("pairs"))
    free = lambda taken, p: ~F.exists(taken, lambda x: (x["a"] == p["a"]) | (x["b"] == p["b"]))
    none = F.filter("pairs", lambda p: F.lit(False))
    best = F.aggregate("pairs", none, lambda taken, p: F.when(free(taken, p), F.array_append(taken, p)).otherwise(taken))
    out = pairs.select(page, F.inline(best)).select(page, F.col("a").alias("left_id"), F.col("b").alias("right_id"), "score", "shift")
    return out.unionByName(_crowded_matches(*crowded, page, least)) if crowded else out


def _crowded_matches(left: DataFrame, right: DataFrame, page: str, least: float) -> DataFrame:
    rest = Written(overlaps(left, right, page, least, clamp=False), "pairs")
    taken: list[DataFrame] = []
    while not rest.df.isEmpty():
        own = F.struct("score", "a", "b", "shift")
        best = lambda side: rest.df.groupBy(page, side).agg(F.max(own).alias("best"))  # noqa: B023, E731
        firsts = best("a").select(page, F.col("best.score").alias("score"), F.col("best.shift").alias("shift"), "a", F.col("best.b").alias("b")).join(best("b").select(page, F.col("best.a").alias("a"), "b"), [page, "a", "b"])
        now = Written(firsts, "matched")
        taken.append(now.df)
        gone_a, gone_b = now.df.select(page, "a"), now.df.select(page, "b")
        after = Written(rest.df.join(gone_a, [page, "a"], "left_anti").join(gone_b, [page, "b"], "left_anti"), "pairs")
        rest.drop()
        rest = after
    out = rest.df
    for t in taken:
        out = out.unionByName(t)
    return out.select(page, F.col("a").alias("left_id"), F.col("b").alias("right_id"), "score", "shift")


def suppress(boxes: DataFrame, page: str, overlap: float = 0.9) -> DataFrame:
    """By falling confidence, then y, x and id; a box that overlaps a kept one too much goes."""
    place = F.struct((-F.col("conf")).alias("k"), "y1", "x1", F.col("id").alias("i"))
    [small], crowded = _parted(page, boxes.withColumn("n", place))
    rivals = _met(small, small, page, overlap, clamp=True).where("a < b").groupBy(page).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("rivals"))
    none = F.transform(F.filter("rivals", lambda p: F.lit(False)), lambda p: p["b"])
    lost = F.aggregate("rivals", none, lambda lost, p: F.when(F.array_contains(lost, p["a"]), lost).otherwise(F.array_append(lost, p["b"])))  # what is first is settled before it is met
    kept = small.join(rivals.select(F.col(page), lost.alias("lost")), page, "left").where(~F.coalesce(F.array_contains("lost", F.col("n")), F.lit(False)))
    out = kept.select(*boxes.columns)
    return out.unionByName(_crowded_suppress(*crowded, page, overlap).select(*boxes.columns)) if crowded else out


def _crowded_suppress(boxes: DataFrame, page: str, overlap: float) -> DataFrame:
    """``n`` is a box's place in the order."""
    rest = Written(overlaps(boxes, boxes, page, overlap, clamp=True).where("a < b").select(page, F.col("a"), F.col("b")), "rivals")
    gone: list[DataFrame] = []
    while not rest.df.isEmpty():
        first = rest.df.select(page, "a").distinct().join(rest.df.select(page, F.col("b").alias("a")), [page, "a"], "left_anti")
        now = Written(rest.df.join(first, [page, "a"], "left_semi").select(page, "b").distinct(), "gone")
        gone.append(now.df)
        lost = now.df.withColumnRenamed("b", "a")
        after = Written(rest.df.join(lost, [page, "a"], "left_anti").join(now.df, [page, "b"], "left_anti"), "rivals")
        rest.drop()
        rest = after
    if not gone:
        return boxes
    all_gone = gone[0]
    for g in gone[1:]:
        all_gone = all_gone.unionByName(g)
    return boxes.withColumnRenamed("n", "b").join(all_gone, [page, "b"], "left_anti")


def box_changes(old: DataFrame, new: DataFrame, page: str, moved_by: int = 5) -> DataFrame:
    """What became of a page's boxes: added, removed, moved by more than some pixels, and whether the order changed.

    ``id`` is a box's place in its page. Pages with as many boxes as before and
    no match have all moved; equal lists in another order, or a match between
    different places, count as reordered.
    """
    told = _matched(old, new, page, LEAST).groupBy(page).agg(
        F.count("*").alias("matched"), F.count_if(F.col("shift") > moved_by).alias("moved"), F.count_if(F.col("left_id") != F.col("right_id")).alias("crossed")
    )
    listed = lambda x, name: x.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("id", F.struct(*BOX).alias("box")))).alias(name))
    both = listed(old, "o").join(listed(new, "n"), page, "full_outer").join(told, page, "left").fillna(0, ["matched", "moved", "crossed"])
    none = F.array().cast(both.schema["o"].dataType)
    boxes = lambda c: F.transform(F.coalesce(c, none.cast(both.schema[c].dataType)), lambda x: x["box"])
    both = both.withColumns({"o": boxes("o"), "n": boxes("n")})
    differ = (F.size("o") == F.size("n")) & (F.col("o") != F.col("n"))
    return both.select(
        page,
        (F.size("n") - F.col("matched")).alias("added"),
        (F.size("o") - F.col("matched")).alias("removed"),
        F.when(differ & (F.col("matched") == 0), F.size("n")).otherwise(F.col("moved")).cast("long").alias("moved"),
        (differ & ((F.sort_array("o") == F.sort_array("n")) | (F.col("crossed") > 0))).cast("long").alias("reordered"),
    )
