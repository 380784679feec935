"""Boxes on large and odd pages: the greedy choice against a plain double loop."""

import random

import pytest
from pyspark.sql import functions as F

from qbank.operators import matching

BOXES = "page string, id long, x1 int, y1 int, x2 int, y2 int, conf double"


def iou(a, b, least):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / max(union, least) if w * h else 0.0


def some_boxes(seed, n, reach):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.randint(-20, reach), r.randint(-20, reach), r.choice([0, 1, 5, 20, 60, 61]), r.choice([1, 7, 20, 60])
        out.append((f"p{i % 3}", i, x, y, x + w, y + h, r.choice([0.1, 0.5, 0.9])))
    return out


@pytest.mark.parametrize("crowd", [0, 30])
def test_crowded_and_small_pages(spark, monkeypatch, crowd):
    monkeypatch.setattr(matching, "CROWD", crowd)
    test_greedy_choice(spark, 0.25)


def test_small_pages_go_by_page_alone(spark):
    """One exchange by page, no cells."""
    boxes = spark.createDataFrame(some_boxes(1, 60, 90), BOXES)
    for made in (matching.match_boxes(boxes, boxes, "page"), matching.suppress(boxes, "page")):
        assert "cx" not in made._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("least", [0.1, 0.25, 0.9, 1.0])
def test_greedy_choice(spark, least):
    left, right = some_boxes(1, 60, 90), some_boxes(2, 60, 90)
    right[:6] = left[:6]
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    got = {(r.page, r.left_id, r.right_id) for r in matching.match_boxes(a, b, "page", least).collect()}
    want = set()
    for page in ("p0", "p1", "p2"):
        pairs = sorted(((iou(x[2:6], y[2:6], 1e-9), x[1], y[1]) for x in left for y in right if x[0] == y[0] == page), reverse=True)
        used_a, used_b = set(), set()
        for s, i, j in pairs:
            if s >= least and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                want.add((page, i, j))
    assert got == want
    kept = set()
    for page in ("p0", "p1", "p2"):
        chosen = []
        for x in sorted((x for x in left if x[0] == page), key=lambda x: (-x[6], x[3], x[2], x[1])):
            if all(iou(x[2:6], y[2:6], 1) < least for y in chosen):
                chosen.append(x)
        kept |= {x[1] for x in chosen}
    assert {r.id for r in matching.suppress(a, "page", least).collect()} == kept


def test_a_large_page(spark):
    """100,000 boxes on a page: only those of touching cells meet."""
    i = F.col("id")
    x, y = (i % 400) * 25, F.floor(i / 400) * 25
    boxes = spark.range(100_000).select(
        F.lit("p").alias("page"), "id", x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 24).cast("int").alias("x2"), (y + 24).cast("int").alias("y2"), (i % 10 / 10).alias("conf")
    )
    shifted = boxes.select("page", "id", *((F.col(c) + (1 if c[0] == "x" else 0)).alias(c) for c in matching.BOX))
    got = matching.match_boxes(boxes, shifted, "page")
    assert got.where("left_id = right_id").count() == got.count() == 100_000
    doubled = boxes.unionByName(boxes.withColumn("id", i + 100_000))
    assert matching.suppress(doubled, "page").where("id >= 100000").count() == 0


def test_odd_pages(spark):
    none = spark.createDataFrame([], BOXES)
    some = spark.createDataFrame([("p", 1, 0, 0, 0, 5, None), (None, 2, 0, 0, 5, 5, 0.5)], BOXES)
    assert matching.match_boxes(none, none, "page").count() == 0 and matching.suppress(none, "page").count() == 0
    assert matching.match_boxes(some, some, "page").count() == 0
    assert matching.suppress(some, "page").count() == 2
    changes = matching.box_changes(some.where("id = 1"), none, "page").collect()
    assert [(r.added, r.removed, r.moved, r.reordered) for r in changes] == [(0, 1, 0, 0)]
