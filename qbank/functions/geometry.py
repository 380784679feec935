"""Box functions; a box is four integer columns x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def iou(a: Box, b: Box, clamp: bool = False) -> Column:
    """Intersection over union; an empty union is 1 (``clamp``) or gives 0."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    union = area(a) + area(b) - w * h
    if clamp:
        return (w * h) / F.greatest(union, F.lit(1))
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


def largest_shift(a: Box, b: Box) -> Column:
    """The largest change of a coordinate."""
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def clamped(b: Box, width: Column, height: Column, least: int = 1) -> list[Column]:
    """Inside the page and at least ``least`` wide and high."""
    x1 = F.greatest(F.least(b[0], width - least), F.lit(0))
    y1 = F.greatest(F.least(b[1], height - least), F.lit(0))
    return [x1, y1, F.least(F.greatest(b[2], x1 + least), width), F.least(F.greatest(b[3], y1 + least), height)]


def yolo_line(b: Box, width: Column, height: Column, digits: int = 6) -> Column:
    """S34, SNK6: ``0 cx cy w h`` in shares of the page."""
    f = f"%.{digits}f"
    return F.format_string(
        f"0 {f} {f} {f} {f}", (b[0] + b[2]) / 2 / width, (b[1] + b[3]) / 2 / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height
    )


def reading_key(b: Box) -> Column:
    """Boxes in reading order: y, x, lower edge, right edge."""
    return F.struct(b[1].alias("y1"), b[0].alias("x1"), b[3].alias("y2"), b[2].alias("x2"))
