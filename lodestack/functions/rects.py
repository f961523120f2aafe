"""Rectangles as columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def area(r: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(r[2] - r[0], zero) * F.greatest(r[3] - r[1], zero)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Share of a's area that lies in b; 0 for an empty a."""
    both = area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])
    return F.when(area(a) > 0, both / area(a)).otherwise(0.0)


def centre_in(a: list[Column], b: list[Column], pad: float = 0.0) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return x.between(b[0] - pad, b[2] + pad) & y.between(b[1] - pad, b[3] + pad)


def union(r: list[Column]) -> list[Column]:
    """Aggregates for the smallest rectangle around a group's."""
    return [F.min(r[0]).alias("x0"), F.min(r[1]).alias("y0"), F.max(r[2]).alias("x1"), F.max(r[3]).alias("y1")]


def page_number(text: Column, r: list[Column], width: Column, height: Column) -> Column:
    """Whether a text item is a page number: 1 to 3 digits, narrow, centred, at the top or bottom of a page with a size."""
    near_edge = (r[3] <= height * 0.08) | (r[1] >= height * 0.90)
    centred = F.abs((r[0] + r[2]) / 2 - width / 2) <= width * 0.08
    return F.trim(text).rlike(r"^\d{1,3}$") & (width > 0) & (height > 0) & near_edge & centred & (r[2] - r[0] <= width * 0.08)
