"""Shapes of all kinds as point arrays, their regions and crops, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import box as B
from .poly import bounds, point


def circle(cx: Column, cy: Column, r: Column) -> Column:
    """Two points, left and right of the centre."""
    return F.array(point(cx - r, cy), point(cx + r, cy))


def ellipse(left: Column, right: Column, upper: Column, lower: Column) -> Column:
    return F.array(left, right, upper, lower)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def radius(points: Column) -> Column:
    """Of a circle: half of what lies between its two points."""
    a, b = points[0], points[1]
    return F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))) / 2


def shape_area(kind: Column, points: Column) -> Column:
    """By kind: circles and ellipses from their axes, others by the shoelace."""
    from .poly import area

    span = lambda i, j: F.sqrt(F.pow(points[i]["x"] - points[j]["x"], F.lit(2)) + F.pow(points[i]["y"] - points[j]["y"], F.lit(2)))
    return (
        F.when(kind == "circle", math.pi * radius(points) * radius(points))
        .when((kind == "ellipse") & (F.size(points) >= 4), math.pi * span(0, 1) * span(2, 3) / 4)
        .when(kind.isin("polygon", "rectangle"), area(points))
        .otherwise(0.0)
    )


def region(kind: Column, points: Column) -> Column:
    """The box around a shape; a circle's from its radius. Null without points."""
    b = bounds(points)
    cx, cy = (points[0]["x"] + points[1]["x"]) / 2, (points[0]["y"] + points[1]["y"]) / 2
    r = radius(points)
    return F.when(F.size(points) < 1, None).when((kind == "circle") & (F.size(points) > 1), B.box(cx - r, cy - r, cx + r, cy + r)).otherwise(B.box(b["x0"], b["y0"], b["x1"], b["y1"]))


def whole_region(b: Column) -> Column:
    """A polygon's region in whole pixels: half a pixel is added twice, then it's cut off."""
    cut = lambda v: (v + 0.5 + 0.5).cast("long")
    return F.struct(*[cut(b[n]).alias(n) for n in ("x0", "y0", "x1", "y1")])


def crop(b: Column, width, height, margin: int = 10) -> Column:
    """The part of an image shown with an issue: the box and a margin, within the image."""
    low = lambda v: F.greatest(v.cast("long") - margin, F.lit(0))
    high = lambda v, top: F.least(v.cast("long") + margin, F.lit(top))
    return F.struct(low(b["x0"]).alias("x0"), low(b["y0"]).alias("y0"), high(b["x1"], width).alias("x1"), high(b["y1"], height).alias("y1"))


def noisy(b: Column, u: tuple[Column, Column, Column, Column], share: float, least: float, width, height) -> Column:
    """A box whose corners move by up to a share of its size (u in [0, 1)); the old box if too little is left."""
    w, h = (b["x1"] - b["x0"]) * share, (b["y1"] - b["y0"]) * share
    moved = B.clip(B.box(b["x0"] + (2 * u[0] - 1) * w, b["y0"] + (2 * u[1] - 1) * h, b["x1"] + (2 * u[2] - 1) * w, b["y1"] + (2 * u[3] - 1) * h), width, height)
    return F.when(B.nonempty(moved) & (B.area(moved) >= least), moved).otherwise(b)


def rescaled(b: Column, factor: float, width, height) -> Column:
    """About its centre, within the image."""
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    w, h = (b["x1"] - b["x0"]) * factor / 2, (b["y1"] - b["y0"]) * factor / 2
    return B.clip(B.box(cx - w, cy - h, cx + w, cy + h), width, height)


def flipped(b: Column, width) -> Column:
    return B.box(width - b["x1"], b["y0"], width - b["x0"], b["y1"])


def cropped_to(b: Column, x: int, y: int, w: int, h: int) -> Column:
    """The box as seen in a crop of the image."""
    return B.clip(B.box(b["x0"] - x, b["y0"] - y, b["x1"] - x, b["y1"] - y), w, h)
