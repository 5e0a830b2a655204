"""Polygons as Column expressions: array<struct<x double, y double>>."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<x double, y double>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def of_box(b: Column) -> Column:
    """Corners, clockwise on a screen."""
    return F.array(point(b["x0"], b["y0"]), point(b["x1"], b["y0"]), point(b["x1"], b["y1"]), point(b["x0"], b["y1"]))


def next_points(p: Column) -> Column:
    """Each vertex's successor, the first after the last."""
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def area(p: Column) -> Column:
    """Shoelace."""
    parts = F.zip_with(p, next_points(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def bounds(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(p: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda f: F.aggregate(F.transform(p, lambda q: q[f]), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(p), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def translated(p: Column, dx, dy) -> Column:
    return F.transform(p, lambda q: point(q["x"] + dx, q["y"] + dy))


def transposed(p: Column) -> Column:
    return F.transform(p, lambda q: point(q["y"], q["x"]))


def scaled(p: Column, s) -> Column:
    return F.transform(p, lambda q: point(q["x"] * s, q["y"] * s))


def turned(p: Column, radians: Column, about: Column) -> Column:
    c, s = F.cos(radians), F.sin(radians)
    return F.transform(p, lambda q: point(about["x"] + (q["x"] - about["x"]) * c - (q["y"] - about["y"]) * s, about["y"] + (q["x"] - about["x"]) * s + (q["y"] - about["y"]) * c))


def stretched(p: Column, factor, about: Column) -> Column:
    return F.transform(p, lambda q: point(about["x"] + (q["x"] - about["x"]) * factor, about["y"] + (q["y"] - about["y"]) * factor))


def clipped(p: Column, width, height) -> Column:
    lim = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return F.transform(p, lambda q: point(lim(q["x"], width), lim(q["y"], height)))


def covers(p: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossed = F.zip_with(
        p,
        next_points(p),
        lambda a, b: F.when((a["y"] > y) != (b["y"] > y), F.when(x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"], 1).otherwise(0)).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def inside_box(p: Column, b: Column) -> Column:
    return F.forall(p, lambda q: (q["x"] >= b["x0"]) & (q["x"] <= b["x1"]) & (q["y"] >= b["y0"]) & (q["y"] <= b["y1"]))


def _to_segment(q: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    d2 = dx * dx + dy * dy
    t = F.coalesce(F.least(F.greatest(((q["x"] - a["x"]) * dx + (q["y"] - a["y"]) * dy) / F.nullif(d2, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    ex, ey = q["x"] - (a["x"] + t * dx), q["y"] - (a["y"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _one_way(p: Column, q: Column) -> Column:
    return F.array_max(F.transform(p, lambda v: F.array_min(F.zip_with(q, next_points(q), lambda a, b: _to_segment(v, a, b)))))


def hausdorff(p: Column, q: Column) -> Column:
    """Between outlines, over the vertices of both."""
    return F.greatest(_one_way(p, q), _one_way(q, p))


def hausdorff_boxes(a: Column, b: Column) -> Column:
    """`hausdorff` of the outlines of two boxes whose corners are in order, in closed form: no arrays are made, and the code is short enough to be compiled.

    A corner's signed distance to a box is known by axes, and either axis can be chosen freely among a box's corners: the furthest corner
    outside takes the greatest distance of each axis, the furthest inside the least. Null if a corner of a box is missing.
    """

    def one_way(p: Column, q: Column) -> list[Column]:
        far = [F.greatest(q[f"{k}0"] - p[f"{k}0"], p[f"{k}1"] - q[f"{k}1"], F.lit(0)) for k in "xy"]
        near = [F.least(*[F.greatest(q[f"{k}0"] - p[f"{k}{i}"], p[f"{k}{i}"] - q[f"{k}1"]) for i in (0, 1)]) for k in "xy"]
        return [F.hypot(*far), -F.greatest(*near).cast("double")]

    known = functools.reduce(lambda x, y: x & y, [p[f"{k}{i}"].isNotNull() for p in (a, b) for k in "xy" for i in (0, 1)])
    return F.when(known, F.greatest(*one_way(a, b), *one_way(b, a)))


def ring(cx: Column, cy: Column, rx: Column, ry: Column, n: int = 36) -> Column:
    """A closed ring of n + 1 points around an ellipse."""
    import math

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(cx + rx * F.cos(i * (2 * math.pi / n)), cy + ry * F.sin(i * (2 * math.pi / n))))


def pairs(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] as points; an odd last number is left out."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.element_at(flat, 2 * i + 1), F.element_at(flat, 2 * i + 2)))).otherwise(F.array().cast("array<struct<x: double, y: double>>"))


def largest(parts: Column) -> Column:
    """The part of most area of an array of polygons; the first of equals."""
    areas = F.transform(parts, area)
    return F.element_at(parts, F.array_position(areas, F.array_max(areas)).cast("int"))
