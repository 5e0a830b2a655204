"""Box algebra as Column expressions. A box is a struct x0, y0, x1, y1 (corners)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    cols = [c if isinstance(c, Column) else F.col(c) for c in (x0, y0, x1, y1)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"), strict=True)])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def _overlap(a: Column, b: Column, low: str, high: str) -> Column:
    return F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return _overlap(a, b, "x0", "x1") * _overlap(a, b, "y0", "y1")


def union(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """0 where the union is empty."""
    return F.coalesce(intersection(a, b) / F.nullif(union(a, b), F.lit(0.0)), F.lit(0.0))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of a."""
    return F.coalesce(intersection(a, b) / F.nullif(area(a), F.lit(0.0)), F.lit(0.0))


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def giou(a: Column, b: Column) -> Column:
    outer = area(hull(a, b))
    return iou(a, b) - F.coalesce((outer - union(a, b)) / F.nullif(outer, F.lit(0.0)), F.lit(0.0))


def to_xywh(b: Column) -> Column:
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def from_xywh(b: Column) -> Column:
    return box(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])


def to_cxcywh(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def from_cxcywh(b: Column) -> Column:
    return box(b["cx"] - b["w"] / 2, b["cy"] - b["h"] / 2, b["cx"] + b["w"] / 2, b["cy"] + b["h"] / 2)


def clip(b: Column, width, height) -> Column:
    lim = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)) if not isinstance(top, Column) else top)
    return box(lim(b["x0"], width), lim(b["y0"], height), lim(b["x1"], width), lim(b["y1"], height))


def scaled(b: Column, sx: float, sy: float) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def normalised(b: Column, width, height) -> Column:
    return box(b["x0"] / width, b["y0"] / height, b["x1"] / width, b["y1"] / height)


def nonempty(b: Column, least: float = 0.0) -> Column:
    return (b["x1"] - b["x0"] > least) & (b["y1"] - b["y0"] > least)


def contains(outer: Column, inner: Column) -> Column:
    return (inner["x0"] >= outer["x0"]) & (inner["y0"] >= outer["y0"]) & (inner["x1"] <= outer["x1"]) & (inner["y1"] <= outer["y1"])


def intersects(a: Column, b: Column) -> Column:
    return ~((b["x0"] >= a["x1"]) | (b["x1"] <= a["x0"]) | (b["y0"] >= a["y1"]) | (b["y1"] <= a["y0"]))


def near_edge(b: Column, margin: float = 0.025) -> Column:
    """Centre of a normalised box within the margin of any side."""
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    return (cx < margin) | (cx > 1 - margin) | (cy < margin) | (cy > 1 - margin)


def rotated_hull(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The upright box around a rotated one."""
    t = F.radians(degrees)
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    hw, hh = (w * c + h * s) / 2, (w * s + h * c) / 2
    return box(cx - hw, cy - hh, cx + hw, cy + hh)


def angle_normalised(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def is_zero(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Only if all four are at most 0 (Q40)."""
    return (x <= 0) & (y <= 0) & (w <= 0) & (h <= 0)


def bond_roi(x0: Column, y0: Column, x1: Column, y1: Column, width, height, extend: float = 60.0, tolerance: float = 5.0, scale: float = 1.0, shift: int = 20) -> Column:
    """The region of a bond: extended along its direction, clamped, widened, scaled, truncated, shifted, clamped again."""
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    ux = F.coalesce((x1 - x0) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    uy = F.coalesce((y1 - y0) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    lim = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    ax, ay = lim(x0 - ux * extend, width), lim(y0 - uy * extend, height)
    bx, by = lim(x1 + ux * extend, width), lim(y1 + uy * extend, height)
    cut = lambda v: (v * scale).cast("bigint").cast("double")
    left, top = cut(F.least(ax, bx) - tolerance) - shift, cut(F.least(ay, by) - tolerance) - shift
    right, low = cut(F.greatest(ax, bx) + tolerance) + shift, cut(F.greatest(ay, by) + tolerance) + shift
    return box(lim(left, width * scale), lim(top, height * scale), lim(right, width * scale), lim(low, height * scale))


def grid_tiles(width: Column, height: Column, target: float, overlap: float = 0.1) -> Column:
    """How many tiles of target size, overlapping, cover a frame."""
    step = target * (1 - overlap)
    n = lambda v: F.greatest(F.ceil(v / step), F.lit(1)).cast("bigint")
    return n(width) * n(height)


def letterbox(width: Column, height: Column, size: int = 1008) -> Column:
    """Scaled size and offsets that centre an image in a square."""
    s = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = (width * s).cast("bigint"), (height * s).cast("bigint")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((size - w) / 2).alias("dx"), F.floor((size - h) / 2).alias("dy"))


def scale_factor(width: Column, target: float) -> Column:
    """target / width within [0.5, 2]; 1 for a width that is not positive."""
    return F.when(width > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.lit(float(target)) / width))).otherwise(1.0)


def to_points(b: Column, x: Column, y: Column) -> Column:
    """Distances from a point to the left, top, right and bottom side; negative ones lie outside."""
    return F.struct((x - b["x0"]).alias("left"), (y - b["y0"]).alias("top"), (b["x1"] - x).alias("right"), (b["y1"] - y).alias("bottom"))


def centre_similarity(a: Column, b: Column, zero: float = 2.0) -> Column:
    """1 for equal centres, falling to 0 at the distance `zero`."""
    mid = lambda box, low, high: (box[low] + box[high]) / 2
    far = F.hypot(mid(a, "x0", "x1") - mid(b, "x0", "x1"), mid(a, "y0", "y1") - mid(b, "y0", "y1"))
    return F.greatest(1 - far / zero, F.lit(0.0))
