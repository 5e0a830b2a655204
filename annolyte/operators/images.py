"""Kernels over pixels and masks, and the DataFrame operators that run them row by row within Arrow batches.

Images are rows of key, height, width, channels and pixels (bytes, row by row). Random draws come from a hash of the key, so
results don't depend on partitioning or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .kernels import distance_transform, ring_area

#: Corruptions: the side and spread of the blur, and the most that contrast and brightness keep. Fixed values.
BLUR_SIDE, BLUR_SIGMA, KEPT = 15, 30.0, 0.1
#: Weights of red, green and blue in grey: fixed values.
GREY = (0.299, 0.587, 0.114)


def draws(key, n: int = 1) -> np.ndarray:
    """n numbers in [0, 1) by a hash of the key."""
    seed = int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.PCG64(seed)).random(n)


def blurred(image: np.ndarray, side: int = BLUR_SIDE, sigma: float = BLUR_SIGMA) -> np.ndarray:
    """Gaussian blur; beyond the edge the image is mirrored without repeating the edge itself."""
    at = np.arange(side) - side // 2
    weight = np.exp(-(at**2) / (2 * sigma**2))
    weight /= weight.sum()
    out = image.astype(float)
    for axis in (0, 1):
        n, pad = out.shape[axis], side // 2
        place = np.abs((np.arange(-pad, n + pad) + (n - 1)) % max(1, 2 * (n - 1)) - (n - 1)) if n > 1 else np.zeros(2 * pad + 1, int)
        wide = out.take(place, axis)
        out = sum(w * wide.take(np.arange(i, i + n), axis) for i, w in enumerate(weight))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def flattened(image: np.ndarray, keep: float) -> np.ndarray:
    """Low contrast: distances to the darkest value shrink to a part."""
    low = float(image.min(initial=255))
    return ((image - low) * keep + low).astype(np.uint8)


def darkened(image: np.ndarray, keep: float) -> np.ndarray:
    return (image * keep).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: as it is if there is one, else the weighted sum of red, green and blue."""
    return image[..., 0] if image.shape[2] == 1 else np.clip(np.rint(image[..., :3] @ np.array(GREY)), 0, 255).astype(np.uint8)


def merged_grey(images: Sequence[np.ndarray], channels: int = 3) -> np.ndarray:
    """Grey images as channels of one, in order; missing ones are black."""
    out = np.zeros((*images[0].shape[:2], channels), np.uint8)
    for i, image in enumerate(images[:channels]):
        out[..., i] = grey(image)
    return out


CORRUPTIONS = {"blur": lambda x, u: blurred(x), "low_contrast": lambda x, u: flattened(x, u * KEPT), "darken": lambda x, u: darkened(x, u * KEPT)}


def corrupted(images: DataFrame, key: str = "image_id", kind: str = "kind") -> DataFrame:
    """images (key, kind, height, width, channels, pixels) with their pixels changed as kind says; other kinds and null pixels stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                k, how, h, w, c, raw = (col[0].as_py() for col in row.columns)
                if raw is not None and how in CORRUPTIONS and len(raw):
                    image = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                    raw = CORRUPTIONS[how](image, float(draws((k, how))[0])).tobytes()
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([raw], pa.binary())], schema=batch.schema)

    ship(images.sparkSession)
    rows = images.select(key, kind, F.col("height").cast("int"), F.col("width").cast("int"), F.col("channels").cast("int"), "pixels")
    return rows.mapInArrow(run, rows.schema)


def points_in_mask(mask: np.ndarray, n: int, key=0) -> np.ndarray:
    """n pixels of the mask, drawn evenly with repetition: x, y, 1."""
    y, x = np.nonzero(mask)
    if not len(x):
        raise ValueError("an empty mask has no points")
    at = (draws(("mask", key), n) * len(x)).astype(int)
    return np.c_[x[at], y[at], np.ones(n, int)]


def points_of_centre(mask: np.ndarray, n: int) -> np.ndarray:
    """n pixels, each farthest from the edge, from the image's border and from those before: x, y, 1."""
    free = np.pad(np.asarray(mask, bool), 1)
    out = []
    for _ in range(n):
        if not free.any():
            raise ValueError("the mask has too few points")
        far = np.where(free, distance_transform(free), -1.0)
        y, x = np.unravel_index(int(far.argmax()), far.shape)
        free[y, x] = False
        out.append((x - 1, y - 1, 1))
    return np.array(out, int).reshape(-1, 3)


def points_in_box(mask: np.ndarray, box: Sequence[float], n: int, key=0) -> np.ndarray:
    """n whole points of the box, drawn evenly: x, y, and whether the mask has them."""
    x0, y0, x1, y1 = (int(v) for v in np.ceil(box))
    u = draws(("box", key), 2 * n).reshape(2, n)
    x, y = x0 + (u[0] * (x1 - x0)).astype(int), y0 + (u[1] * (y1 - y0)).astype(int)
    return np.c_[x, y, np.asarray(mask)[y, x].astype(int)]


def hull(points) -> np.ndarray:
    """The convex hull, counter-clockwise from the leftmost point."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points) -> np.ndarray:
    """Corners of the rectangle of least area around the points: one side lies along a side of their hull."""
    ring = hull(points)
    best = None
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        length = float(np.hypot(*(b - a)))
        u = (b - a) / length if length else np.array([1.0, 0.0])
        axes = np.array([u, [-u[1], u[0]]])
        flat = ring @ axes.T
        low, high = flat.min(0), flat.max(0)
        size = float((high - low).prod())
        if best is None or size < best[0] - 1e-9:
            best = size, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
    return best[1]


def fitted_circle(points) -> tuple[float, float, float] | None:
    """Centre and radius by least squares; None for points on a line."""
    p = np.asarray(points, float).reshape(-1, 2)
    if len(p) < 3:
        return None
    mid = p.mean(0)
    q = p - mid
    system = np.c_[2 * q, np.ones(len(q))]
    if np.linalg.matrix_rank(system) < 3:
        return None
    x, y, c = np.linalg.lstsq(system, (q**2).sum(1), rcond=None)[0]
    return float(x + mid[0]), float(y + mid[1]), float(np.sqrt(c + x * x + y * y))


def simplified(ring, tolerance: float) -> np.ndarray:
    """A closed ring without points nearer than the tolerance to the line between those kept."""
    p = np.asarray(ring, float).reshape(-1, 2)
    if len(p) < 4:
        return p
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    closed = np.r_[p, p[:1]]
    keep = {0, far}
    todo = [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rest = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        length = float(np.hypot(*line))
        away = np.abs(rest[:, 0] * line[1] - rest[:, 1] * line[0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[sorted(keep)]


def shape_of(ring, kind: str, offset: Sequence[float] = (0, 0), tolerance: float = 2.0) -> tuple[str, np.ndarray]:
    """The contour as a circle (ends of a level diameter), a rectangle or, by default, a simplified polygon.

    A circle or rectangle is made if kind is part of that word, as the described behaviour has it.
    """
    off = np.asarray(offset, float)
    if kind in "circle":
        found = fitted_circle(ring)
        if found:
            x, y, r = found
            return "circle", np.array([[x - r, y], [x + r, y]]) + off
    elif kind in "rectangle":
        return "rectangle", least_rectangle(ring) + off
    return "polygon", simplified(ring, tolerance) + off


def corners_of(cx: float, cy: float, w: float, h: float, degrees: float) -> np.ndarray:
    """Corners of a turned box, counter-clockwise."""
    t = np.deg2rad(degrees)
    turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    return np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2 @ turn + [cx, cy]


def rotated_iou(a: Sequence[float], b: Sequence[float]) -> float:
    """IoU of two turned boxes (centre, width, height, degrees), by cutting one with the sides of the other."""
    p, window = corners_of(*a), corners_of(*b)
    for s, e in zip(window, np.roll(window, -1, 0), strict=True):
        if not len(p):
            break
        side = (e[0] - s[0]) * (p[:, 1] - s[1]) - (e[1] - s[1]) * (p[:, 0] - s[0])
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append(p[i])
            if side[i] * side[j] < 0:
                out.append(p[i] + (p[j] - p[i]) * side[i] / (side[i] - side[j]))
        p = np.array(out).reshape(-1, 2)
    inter = ring_area(p) if len(p) > 2 else 0.0
    union = abs(a[2] * a[3]) + abs(b[2] * b[3]) - inter
    return inter / union if union > 0 else 0.0
