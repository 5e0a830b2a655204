"""Masks as numpy arrays: filling, outlines, centre lines and the features measured along them."""

from __future__ import annotations

import numpy as np

from .kernels import box_ious, distance_transform, rle_encode

#: How close two ends of a stroke count as one, in pixels.
NEAR = 10


def filled(points, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies in a polygon, by the even-odd rule, and those on its outline."""
    p = np.asarray(points, float).reshape(-1, 2)
    mask = np.zeros((height, width), bool)
    if len(p) < 1:
        return mask
    a, b = p, np.roll(p, -1, axis=0)
    for y in range(max(0, int(np.floor(p[:, 1].min()))), min(height, int(np.ceil(p[:, 1].max())) + 1)):
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
        for l, r in zip(xs[0::2], xs[1::2], strict=True):
            mask[y, max(0, int(np.ceil(l))) : max(0, min(width, int(np.floor(r)) + 1))] = True
    for (x0, y0), (x1, y1) in zip(a, b, strict=True):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
        ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[ok], xs[ok]] = True
    return mask


def thick_line(points, thickness, limit: float = 10.0) -> np.ndarray:
    """The outline of a polyline of varying width: there on one side, back on the other, with mitred corners of bounded length."""
    p, t = np.asarray(points, float), np.asarray(thickness, float)
    d = np.diff(p, axis=0)
    n = np.linalg.norm(d, axis=1, keepdims=True)
    d = np.divide(d, n, out=np.zeros_like(d), where=n > 0)
    normal = np.stack((-d[:, 1], d[:, 0]), 1)
    before, after = np.vstack((normal[:1], normal)), np.vstack((normal, normal[-1:]))
    mid = before + after
    size = np.linalg.norm(mid, axis=1, keepdims=True)
    mid = np.where(size > 1e-9, mid / np.maximum(size, 1e-9), before)
    reach = np.minimum(1 / np.maximum((mid * before).sum(1), 1e-9), limit)
    off = mid * (t / 2 * reach)[:, None]
    return np.vstack((p + off, (p - off)[::-1]))


def _ring(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from the one above."""
    m = np.pad(mask.astype(np.uint8), 1)
    h, w = mask.shape
    return [m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def centre_line(mask: np.ndarray) -> np.ndarray:
    """Thinning to lines of one pixel: in turns from two sides, border pixels whose loss breaks nothing go."""
    m = np.asarray(mask, bool).copy()
    while True:
        gone = 0
        for side in (0, 1):
            n = _ring(m)
            count = sum(x.astype(int) for x in n)
            turns = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            a, b = ((n[0] & n[2] & n[4]), (n[2] & n[4] & n[6])) if side == 0 else ((n[0] & n[2] & n[6]), (n[0] & n[4] & n[6]))
            drop = m & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)
            m &= ~drop
            gone += int(drop.sum())
        if not gone:
            return m


def line_ends(line: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """x, y of pixels with one neighbour; of ends near each other the first stays."""
    count = sum(x.astype(int) for x in _ring(line))
    ends = [(int(x), int(y)) for y, x in np.argwhere(np.asarray(line, bool) & (count == 1))]
    kept: list[tuple[int, int]] = []
    for x, y in ends:
        if not any(abs(x - a) <= near and abs(y - b) <= near for a, b in kept):
            kept.append((x, y))
    return kept


def stroke(polygons, height: int, width: int) -> tuple[float | None, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Median stroke width (twice the distance to the edge along the centre line), its ends, and the polygons' boxes. Nothing filled: no width (Q31)."""
    mask = np.zeros((height, width), bool)
    boxes = []
    for p in polygons:
        q = np.asarray(p, float).reshape(-1, 2).astype(int)
        mask |= filled(q, height, width)
        boxes.append((int(q[:, 0].min()), int(q[:, 1].min()), int(q[:, 0].max()) + 1, int(q[:, 1].max()) + 1))
    if not mask.any():
        return None, [], boxes
    line = centre_line(mask)
    return float(np.median(distance_transform(mask)[line] * 2)), line_ends(line), boxes


def features(hsv: np.ndarray, points) -> dict[str, float | None]:
    """Eight features of a shape in an HSV image; the width is the mean distance along the centre line, not doubled. No points: all null (Q30)."""
    names = ("stroke_width", "stroke_length", "average_hue", "hue_sd", "average_saturation", "saturation_sd", "average_value", "value_sd")
    if points is None or not len(points):
        return dict.fromkeys(names)
    mask = filled(np.asarray(points, float).astype(int), *hsv.shape[:2])
    line = centre_line(mask)
    widths = distance_transform(mask)[line]
    out: dict[str, float | None] = {"stroke_width": float(widths.mean()) if len(widths) else None, "stroke_length": float(line.sum())}
    for i, name in enumerate(("hue", "saturation", "value")):
        v = hsv[..., i][mask].astype(float)
        out[f"average_{name}"] = float(v.mean()) if len(v) else None
        out[f"{name}_sd"] = float(v.std()) if len(v) else None
    return out


def outline(mask: np.ndarray) -> np.ndarray:
    """Pixels of a mask with a neighbour outside it, to the sides or above and below."""
    m = np.asarray(mask, bool)
    n = _ring(m)
    return m & ~(n[0] & n[2] & n[4] & n[6]).astype(bool)


def dilated(mask: np.ndarray, radius: float) -> np.ndarray:
    return distance_transform(~np.asarray(mask, bool)) <= radius


def boundary_f(a: np.ndarray, b: np.ndarray, tolerance: float = 2.0) -> float:
    """F-measure of two masks' outlines within a tolerance; 1 for two empty masks, 0 for one."""
    oa, ob = outline(a), outline(b)
    if not oa.any() or not ob.any():
        return float(not oa.any() and not ob.any())
    p, r = (oa & dilated(ob, tolerance)).sum() / oa.sum(), (ob & dilated(oa, tolerance)).sum() / ob.sum()
    return float(2 * p * r / (p + r)) if p + r else 0.0


def mask_ious(masks: np.ndarray) -> np.ndarray:
    """IoU of all pairs of masks, by one product of their pixels."""
    flat = masks.reshape(len(masks), -1).astype(float)
    inter = flat @ flat.T
    area = flat.sum(1)
    union = area[:, None] + area[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def nms(ious: np.ndarray, scores: np.ndarray, most: float) -> list[int]:
    """Positions kept, best score first: one goes if its IoU with a kept one is above `most`."""
    order = np.argsort(-scores, kind="stable")
    kept: list[int] = []
    for i in order:
        if not any(ious[i, j] > most for j in kept):
            kept.append(int(i))
    return kept


def semantic(masks: np.ndarray) -> np.ndarray:
    return masks.any(0)


def transposed_into(frame: np.ndarray, crop: np.ndarray, x: int, y: int, w: int, h: int, turned: bool, gap: int = 5) -> None:
    """Puts a crop into its place in a bin's frame, inside a gap, transposed if the partition was turned."""
    part = np.swapaxes(crop, 0, 1) if turned else crop
    part = part[: h - 2 * gap, : w - 2 * gap]
    frame[y + gap : y + gap + part.shape[0], x + gap : x + gap + part.shape[1]] = part


def track_ious(a: list[dict[int, tuple]], b: list[dict[int, tuple]]) -> np.ndarray:
    """IoU of tracks (frame to box) over the frames that both have: sums of overlaps over sums of unions."""
    out = np.zeros((len(a), len(b)))
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            both = p.keys() & q.keys()
            inter = union = 0.0
            for f in both:
                one, two = np.array([p[f]], float), np.array([q[f]], float)
                area = lambda x: float((x[0, 2] - x[0, 0]) * (x[0, 3] - x[0, 1]))
                iou = float(box_ious(one, two)[0, 0])
                total = area(one) + area(two)
                overlap = iou * total / (1 + iou)
                inter += overlap
                union += total - overlap
            out[i, j] = inter / union if union else 0.0
    return out


def encoded(mask: np.ndarray) -> dict:
    return {"size": list(mask.shape), "counts": rle_encode(mask)}
