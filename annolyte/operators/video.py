"""Video evaluation: mappings of frames and ids, and the chains that lead from predictions to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from .batched import by_group
from .match import greedy_nms


def timesteps(images: DataFrame, video: str = "video_id", image: str = "image_id", frame: str = "frame_index") -> DataFrame:
    """video, image, timestep: places of images in their videos, by frame index."""
    return images.select(video, image, (F.row_number().over(Window.partitionBy(video).orderBy(frame, image)) - 1).cast("long").alias("timestep"))


def class_agnostic(rows: DataFrame, category: str = "category_id") -> DataFrame:
    """All categories become 1 (Q42)."""
    return rows.withColumn(category, F.lit(1).cast("long"))


def with_size(rows: DataFrame, videos: DataFrame, video: str = "video_id") -> DataFrame:
    """Height and width from the video where a row has none."""
    v = videos.select(F.col("id").alias(video), F.col("height").alias("_h"), F.col("width").alias("_w"))
    j = rows.join(v, video, "left")
    return j.withColumns({"height": F.coalesce("height", "_h"), "width": F.coalesce("width", "_w")}).drop("_h", "_w")


def gated(preds: DataFrame, score: str, thr: float, strict: bool) -> DataFrame:
    """HOTA keeps scores above the threshold (strict), TETA those at it too (Q38)."""
    return preds.where(F.col(score) > thr if strict else F.col(score) >= thr)


def frame_nms(preds: DataFrame, by: list[str], key: str, least: float) -> DataFrame:
    return greedy_nms(preds, by, ["-score", key], least)


def phrase_hota(gt: DataFrame, preds: DataFrame, by: list[str], keys: str, thr: float = 0.5) -> DataFrame:
    """HOTA of each (video, phrase): strict gate, then the metric with its final fields. gt, preds: by, frame, id, box; preds also score."""
    rows = gt.select(*by, "frame", F.lit(0).alias("side"), "id", "box").unionByName(gated(preds, "score", thr, True).select(*by, "frame", F.lit(1).alias("side"), "id", "box"))
    return E.with_final(E.hota_sequences(rows, by, keys))


def video_teta(gt: DataFrame, preds: DataFrame, by: list[str], keys: str, thr: float = 0.5, nms: float | None = None) -> DataFrame:
    """TETA over all sequences: gate, suppression in each frame if asked for, then the metric. Rows also have cls."""
    p = gated(preds, "score", thr, False)
    if nms is not None:
        p = frame_nms(p.select(*by, "frame", "score", "id", "cls", "box"), [*by, "frame"], "id", nms)
    rows = gt.select(*by, "frame", F.lit(0).alias("side"), "id", "cls", "box").unionByName(p.select(*by, "frame", F.lit(1).alias("side"), "id", "cls", "box"))
    return E.teta_combined(E.teta_sequences(rows, by, keys), [])


#: Ranges of the mean area of a track: fixed values.
AREAS = (("all", 0.0, 1e10), ("small", 0.0, 128.0**2), ("medium", 128.0**2, 256.0**2), ("large", 256.0**2, 1e10))


def track_ap(gt: DataFrame, preds: DataFrame, by: list[str], keys: str, areas: tuple = AREAS, most: int = 100) -> DataFrame:
    """by, area, thr, id, rank, score, hit of whole tracks: they match by their IoU over all frames, best score first, in each range of their mean area.

    gt: by, id, frame, box; preds: also score. A frame of one side adds its area to the union. Totals come from `track_truths`, and
    `evaluate.coco_summary` makes the metrics.
    """

    def kernel(key: tuple, c: dict) -> list[tuple]:
        tracks: tuple[dict, dict] = ({}, {})
        score: dict = {}
        for s, i, f, b, p in zip(c["side"], c["id"], c["frame"], c["box"], c["score"], strict=True):
            tracks[s].setdefault(i, {})[f] = (b["x0"], b["y0"], b["x1"], b["y1"])
            if s:
                score[i] = max(p, score.get(i, p))
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        mean = lambda t: sum(map(area, t.values())) / len(t)

        def iou(a: dict, b: dict) -> float:
            inter = sum(max(0.0, min(a[f][2], b[f][2]) - max(a[f][0], b[f][0])) * max(0.0, min(a[f][3], b[f][3]) - max(a[f][1], b[f][1])) for f in a.keys() & b.keys())
            union = sum(map(area, a.values())) + sum(map(area, b.values())) - inter
            return inter / union if union else 0.0

        dets = [(i, -score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:most]]
        truth = list(tracks[0].values())
        near = [[iou(tracks[1][i], t) for t in truth] for i, _ in dets]
        return E.judged(key, dets, near, [mean(tracks[1][i]) for i, _ in dets], [mean(t) for t in truth], [False] * len(truth), areas)

    rows = gt.select(*by, F.lit(0).alias("side"), "id", "frame", "box", F.lit(1.0).alias("score")).unionByName(preds.select(*by, F.lit(1).alias("side"), "id", "frame", "box", F.col("score").cast("double")))
    return by_group(rows, by, ["side", "id", "frame"], kernel, f"{keys}, area string, thr double, id long, rank int, score double, hit boolean")


def track_truths(gt: DataFrame, by: list[str], cat: list[str], areas: tuple = AREAS) -> DataFrame:
    """cat, area, n_gt: tracks by the range of their mean area. gt: by, cat, id, frame, box."""
    b = F.col("box")
    one = gt.groupBy(*dict.fromkeys([*by, *cat]), "id").agg(F.avg((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("_a"))
    within = F.array_compact(F.array(*[F.when((F.col("_a") >= low) & (F.col("_a") <= high), F.lit(name)) for name, low, high in areas]))
    return one.select(*cat, F.explode(within).alias("area")).groupBy(*cat, "area").agg(F.count("*").alias("n_gt"))


def merged(reports: list[tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """Metrics of several evaluators side by side, each column with its evaluator's name before it; a missing one is null."""
    out = None
    for name, r in reports:
        r = r.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in r.columns if c not in by])
        out = r if out is None else out.join(r, by, "full_outer")
    return out
