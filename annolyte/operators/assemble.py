"""Larger operators made of the others: curation, exemplars, set-cost matching, validators and their summary."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box as B
from . import kernels as K
from . import match
from .batched import by_group


def curated(gt: DataFrame, dt: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """by, category_id, source, gt_id, dt_id, box: ground truth that a detection matches (as often as it's matched, Q14) and
    detections that match none, numbered anew from 0; unmatched ground truth goes (Q32). Rows: by, id, box."""
    g, d = gt.withColumnRenamed("id", "gt_id"), dt.withColumnRenamed("id", "dt_id")
    m = match.threshold_match(g, d, by, least)
    keep = m.select(*by, F.lit("gt").alias("source"), "gt_id", "dt_id", F.col("gt_box").alias("box"))
    new = match.unmatched(d, m, [*by, "dt_id"]).select(*by, F.lit("model").alias("source"), F.lit(None).cast("long").alias("gt_id"), "dt_id", "box")
    w = Window.partitionBy(*by).orderBy("source", "gt_id", "dt_id")
    return keep.unionByName(new).withColumn("category_id", (F.row_number().over(w) - 1).cast("long"))


def back_mapped(shapes: DataFrame, placed: DataFrame, by: list[str], gap: int = 5) -> DataFrame:
    """Boxes on bins mapped to each partition that holds them, and on to the image; several may hold one.

    shapes: by, bin_id, id, box. placed: by, bin_id, partition_id, x, y, w, h, turned, dx, dy (the partition's place in the image).
    """
    j = shapes.join(placed, [*by, "bin_id"])
    b = F.col("box")
    room = B.box(F.col("x") + gap, F.col("y") + gap, F.col("x") + F.col("w") - gap, F.col("y") + F.col("h") - gap)
    j = j.where(B.contains(room, b))
    flat = B.box(b["x0"] - F.col("x") - gap + F.col("dx"), b["y0"] - F.col("y") - gap + F.col("dy"), b["x1"] - F.col("x") - gap + F.col("dx"), b["y1"] - F.col("y") - gap + F.col("dy"))
    # Turned: about the middle of the place, x and y change sides.
    half = lambda c: F.floor(F.col(c) / 2)
    mx, my = F.col("x") + half("w"), F.col("y") + half("h")
    tx = lambda v: v - my + half("h") - gap + F.col("dx")
    ty = lambda v: v - mx + half("w") - gap + F.col("dy")
    turned = B.box(tx(b["y0"]), ty(b["x0"]), tx(b["y1"]), ty(b["x1"]))
    return j.select(*by, "bin_id", "id", "partition_id", F.when(F.col("turned"), turned).otherwise(flat).alias("box"))


def class_cost(score: np.ndarray, kind: str = "score", alpha: float = 0.25, gamma: float = 2.0) -> np.ndarray:
    """What a query's score costs: score: its negative; log: the negative log likelihood; focal: what focal loss gives for a hit less what it gives for a miss."""
    p = np.clip(score, 1e-8, 1 - 1e-8)
    if kind == "score":
        return -score
    if kind == "log":
        return -np.log(p)
    if kind == "focal":
        return -alpha * (1 - p) ** gamma * np.log(p) + (1 - alpha) * p**gamma * np.log(1 - p)
    raise ValueError(f"no class cost {kind}")


def set_cost_match(rows: DataFrame, by: list[str], keys: str, w_class: float = 1.0, w_l1: float = 1.0, w_giou: float = 1.0, kind: str = "score", copies: int = 1) -> DataFrame:
    """by, query_id, target_id of the least total cost: class cost, L1 of centre boxes, -GIoU. rows: by, side, id, score, box (normalised).

    kind: as `class_cost`. copies: how many queries a target takes at most, each query one target; with 1 it's one to one.
    """

    def kernel(key: tuple, c: dict) -> list[tuple]:
        q = [(i, s, b) for i, s, b, side in zip(c["id"], c["score"], c["box"], c["side"], strict=True) if side == 1]
        t = [(i, b) for i, b, side in zip(c["id"], c["box"], c["side"], strict=True) if side == 0] * copies
        if not q or not t:
            return []
        corners = lambda bs: np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in bs], float)
        a, b = corners([x[2] for x in q]), corners([x[1] for x in t])
        centre = lambda x: np.c_[(x[:, :2] + x[:, 2:]) / 2, x[:, 2:] - x[:, :2]]
        l1 = np.abs(centre(a)[:, None] - centre(b)[None]).sum(2)
        iou = K.box_ious(a, b)
        hull = (np.maximum(a[:, None, 2:], b[None, :, 2:]) - np.minimum(a[:, None, :2], b[None, :, :2])).prod(2)
        area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
        union = (area(a)[:, None] + area(b)[None]) / (1 + iou)
        giou = iou - (hull - union) / np.maximum(hull, 1e-12)
        cost = w_class * class_cost(np.array([x[1] for x in q], float), kind)[:, None] + w_l1 * l1 - w_giou * giou
        return [(*key, q[i][0], t[j][0], float(cost[i, j])) for i, j in K.assign(-cost)]

    return by_group(rows, by, ["side", "id"], kernel, f"{keys}, query_id long, target_id long, cost double")


class Validator(Protocol):
    """A validator: its name, and a function from cases to issues (case_id, id, kind, reason, image)."""

    name: str

    def __call__(self, cases: DataFrame) -> DataFrame: ...


def validated(cases: DataFrame, validators: list[tuple[str, Callable[[DataFrame], DataFrame], bool]]) -> DataFrame:
    """Issues of all validators whose flag is set, with their name; none: no rows."""
    out = None
    for name, run, on in validators:
        if on:
            made = run(cases).select("case_id", F.lit(name).alias("validator"), F.col("id").cast("string").alias("id"), "kind", "reason", F.col("image").cast("string").alias("image"))
            out = made if out is None else out.unionByName(made)
    if out is None:
        return cases.sparkSession.createDataFrame([], "case_id long, validator string, id string, kind string, reason string, image string")
    return out


def dashboard(issues: DataFrame, by: list[str]) -> DataFrame:
    """Counts of issues by kind, a column for each."""
    return issues.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "surplus", "low_quality", "json", "feature")])


def counting(rows: DataFrame, by: list[str], score: str, thr: float) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(score) > thr).alias("n"))


def mean_track_area(rows: DataFrame, by: list[str], area: str) -> DataFrame:
    """Without frames of no or zero area."""
    return rows.groupBy(*by).agg(F.avg(F.nullif(F.col(area), F.lit(0))).alias("mean_area"))


def rolled_up(rows: DataFrame, sequence: str, cls: str, parents: DataFrame) -> DataFrame:
    """Sums of counts by sequence, by class over all sequences, and by super-category."""
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in (sequence, cls)]
    seq = rows.groupBy(sequence, cls).agg(*sums).select(F.lit("sequence").alias("level"), F.concat_ws("/", sequence, cls).alias("name"), *[c for c in rows.columns if c not in (sequence, cls)])
    one = rows.groupBy(cls).agg(*sums)
    by_class = one.select(F.lit("class").alias("level"), F.col(cls).cast("string").alias("name"), *[c for c in one.columns if c != cls])
    top = one.join(parents, cls).groupBy("parent").agg(*[F.sum(c).alias(c) for c in one.columns if c != cls])
    return seq.unionByName(by_class).unionByName(top.select(F.lit("parent").alias("level"), F.col("parent").cast("string").alias("name"), *[c for c in one.columns if c != cls]))


def dense_ids(rows: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Ids relabelled from 0 within groups."""
    return rows.withColumn(name, (F.dense_rank().over(Window.partitionBy(*by).orderBy(key)) - 1).cast("long"))


def repeated_ids(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Ids that occur twice in a group: must be none."""
    return rows.groupBy(*by, key).agg(F.count("*").alias("n")).where("n > 1")


def video_f1(images: DataFrame, by: list[str]) -> DataFrame:
    """F1 by video and phrase from counts; 1 where neither side has anything."""
    g = images.groupBy(*by, "thr").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.withColumn("f1", F.when(den == 0, 1.0).otherwise(2 * F.col("tp") / den.cast("double")))


def demo_f1(images: DataFrame) -> DataFrame:
    """By threshold: the share of images with truth that are perfect, of those without that stay empty, and the macro F1 over all."""
    gt, dt = F.col("n_gt") > 0, F.col("n_dt") > 0
    share = lambda hit, of: F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    return images.groupBy("thr").agg(share((F.col("fp") == 0) & (F.col("fn") == 0), gt).alias("perfect_positive"), share(~dt, ~gt).alias("perfect_negative"), F.avg(F.when(~gt & ~dt, 1.0).otherwise(F.col("f1"))).alias("macro_f1"))
