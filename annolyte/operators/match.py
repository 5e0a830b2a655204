"""Pairwise operators over boxes: rows carry a struct column of corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box as B


def pairs(left: DataFrame, right: DataFrame, by: list[str], overlap: bool = True) -> DataFrame:
    """Rows of left with rows of right of the same group; `box` becomes gt_box and dt_box.

    An equi-join on the group, never a cross join. overlap: only pairs whose boxes meet.
    """
    a, b = left.withColumnRenamed("box", "gt_box"), right.withColumnRenamed("box", "dt_box")
    joined = a.join(b, by)
    return joined.where(B.intersects(F.col("gt_box"), F.col("dt_box"))) if overlap else joined


def threshold_match(gt: DataFrame, dt: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """All pairs with an IoU of at least `least`: many to many (Q14). Adds iou."""
    found = pairs(gt, dt, by, overlap=least > 0).withColumn("iou", B.iou(F.col("gt_box"), F.col("dt_box")))
    return found.where(F.col("iou") >= least)


def unmatched(rows: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(matched.select(*keys).distinct(), keys, "left_anti")


def best_match(gt: DataFrame, dt: DataFrame, by: list[str], gt_key: str, dt_key: str) -> DataFrame:
    """For each ground truth that meets a detection, the one of highest IoU, the first of equals."""
    found = pairs(gt, dt, by).withColumn("iou", B.iou(F.col("gt_box"), F.col("dt_box")))
    best = F.max_by(F.struct(dt_key, "iou", "gt_box", "dt_box"), F.struct(F.col("iou"), -F.col(dt_key)))
    return found.groupBy(*by, gt_key).agg(best.alias("b")).select(*by, gt_key, "b.*")


def low_quality(iou: Column, hausdorff: Column) -> Column:
    """The conjunction of a middling IoU and a distant outline (Q34)."""
    return (iou > 0.5) & (iou < 0.8) & (hausdorff > 30)


def contained_in(shapes: DataFrame, regions: DataFrame, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """Shapes with every region of their group that holds them within the tolerance; several may."""
    r = regions.withColumnRenamed("box", "region")
    inner = B.box(F.col("region.x0") + tolerance, F.col("region.y0") + tolerance, F.col("region.x1") - tolerance, F.col("region.y1") - tolerance)
    return shapes.join(r, by).where(B.contains(inner, F.col("box")))


def least_overlapped(rois: DataFrame, by: list[str], key: str) -> DataFrame:
    """By case and orientation, the region whose highest IoU with another is least; the first of equals."""
    wide = F.when(F.col("box.x1") - F.col("box.x0") > F.col("box.y1") - F.col("box.y0"), "h").otherwise("v")
    r = rois.withColumn("orientation", wide)
    a = r.select(*by, "orientation", F.col(key).alias("_k"), F.col("box").alias("_a"))
    b = r.select(*by, "orientation", F.col(key).alias("_o"), F.col("box").alias("_b"))
    most = a.join(b, [*by, "orientation"]).where("_k <> _o").groupBy(*by, "orientation", "_k").agg(F.max(B.iou(F.col("_a"), F.col("_b"))).alias("_most"))
    ranked = a.join(most, [*by, "orientation", "_k"], "left").withColumn("most", F.coalesce("_most", F.lit(0.0)))
    return ranked.groupBy(*by, "orientation").agg(F.min(F.struct("most", "_k")).alias("m")).select(*by, "orientation", F.col("m._k").alias(key), F.col("m.most").alias("most"))


def greedy_nms(dets: DataFrame, by: list[str], order: list[str], least: float, at: bool = True, measure: str = "iou") -> DataFrame:
    """Detections that no kept one before them suppresses, in the given order (`-name` descends).

    A fold over each group's ordered array, so that nothing leaves the JVM. at: suppress at
    the threshold too. measure: iou or iom. Columns of dets must be orderable.
    """
    names = [o.removeprefix("-") for o in order]
    rest = [c for c in dets.columns if c not in by and c not in names]
    key = F.struct(*[(-F.col(o[1:]) if o[0] == "-" else F.col(o)).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*names, *rest).alias("row"))
    ordered = F.transform(F.array_sort(F.collect_list(key)), lambda k: k["row"])
    how = {"iou": B.iou, "iom": B.iom}[measure]
    grouped = dets.groupBy(*by).agg(ordered.alias("_rows"))
    hit = (lambda v: v >= least) if at else (lambda v: v > least)
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda kept, d: F.when(F.exists(kept, lambda k: hit(how(k["box"], d["box"]))), kept).otherwise(F.concat(kept, F.array(d))))
    return grouped.select(*by, F.explode(kept).alias("r")).select(*by, "r.*")


def unique_groups(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Of each key's rows, those of the least rank: results that several workers sent count once."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_least", F.min(rank).over(w)).where(F.col(rank) == F.col("_least")).drop("_least")


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def occlusion_suppressed(objects: DataFrame, by: list[str], least: float = 0.7) -> DataFrame:
    """Of each overlapping pair the object that was occluded later, if it ever was: by, object_id.

    objects: by, object_id, box, last_occluded (-1 for never).
    """
    a = objects.select(*by, F.col("object_id").alias("i"), F.col("box").alias("a"), F.col("last_occluded").alias("oi"))
    b = objects.select(*by, F.col("object_id").alias("j"), F.col("box").alias("b"), F.col("last_occluded").alias("oj"))
    pair = a.join(b, by).where((F.col("i") < F.col("j")) & (B.iou(F.col("a"), F.col("b")) >= least))
    out = F.when((F.col("oi") > F.col("oj")) & (F.col("oj") > -1), F.col("i")).when((F.col("oj") > F.col("oi")) & (F.col("oi") > -1), F.col("j"))
    return pair.select(*by, out.alias("object_id")).where("object_id IS NOT NULL").distinct()


def associate(tracks: DataFrame, dets: DataFrame, by: list[str], matched: float = 0.5, new: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Many-to-one association: (detections with is_new and best track, tracks with is_matched).

    tracks: by, track_id, box; dets: by, det_id, box. A detection is new if no track reaches `new`.
    """
    pair = pairs(tracks, dets, by).withColumn("iou", B.iou(F.col("gt_box"), F.col("dt_box")))
    best = pair.groupBy(*by, "det_id").agg(F.max("iou").alias("most"), F.max_by("track_id", F.struct(F.col("iou"), -F.col("track_id"))).alias("track_id"))
    d = dets.join(best, [*by, "det_id"], "left").select(*by, "det_id", F.when(F.col("most") >= matched, F.col("track_id")).alias("track_id"), (F.coalesce("most", F.lit(0.0)) < new).alias("is_new"))
    hit = pair.groupBy(*by, "track_id").agg(F.max("iou").alias("most"))
    t = tracks.join(hit, [*by, "track_id"], "left").select(*by, "track_id", (F.coalesce("most", F.lit(0.0)) >= matched).alias("is_matched"))
    return d, t


def track_iou(a: DataFrame, b: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """IoU of tracks over their frames: sums of intersections over sums of unions; a frame of one side adds its area.

    a: by, a_id, frame, box; b: by, b_id, frame, box. Pairs that share a frame.
    """
    ta = a.groupBy(*by, "a_id").agg(F.sum(B.area(F.col("box"))).alias("area_a"))
    tb = b.groupBy(*by, "b_id").agg(F.sum(B.area(F.col("box"))).alias("area_b"))
    both = a.withColumnRenamed("box", "ba").join(b.withColumnRenamed("box", "bb"), [*by, frame])
    inter = both.groupBy(*by, "a_id", "b_id").agg(F.sum(B.intersection(F.col("ba"), F.col("bb"))).alias("inter"), F.count("*").alias("shared"))
    out = inter.join(ta, [*by, "a_id"]).join(tb, [*by, "b_id"])
    return out.select(*by, "a_id", "b_id", "shared", F.coalesce(F.col("inter") / F.nullif(F.col("area_a") + F.col("area_b") - F.col("inter"), F.lit(0.0)), F.lit(0.0)).alias("iou"))


def nearest_frames(targets: DataFrame, conditions: DataFrame, by: list[str], n: int, keep_first: bool = False) -> DataFrame:
    """For each target frame, up to n conditioning frames: by, frame, cond, rank.

    The closest before and the closest at or after always; the rest by distance, the earlier of equals. keep_first:
    also the first of those before always, or, if there's none, the last of those after. targets: by, frame; conditions: by, cond.
    """
    # Conditions are numbered; a target needs the n before and the n at or after it, found by a running count instead of all pairs.
    known = conditions.select(*by, "cond").distinct()
    numbered = known.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("cond")))
    marks = known.select(*by, F.col("cond").alias("frame"), F.lit(1).alias("_is")).unionByName(targets.select(*by, "frame", F.lit(0).alias("_is")).distinct())
    line = Window.partitionBy(*by).orderBy("frame")
    before = F.coalesce(F.sum("_is").over(line.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = F.sum("_is").over(Window.partitionBy(*by))
    near = F.sequence(F.greatest(before - n + 1, F.lit(1)), F.greatest(F.least(before + n, top), F.lit(1)))
    if keep_first:
        near = F.array_distinct(F.concat(near, F.array(F.lit(1).cast("bigint"), top)))
    at = marks.withColumn("_near", near).where("_is = 0").select(*by, "frame", F.explode("_near").alias("_n"))
    pair = at.join(numbered, [*by, "_n"]).drop("_n")
    w = Window.partitionBy(*by, "frame")
    c, f = F.col("cond"), F.col("frame")
    sure = F.coalesce(c == F.max(F.when(c < f, c)).over(w), F.lit(False)) | F.coalesce(c == F.min(F.when(c >= f, c)).over(w), F.lit(False))
    if keep_first:
        sure = sure | (c == F.coalesce(F.min(F.when(c < f, c)).over(w), F.max(F.when(c > f, c)).over(w), F.lit(-1)))
    ranked = pair.withColumn("_sure", F.when(sure, 0).otherwise(1)).withColumn("rank", F.row_number().over(w.orderBy("_sure", F.abs(c - f), "cond")))
    return ranked.where(F.col("rank") <= n).select(*by, "frame", "cond", F.col("rank").cast("long"))
