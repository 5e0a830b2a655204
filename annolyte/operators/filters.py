"""Filters and rewrites of query tables.

queries: query_id, stage, image_id, text, box columns and flags; objects: object_id, image_id, area,
is_crowd, x, y, w, h; outputs: query_id, object_id. All filters return queries or ids to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box as B


def chance(*keys: Column, salt: int = 0) -> Column:
    """A number in [0, 1) by a hash of keys: the same at any partitioning and in every retry."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def without_texts(queries: DataFrame, texts: list[str], text: str = "text") -> DataFrame:
    """Queries whose text (trimmed, lower case) is not on the list; null texts stay."""
    return queries.where(~F.coalesce(F.lower(F.trim(F.col(text))).isin([t.strip().lower() for t in texts]), F.lit(False)))


def keep_most(queries: DataFrame, by: list[str], n: int, positive: str | None = None, key: str = "query_id", salt: int = 0) -> DataFrame:
    """At most n queries of each group, those with outputs first if `positive` names that flag, the rest drawn by hash."""
    order = ([F.desc(positive)] if positive else []) + [chance(F.col(key), salt=salt), F.col(key)]
    return queries.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def keep_most_of_video(queries: DataFrame, video: str, frame: str, n: int, position: str = "position") -> DataFrame:
    """Positions drawn on each video's frame 0 and kept on all its frames."""
    first = keep_most(queries.where(F.col(frame) == 0), [video], n, key=position)
    return queries.join(first.select(video, position), [video, position], "left_semi")


def semantic_only(queries: DataFrame, box: str = "input_box") -> DataFrame:
    """Without geometric queries."""
    return queries.where(F.col(box).isNull())


def without_zero_boxes(queries: DataFrame, outputs: DataFrame, objects: DataFrame) -> DataFrame:
    """Without queries that refer to an object of no box."""
    zero = objects.where(B.is_zero(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).select("object_id")
    return queries.join(outputs.join(zero, "object_id", "left_semi").select("query_id").distinct(), "query_id", "left_anti")


def without_many_outputs(queries: DataFrame, outputs: DataFrame, most: int) -> DataFrame:
    many = outputs.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return queries.join(many, "query_id", "left_anti")


def usable_objects(objects: DataFrame, least: float = 1e-6, crowds: bool = False) -> DataFrame:
    ok = objects.where(F.col("area") >= least)
    return ok if crowds else ok.where(~F.col("is_crowd"))


def exhaustive(queries: DataFrame, kind: str) -> DataFrame:
    """kind instance: the flag must be true; pixel: it must not be false (null passes)."""
    return queries.where(F.col("is_exhaustive") == F.lit(True)) if kind == "instance" else queries.where(F.coalesce(F.col("is_pixel_exhaustive"), F.lit(True)))


def applied(queries: DataFrame, images: DataFrame, objects: DataFrame, outputs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drops what no query refers to and numbers queries, stages, images and objects anew from 0 in each group.

    A group without a query of its first stage is dropped whole.
    """
    w = lambda c: Window.partitionBy(*by).orderBy(c)
    has = queries.where("stage = 0").select(*by).distinct()
    q = queries.join(has, by, "left_semi")
    q = q.withColumns({"new_query": F.dense_rank().over(w("query_id")) - 1, "new_stage": F.dense_rank().over(w("stage")) - 1})
    i = images.join(q.select(*by, "image_id").distinct(), [*by, "image_id"], "left_semi")
    i = i.withColumn("new_image", F.dense_rank().over(w("image_id")) - 1)
    o = objects.join(i.select(*by, "image_id", "new_image"), [*by, "image_id"])
    o = o.withColumn("new_object", F.dense_rank().over(w("object_id")) - 1)
    b = outputs.join(q.select(*by, "query_id", "new_query"), [*by, "query_id"]).join(o.select(*by, "object_id", "new_object"), [*by, "object_id"])
    return q, i, o, b


def with_affixes(text: Column, prefix: str = "", suffix: str = "", when: Column | None = None) -> Column:
    made = F.concat(F.lit(prefix), text, F.lit(suffix))
    return made if when is None else F.when(when, made).otherwise(text)


def overwritten(text: Column, other: str, p: float, *keys: Column) -> Column:
    return F.when(chance(*keys, salt=1) < p, F.lit(other)).otherwise(text)


def staged(queries: DataFrame, by: list[str], n: int, stride: int, start: int = 0, reverse: bool = False) -> DataFrame:
    """n stages, `stride` apart from `start`; the stride shrinks where there are too few. new_stage counts them."""
    top = queries.groupBy(*by).agg((F.max("stage") + 1).alias("_n"))
    step = F.greatest(F.least(F.lit(stride), F.floor((F.col("_n") - 1 - start) / max(1, n - 1))), F.lit(1))
    q = queries.join(top, by).withColumn("_k", (F.col("stage") - start) / step)
    q = q.where((F.col("stage") >= start) & (F.pmod(F.col("stage") - start, step) == 0) & (F.col("_k") < n)).withColumn("_k", F.col("_k").cast("long"))
    if reverse:
        last = q.groupBy(*by).agg(F.max("_k").alias("_last"))
        q = q.join(last, by).withColumn("_k", F.col("_last") - F.col("_k")).drop("_last")
    return q.withColumnRenamed("_k", "new_stage").drop("_n")


def tiled(rows: DataFrame, frames: int) -> DataFrame:
    """Each row once for each of so many frames."""
    return rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))


def shown(rows: DataFrame, hidden: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows that no list hides; lists have the columns of by."""
    for h in hidden:
        rows = rows.join(h.select(*by).distinct(), by, "left_anti")
    return rows


def best_mask(masks: DataFrame, by: list[str], key: str) -> DataFrame:
    """The candidate of highest IoU, or of highest score if no IoU is positive; the first of equals."""
    some = F.max("iou").over(Window.partitionBy(*by)) > 0
    m = masks.withColumn("_v", F.when(some, F.col("iou")).otherwise(F.col("score")))
    return m.groupBy(*by).agg(F.max_by(key, F.struct(F.col("_v"), -F.col(key))).alias(key))


def limited_new(dets: DataFrame, by: list[str], tracked: str, most: int) -> DataFrame:
    """New detections by score while tracked ones and they together are at most `most` (column `tracked`: how many there are)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "det_id")
    return dets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.greatest(F.lit(most) - F.col(tracked), F.lit(0))).drop("_r")


def with_truth(dets: DataFrame, gt: DataFrame, by: list[str]) -> DataFrame:
    """Detections of categories that have ground truth in their image."""
    return dets.join(gt.select(*by).distinct(), by, "left_semi")


def merged_categories(rows: DataFrame, names: dict, category: str = "category_id") -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return rows if known is None else rows.withColumn(category, F.coalesce(F.try_element_at(known, F.col(category)), F.col(category)))


def without_empty_geometric(queries: DataFrame, outputs: DataFrame, box: str = "input_box") -> DataFrame:
    """Without geometric queries (text "geometric", with an input box) that have no output left."""
    gone = queries.where(F.col(box).isNotNull() & (F.col("text") == "geometric")).select("query_id").join(outputs.select("query_id").distinct(), "query_id", "left_anti")
    return queries.join(gone, "query_id", "left_anti")


def listed(rows: DataFrame, categories: list, category: str = "category_id") -> DataFrame:
    """Rows of categories on the list."""
    return rows.where(F.col(category).isin(categories))


def split_by_size(regions: DataFrame, width: float, height: float, box: str = "box") -> tuple[DataFrame, DataFrame]:
    """(large, small): a region wider or higher than the target is large."""
    b = F.col(box)
    large = (b["x1"] - b["x0"] > width) | (b["y1"] - b["y0"] > height)
    return regions.where(large), regions.where(~large)


def valid_masks(preds: DataFrame, by: list[str], mask: str = "mask", least: int = 5) -> DataFrame:
    """Predictions by score, highest first, without encoded masks shorter than `least` characters; place counts those left."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "pred_id")
    return preds.where(F.length(mask) >= least).withColumn("place", F.row_number().over(w) - 1)


def excluded_images(truths: list[DataFrame], image: str = "image_id", flag: str = "is_instance_exhaustive") -> DataFrame:
    """Images that any of the ground truths does not annotate exhaustively."""
    rows = None
    for t in truths:
        some = t.where(~F.col(flag)).select(image)
        rows = some if rows is None else rows.union(some)
    return rows.distinct()


def evaluated_images(truths: list[DataFrame], image: str = "image_id", flag: str = "is_instance_exhaustive") -> DataFrame:
    """Images of the first ground truth that it and all others annotate exhaustively."""
    mine = truths[0].where(F.col(flag)).select(image)
    return mine.join(excluded_images(truths[1:], image, flag), image, "left_anti") if len(truths) > 1 else mine


def loaded_videos(queries: DataFrame, objects: DataFrame, most: int, force_exhaustive: bool = False, video: str = "video_id") -> DataFrame:
    """For each video asked for, the queries of the first one from it on, around the end, that has `most` masklets at most.

    Masklets are the objects of a video's first image. Adds asked (the video asked for); queries come with place, by processing order. Where every
    video has too many, none are returned. most 0 or less: no limit.
    """
    counts = objects.where("image_id = 0").groupBy(video).agg(F.count("*").alias("_n"))
    videos = queries.select(video).distinct().join(counts, video, "left")
    fits = (F.coalesce("_n", F.lit(0)) <= most) if most > 0 else F.lit(True)
    # The next that fits, forwards; past the last one it is the first that fits of all.
    one = videos.withColumn("_ok", F.when(fits, F.col(video)))
    # Videos are dealt into ranges of 1,000 ids; only ranges and rows within a range are ordered.
    part = F.floor(F.col(video) / 1000)
    down = Window.partitionBy("_p").orderBy(F.desc(video)).rowsBetween(Window.unboundedPreceding, 0)
    ranges = one.withColumn("_p", part).groupBy("_p").agg(F.min("_ok").alias("_first"))
    later = ranges.select(F.col("_p"), F.min("_first").over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    first = ranges.agg(F.min("_first").alias("_start"))
    found = one.withColumn("_p", part).withColumn("_near", F.min("_ok").over(down)).join(later, "_p").join(F.broadcast(first))
    found = found.select(F.col(video).alias("asked"), F.coalesce("_near", "_later", "_start").alias(video)).where(F.col(video).isNotNull())
    q = queries.withColumn("is_exhaustive", F.lit(True)) if force_exhaustive else queries
    place = F.row_number().over(Window.partitionBy("asked").orderBy("query_processing_order", "query_id")) - 1
    return found.join(q, video).withColumn("place", place)


def edited(rows: DataFrame, selected: list | None = None, deleted: list | None = None, key: str = "shape_id") -> DataFrame:
    """An editor's list after deletions, with is_selected."""
    left = rows.where(~F.col(key).isin(deleted)) if deleted else rows
    return left.withColumn("is_selected", F.col(key).isin(selected) if selected else F.lit(False))


def remapped_name(video_id: Column, name: Column) -> Column:
    """File names that are unique after videos are numbered anew: fixed format (H5)."""
    return F.format_string("remapped_vid_%012d/%s", video_id, name)
