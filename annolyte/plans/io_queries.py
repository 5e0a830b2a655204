"""Queries of readers and writers, over documents made from the virtual annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import annotations as A
from ..sources import coco as C
from .registry import register
from .validation import _files
from .virtual import WITH, shapes


#: Images in a document: a data set comes in as many documents as it needs, so that none outgrows a task's memory.
IMAGES_EACH = 64


def _coco(spark, sf_dir) -> DataFrame:
    """Three COCO data sets in documents of `IMAGES_EACH` images: 32 cases of shapes are an image."""
    s = shapes(spark, sf_dir).withColumn("image", F.floor(F.col("case_id") / 32))
    a = F.struct((F.col("case_id") * 10 + F.col("shape_id")).alias("id"), F.col("image").alias("image_id"), (F.col("line") - 1).alias("category_id"), F.array((F.col("x0") * 1.0), F.col("y0") * 1.0, (F.col("x1") - F.col("x0")) * 1.0, (F.col("y1") - F.col("y0")) * 1.0).alias("bbox"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 1.0).alias("area"), F.lit(0).alias("iscrowd"))
    g = s.groupBy((F.col("image") % 3).alias("d"), F.floor(F.col("image") / (3 * IMAGES_EACH)).alias("_part")).agg(F.collect_list(a).alias("annotations"), F.collect_set(F.struct(F.col("image").alias("id"), F.concat(F.lit("f"), "image").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))).alias("images"))
    cats = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(i.alias("id"), F.concat(F.lit("c"), i).alias("name")))
    doc = F.to_json(F.struct("images", "annotations", cats.alias("categories")))
    return g.select(F.concat(F.lit("d"), "d").alias("dataset"), F.try_parse_json(doc).alias("v"))


FLAT = f"{WITH}, s AS (SELECT *, case_id // 32 AS image FROM shapes)"


@register("coco_flatten", f"{FLAT} SELECT 'd' || (image % 3) AS dataset, image AS image_id, 'c' || (line - 1) AS category, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area FROM s GROUP BY ALL")
def _(spark, sf_dir):
    images, annotations, categories = C.tables(_coco(spark, sf_dir))
    j = annotations.join(images.select("dataset", F.col("id").alias("image_id")), ["dataset", "image_id"]).join(categories.select("dataset", F.col("id").alias("category_id"), F.col("name").alias("category")), ["dataset", "category_id"])
    return j.groupBy("dataset", "image_id", "category").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@register("coco_group_by_image", f"{FLAT} SELECT 'd' || (image % 3) AS dataset, image AS id, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf_dir):
    images, annotations, _ = C.tables(_coco(spark, sf_dir))
    return C.by_image(images, annotations).select("dataset", "id", F.size("annotations").cast("long").alias("n"))


@register(
    "coco_datapoints",
    f"{FLAT}, i AS (SELECT DISTINCT image FROM s) SELECT 'd' || (image % 3) AS dataset, image AS image_id, CAST(k // 3 AS BIGINT) AS chunk, count(*) AS queries, CAST(sum((SELECT count(*) FROM s WHERE s.image = i.image AND s.line - 1 = k)) AS BIGINT) AS objects FROM i, range(0, 7) t(k) GROUP BY ALL",
)
def _(spark, sf_dir):
    d = C.datapoints(*C.tables(_coco(spark, sf_dir)), chunk=3)
    objects = F.aggregate("queries", F.lit(0).cast("bigint"), lambda n, q: n + F.size(q["objects"]))
    return d.select("dataset", "image_id", "chunk", F.size("queries").cast("long").alias("queries"), objects.alias("objects"))


@register(
    "coco_zero_to_one",
    f"""{FLAT}, z AS (SELECT image % 3 AS d, max(CASE WHEN image = 0 THEN 1 ELSE 0 END) AS zero FROM s GROUP BY ALL)
        SELECT 'd' || d AS dataset, image + zero AS image_id, line AS category_id, count(*) AS n FROM s JOIN z ON image % 3 = d GROUP BY ALL""",
)
def _(spark, sf_dir):
    _, a, _ = C.one_based(*C.tables(_coco(spark, sf_dir)))
    return a.groupBy("dataset", "image_id", "category_id").agg(F.count("*").alias("n"))


@register("annotation_roundtrip", f"{WITH} SELECT case_id, count(*) AS n, CAST(sum(x0 + y1) AS DOUBLE) AS total, count(*) FILTER (WHERE score IN (9)) AS bare FROM shapes GROUP BY case_id")
def _(spark, sf_dir):
    """Read, written and read again."""
    again = A.shapes_of(A.to_json(A.shapes_of(_files(spark, sf_dir))))
    p = F.col("points")
    return again.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(p[0][0] + p[1][1]).alias("total"), F.count_if(F.col("attributes").isNull()).alias("bare"))


@register("annotation_read", f"{WITH} SELECT case_id, n AS name, contains(CASE WHEN case_id % 11 = 0 THEN 'invalidlabelname' ELSE 'wire' END, lower(n)) AS selected, count(*) AS shapes FROM shapes, (VALUES ('WIRE'), ('label')) t(n) GROUP BY ALL")
def _(spark, sf_dir):
    return A.shapes_of(_files(spark, sf_dir), ["WIRE", "label"], 0.5).groupBy("case_id", "name", "selected").agg(F.count("*").alias("shapes"))


@register("viewer_import", f"{FLAT} SELECT label, count(*) AS n, CAST(sum(pts) AS BIGINT) AS points FROM (SELECT 'object_' || (line - 1) AS label, 2 AS pts FROM s UNION ALL SELECT CASE WHEN case_id % 11 = 0 THEN 'InvalidLabelName' ELSE 'wire' END, 2 FROM shapes) GROUP BY label")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    flat = s.select("case_id", F.to_json(F.struct(F.array(F.struct((F.col("line") - 1).alias("category_id"), F.array(F.array("x0", "y0", "x1", "y1")).alias("segmentation"))).alias("annotations"))).alias("json"))
    v = A.viewer_rows(_files(spark, sf_dir)).unionByName(A.viewer_rows(flat))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("points")).alias("points"))


def _videos(spark, sf_dir):
    """A video for each ten images; tracks are line numbers, with no box where a case lacks the line."""
    s = shapes(spark, sf_dir).withColumn("f", F.floor(F.col("case_id") / 32) % 10).withColumn("video", F.floor(F.col("case_id") / 320))
    box = F.struct(F.col("f").alias("f"), F.col("case_id"), F.array(F.col("x0") * 1.0, F.col("y0") * 1.0, (F.col("x1") - F.col("x0")) * 1.0, (F.col("y1") - F.col("y0")) * 1.0).alias("b"))
    first = s.groupBy("video", "shape_id", "f").agg(F.min(box).alias("m"))
    t = first.groupBy("video", "shape_id").agg(F.map_from_entries(F.collect_list(F.struct("f", "m.b"))).alias("by"))
    frames_ = F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))
    boxes = F.transform(frames_, lambda i: F.try_element_at("by", i))
    tracks = t.select(F.lit("v").alias("dataset"), (F.col("video") * 10 + F.col("shape_id")).alias("id"), F.col("video").alias("video_id"), F.col("shape_id").alias("category_id"), F.lit(0).cast("bigint").alias("iscrowd"), F.lit(1.0).alias("score"), boxes.alias("bboxes"), F.transform(boxes, lambda b: F.when(b.isNotNull(), F.lit(0.0))).alias("areas"))
    videos = s.select("video").distinct().select(F.lit("v").alias("dataset"), F.col("video").alias("id"), F.transform(frames_, lambda i: F.concat(F.lit("n"), i)).alias("file_names"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return videos, tracks


@register(
    "ytvis_to_coco",
    f"""{WITH}, s AS (SELECT case_id // 320 AS video_id, (case_id // 32) % 10 AS frame_index, shape_id, case_id, x0, y0, x1, y1 FROM shapes),
        m AS (SELECT *, row_number() OVER (PARTITION BY video_id, shape_id, frame_index ORDER BY case_id, x0, y0, x1 - x0, y1 - y0) AS r FROM s),
        v AS (SELECT video_id, dense_rank() OVER (ORDER BY video_id) - 1 AS place FROM (SELECT DISTINCT video_id FROM s))
        SELECT video_id, shape_id AS category_id, CAST(frame_index AS BIGINT) AS frame_index, CAST(place * 10 + frame_index AS BIGINT) AS image_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM m JOIN v USING (video_id) WHERE r = 1""",
)
def _(spark, sf_dir):
    videos, tracks = _videos(spark, sf_dir)
    got = C.track_annotations(tracks, C.video_frames(videos), pred=True)
    return got.select("video_id", "category_id", F.col("frame_index").cast("long"), "image_id", "area")


@register("prediction_writer", f"{WITH} SELECT case_id, shape_id, round_even(x0 / 7.0, 5) AS x, round_even(score / 64.0, 5) AS score FROM shapes")
def _(spark, sf_dir):
    p = shapes(spark, sf_dir).select("case_id", "shape_id", F.array(F.col("x0") / 7.0).alias("bbox"), (F.col("score") / 64.0).alias("score"))
    return C.prediction_rows(p).select("case_id", "shape_id", F.col("bbox")[0].alias("x"), "score")


@register(
    "pair_remap",
    f"{WITH}, p AS (SELECT case_id % 50 AS video_id, line AS category_id FROM shapes UNION SELECT case_id % 50, pred_id + 3 FROM (SELECT case_id, shape_id AS pred_id FROM shapes WHERE shape_id % 2 = 0)) SELECT video_id, category_id, row_number() OVER (ORDER BY video_id, category_id) AS pair_id FROM p",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir).withColumn("video_id", F.col("case_id") % 50)
    return C.pair_ids(s.select("video_id", F.col("line").alias("category_id")), s.where("shape_id % 2 = 0").select("video_id", (F.col("shape_id") + 3).alias("category_id")))


@register("mask_areas", f"{WITH} SELECT case_id, shape_id, y0 + y1 AS area FROM shapes")
def _(spark, sf_dir):
    return shapes(spark, sf_dir).select("case_id", "shape_id", C.mask_area(F.array("x0", "y0", "x1", "y1", "line")).alias("area"))


@register(
    "track_results",
    f"""{WITH}, o AS (SELECT case_id // 320 AS video_id, line AS track_id, (case_id // 32) % 10 AS frame, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score FROM shapes GROUP BY ALL),
        s AS (SELECT video_id, track_id, g AS frame FROM (SELECT DISTINCT video_id, track_id FROM o), range(0, 10) t(g))
        SELECT s.video_id, s.track_id, CAST(max(score) OVER (PARTITION BY s.video_id, s.track_id) AS DOUBLE) AS score, CAST(s.frame AS BIGINT) AS frame, CAST(coalesce(x0, 0) AS DOUBLE) AS x, CAST(coalesce(x1 - x0, 0) AS DOUBLE) AS w, CAST(coalesce((x1 - x0) * (y1 - y0), 0) AS DOUBLE) AS area
        FROM s LEFT JOIN o USING (video_id, track_id, frame)""",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir).groupBy(F.floor(F.col("case_id") / 320).alias("video_id"), F.col("line").alias("track_id"), (F.floor(F.col("case_id") / 32) % 10).alias("frame"))
    g = s.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("score").cast("double").alias("score"))
    rows = g.select("video_id", "track_id", F.col("track_id").alias("category_id"), "frame", "score", F.struct("x0", "y0", "x1", "y1").alias("box"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.lit(None).cast("string").alias("segmentation"))
    t = C.track_results(rows, g.select("video_id").distinct().withColumn("n_frames", F.lit(10)))
    flat = t.select("video_id", "track_id", "score", F.posexplode(F.arrays_zip("bboxes", "areas")).alias("frame", "z"))
    return flat.select("video_id", "track_id", "score", F.col("frame").cast("long").alias("frame"), F.col("z.bboxes")[0].alias("x"), F.col("z.bboxes")[2].alias("w"), F.col("z.areas").alias("area"))
