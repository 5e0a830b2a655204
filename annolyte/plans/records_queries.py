"""Queries of record loaders and of shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import shapes as S
from ..sources import records as R
from .registry import register
from .virtual import WITH, frames, shapes


def _corners():
    return B.box("x0", "y0", "x1", "y1")


@register("crop_rectangles", f"{WITH} SELECT case_id, shape_id, greatest(x0 - 10, 0) AS x0, greatest(y0 - 10, 0) AS y0, least(x1 + 10, 120) AS x1, least(y1 + 10, 80) AS y1 FROM shapes")
def _(spark, sf_dir):
    c = S.crop(_corners(), 120, 80)
    return shapes(spark, sf_dir).select("case_id", "shape_id", *[c[n].cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")])


@register("shape_areas", f"{WITH} SELECT case_id, shape_id, round(CASE line % 3 WHEN 0 THEN pi() * (x1 - x0) * (x1 - x0) / 4.0 WHEN 1 THEN pi() * (x1 - x0) * (y1 - y0) / 4.0 ELSE (x1 - x0) * (y1 - y0) END, 4) AS area FROM shapes")
def _(spark, sf_dir):
    from ..functions.poly import point

    s = shapes(spark, sf_dir)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    kind = F.when(F.col("line") % 3 == 0, "circle").when(F.col("line") % 3 == 1, "ellipse").otherwise("rectangle")
    points = F.when(F.col("line") % 3 == 0, S.circle(cx, cy, (F.col("x1") - F.col("x0")) / 2)).when(F.col("line") % 3 == 1, S.ellipse(point(F.col("x0"), cy), point(F.col("x1"), cy), point(cx, F.col("y0")), point(cx, F.col("y1")))).otherwise(S.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return s.select("case_id", "shape_id", F.round(S.shape_area(kind, points), 4).alias("area"))


@register("box_augment", f"{WITH} SELECT case_id, shape_id, CAST(200 - x1 AS DOUBLE) AS fx0, CAST(least(greatest(x0 - 30, 0), 60) AS DOUBLE) AS cx0, least(greatest((x0 + x1) / 2.0 + (x1 - x0) * 0.75, 0), 150) AS rx1 FROM shapes")
def _(spark, sf_dir):
    b = _corners()
    return shapes(spark, sf_dir).select("case_id", "shape_id", S.flipped(b, F.lit(200))["x0"].alias("fx0"), S.cropped_to(b, 30, 10, 60, 40)["x0"].alias("cx0"), S.rescaled(b, 1.5, 150, 120)["x1"].alias("rx1"))


@register("masklet_format", f"{WITH} SELECT case_id AS image_id, shape_id - 1 AS obj_id, round(x0 / 640.0, 9) AS x, round((y1 - y0) / 480.0, 9) AS h, 1.0::DOUBLE AS prob FROM shapes")
def _(spark, sf_dir):
    a = shapes(spark, sf_dir).select(F.col("case_id").alias("image_id"), F.col("shape_id").alias("id"), F.array(F.col("x0") * 1.0, F.col("y0") * 1.0, (F.col("x1") - F.col("x0")) * 1.0, (F.col("y1") - F.col("y0")) * 1.0).alias("bbox"), F.lit(None).alias("score"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return R.masklets(a, False).select("image_id", "obj_id", F.round(F.col("box")[0], 9).alias("x"), F.round(F.col("box")[3], 9).alias("h"), "prob")


@register("frame_lookup", f"{WITH}, m AS (SELECT track_id, miss FROM frames WHERE frame = 5) SELECT track_id AS id, 'p' || (track_id % 3) AS phrase, CASE WHEN miss THEN 'empty' ELSE 'mask' || track_id END AS mask FROM m")
def _(spark, sf_dir):
    mask = F.when(~F.col("miss"), F.concat(F.lit("mask"), "track_id"))
    t = frames(spark, sf_dir).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", mask.alias("m")))), lambda x: x["m"]).alias("masks"))
    t = t.select(F.lit(1).alias("video_id"), F.col("track_id").alias("id"), F.concat(F.lit("p"), F.col("track_id") % 3).alias("phrase"), "masks").where(F.size("masks") >= 5)
    return R.frame_lookup(t, 1, 4, F.lit("empty")).select("id", "phrase", "mask")


@register(
    "relation_builder",
    f"""{WITH} SELECT case_id, shape_id, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY line) - 1 AS BIGINT) AS image_index, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY score % 3) - 1 AS BIGINT) AS query_index,
        round(least(greatest((x0 / 100.0 + (x1 - x0) / 100.0) * 640, 0), 640), 6) AS x1 FROM shapes""",
)
def _(spark, sf_dir):
    r = shapes(spark, sf_dir).select("case_id", "shape_id", F.col("line").alias("image_id"), (F.col("score") % 3).alias("query_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(F.col("x0") / 100.0, F.col("y0") / 100.0, (F.col("x1") - F.col("x0")) / 100.0, (F.col("y1") - F.col("y0")) / 100.0).alias("bbox"))
    return R.relations(r, ["case_id"]).select("case_id", "shape_id", "image_index", "query_index", F.round(F.col("corners")[2], 6).alias("x1"))


@register("unequal_stages", f"{WITH} SELECT case_id, count(DISTINCT n) AS kinds FROM (SELECT case_id, line, count(*) AS n FROM shapes GROUP BY ALL) GROUP BY case_id HAVING count(DISTINCT n) > 1")
def _(spark, sf_dir):
    return R.unequal_stages(shapes(spark, sf_dir).withColumnRenamed("line", "stage"), ["case_id"])


@register("skip_datapoints", f"{WITH} SELECT case_id FROM shapes GROUP BY case_id HAVING max(line) > 6 OR count(*) > 5")
def _(spark, sf_dir):
    return R.skipped(shapes(spark, sf_dir).withColumnRenamed("line", "n_outputs"), ["case_id"], 6, 5)


@register("frames_needed", f"{WITH} SELECT DISTINCT track_id * 1000 + frame AS frame_id, 'v' || track_id AS file, frame AS place FROM frames WHERE frame % 4 = 1")
def _(spark, sf_dir):
    f = frames(spark, sf_dir).select((F.col("track_id") * 1000 + F.col("frame")).alias("frame_id"), F.concat(F.lit("v"), "track_id", F.lit("@"), "frame").alias("path"), "frame")
    return R.frames_needed(f, f.where("frame % 4 = 1")).select("frame_id", "file", "place")


@register("sidecar_resolution", f"{WITH}, s AS (SELECT case_id, shape_id, score % 4 AS k FROM shapes) SELECT case_id, shape_id, CASE k WHEN 0 THEN 'img/' || shape_id WHEN 1 THEN 'c' || case_id || '/own' WHEN 2 THEN '/abs' END AS path FROM s")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    k = F.col("score") % 4
    i = s.select("case_id", "shape_id", F.concat(F.lit("c"), "case_id").alias("case_path"), F.when(k == 0, F.concat(F.lit("img/"), "shape_id")).when(k == 1, "own").when(k == 2, "/abs").otherwise("gone").alias("image"))
    files = s.select(F.concat(F.lit("img/"), "shape_id").alias("path")).union(s.select(F.concat(F.lit("c"), "case_id", F.lit("/own")))).union(s.limit(1).select(F.lit("/abs"))).distinct()
    return R.resolved(i, files).select("case_id", "shape_id", "path")


@register("viewer_export", f"{WITH} SELECT case_id, 'l' || (line % 2) AS label, row_number() OVER (PARTITION BY case_id, line % 2 ORDER BY shape_id) - 1 AS place, shape_id, CAST(x0 AS DOUBLE) AS x, 'polygon' AS type, 'OK' AS status FROM shapes")
def _(spark, sf_dir):
    rows = shapes(spark, sf_dir).select("case_id", F.concat(F.lit("l"), F.col("line") % 2).alias("label"), F.col("shape_id").alias("place"), F.lit("polygon").alias("type"), F.array(F.array("x0", "y0")).alias("points"), F.lit("image.jpg").alias("image"), F.struct(F.col("shape_id").alias("category_id")).alias("attributes"))
    v = F.try_variant_get(F.try_parse_json("json"), "$.Labels", "array<struct<Label: string, Shapes: array<struct<Type: string, points: array<array<double>>, Attributes: struct<category_id: bigint>>>, Status: string>>")
    labels = R.viewer_export(rows).select("case_id", F.explode(v).alias("l"))
    each = labels.select("case_id", F.col("l.Label").alias("label"), F.col("l.Status").alias("status"), F.posexplode("l.Shapes").alias("place", "s"))
    return each.select("case_id", "label", F.col("place").cast("long").alias("place"), F.col("s.Attributes.category_id").alias("shape_id"), F.col("s.points")[0][0].alias("x"), F.col("s.Type").alias("type"), "status")


@register("result_documents", f"{WITH} SELECT case_id, count(*) FILTER (WHERE json_vote) AS issues, count(*) FILTER (WHERE is_error AND json_vote) AS tp FROM shapes GROUP BY case_id")
def _(spark, sf_dir):
    from ..operators.metrics import confusion

    s = shapes(spark, sf_dir)
    issues = s.where("json_vote").select("case_id", F.col("shape_id").cast("string").alias("id"), F.lit("x").alias("image"), F.lit("r").alias("reason"))
    docs = R.result_documents(issues, confusion(s, ["case_id"], "is_error", "json_vote"), ["case_id"])
    v = F.try_parse_json("json")
    return docs.select("case_id", F.size(F.try_variant_get(v, "$['Labels with Issue']", "array<variant>")).cast("long").alias("issues"), F.try_variant_get(v, "$['True Positives Num']", "bigint").alias("tp"))
