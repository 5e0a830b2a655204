"""Queries of the larger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B
from ..operators import assemble as S
from ..operators import evaluate as E
from ..operators import features, match, recommend
from .evaluation import _images, _regions, packed, partitions
from .matching import AREA_A, AREA_B, INTER, MATCHED
from .registry import register, table
from .virtual import WITH, frames, preds, shapes

def corners():
    return B.box("x0", "y0", "x1", "y1")



@register("curation", f"""{MATCHED}, u AS (SELECT s.case_id, 'gt' AS source, s.shape_id AS gt_id, m.pred_id AS dt_id, s.x0, s.y1 FROM m JOIN shapes s USING (case_id, shape_id)
    UNION ALL SELECT p.case_id, 'model', NULL, p.pred_id, p.x0, p.y1 FROM preds p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = p.case_id AND m.pred_id = p.pred_id))
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source, gt_id NULLS FIRST, dt_id) - 1 AS category_id FROM u""")
def _(spark, sf_dir):
    g = shapes(spark, sf_dir).select("case_id", F.col("shape_id").alias("id"), corners().alias("box"))
    d = preds(spark, sf_dir).select("case_id", F.col("pred_id").alias("id"), corners().alias("box"))
    got = S.curated(g, d, ["case_id"])
    return got.select("case_id", "source", "gt_id", "dt_id", F.col("box.x0").cast("long").alias("x0"), F.col("box.y1").cast("long").alias("y1"), "category_id")


@register("packed_point_mapping")
def _(spark, sf_dir):
    """Each partition's own box on its bin comes back to where it was cut out."""
    parts = partitions(_regions(spark, sf_dir))
    placed = packed(parts, False).join(parts.select("case_id", "partition_id", F.col("x0").alias("dx"), F.col("y0").alias("dy")), ["case_id", "partition_id"])
    inner = B.box(F.col("x") + 7, F.col("y") + 7, F.col("x") + F.col("w") - 7, F.col("y") + F.col("h") - 7)
    marks = placed.select("case_id", "bin_id", F.col("partition_id").alias("id"), inner.alias("box"))
    return S.back_mapped(marks, placed.drop("utilisation", "fitness"), ["case_id"]).select("case_id", "bin_id", "id", "partition_id", "box.*")


@register("set_cost_match")
def _(spark, sf_dir):
    rows = _images(spark, sf_dir).where("side < 2").withColumn("box", B.normalised(F.col("box"), 200, 120))
    return S.set_cost_match(rows, ["case_id"], "case_id long")


@register("exemplar_for_case", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-10) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) k FROM s) SELECT query_id, r.vec_id AS case_id, CAST(label AS BIGINT) AS exemplar FROM r JOIN embeddings USING (vec_id) WHERE k = 1""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = recommend.nearest(q, e.select(F.col("vec_id").alias("case_id"), "embedding"), "query_id", "case_id", 1, others=True)
    edges = e.select(F.col("vec_id").alias("case_id"), F.col("label").cast("long").alias("exemplar"))
    return recommend.exemplars_of(near, edges, "query_id", "case_id").select("query_id", "case_id", "exemplar")


@register("edge_integrity", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    return recommend.missing_references(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@register("tree_issues")
def _(spark, sf_dir):
    """The tree learns from half of the cases and judges the other half."""
    s = shapes(spark, sf_dir).select("case_id", "shape_id", (F.col("y1") - F.col("y0")).cast("double").alias("stroke_width"), (F.col("x1") - F.col("x0")).cast("double").alias("stroke_length"), F.col("x0").cast("double").alias("average_value"), F.col("score").cast("double").alias("value_sd"), (F.col("is_error") & (F.col("y1") > 55)).cast("int").alias("label"))
    model = features.fit(s.where("case_id % 2 = 0"))
    return features.issues(model, s.where("case_id % 2 = 1")).select("case_id", "shape_id", "reason")


@register("tree_quality")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir).select("case_id", (F.col("y1") - F.col("y0")).cast("double").alias("stroke_width"), (F.col("x1") - F.col("x0")).cast("double").alias("stroke_length"), F.col("x0").cast("double").alias("average_value"), F.col("score").cast("double").alias("value_sd"), (F.col("is_error") & (F.col("y1") > 55)).cast("int").alias("label"))
    return features.quality(features.fit(s.where("case_id % 2 = 0"), clean_weight=1.0), s.where("case_id % 2 = 1"))


@register("id_densify", f"{WITH} SELECT case_id, line, shape_id, dense_rank() OVER (PARTITION BY case_id ORDER BY line) - 1 AS new_id FROM shapes")
def _(spark, sf_dir):
    return S.dense_ids(shapes(spark, sf_dir), ["case_id"], "line", "new_id").select("case_id", "line", "shape_id", "new_id")


@register("repeated_ids", f"{WITH} SELECT case_id, line, count(*) AS n FROM shapes GROUP BY case_id, line HAVING count(*) > 1")
def _(spark, sf_dir):
    return S.repeated_ids(shapes(spark, sf_dir), ["case_id"], "line")


@register("counting", f"{WITH} SELECT case_id, count(*) FILTER (WHERE score > 50) AS n FROM preds GROUP BY case_id")
def _(spark, sf_dir):
    return S.counting(preds(spark, sf_dir), ["case_id"], "score", 50)


@register("mean_track_area", f"{WITH} SELECT track_id, round(avg(nullif(frame % 7, 0)), 6) AS mean_area FROM frames GROUP BY track_id")
def _(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("area", F.col("frame") % 7)
    return S.mean_track_area(f, ["track_id"], "area").withColumn("mean_area", F.round("mean_area", 6))


@register(
    "metric_rollup",
    f"""{WITH}, r AS (SELECT case_id % 7 AS s, line AS c, CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT is_error) AS BIGINT) AS fp FROM shapes GROUP BY ALL)
        SELECT 'sequence' AS level, s || '/' || c AS name, tp, fp FROM r UNION ALL SELECT 'class', CAST(c AS VARCHAR), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT) FROM r GROUP BY c UNION ALL SELECT 'parent', CAST(c % 2 AS VARCHAR), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT) FROM r GROUP BY c % 2""",
)
def _(spark, sf_dir):
    r = shapes(spark, sf_dir).groupBy((F.col("case_id") % 7).alias("s"), F.col("line").alias("c")).agg(F.count_if("is_error").alias("tp"), F.count_if(~F.col("is_error")).alias("fp"))
    parents = spark.range(1, 8).select(F.col("id").alias("c"), (F.col("id") % 2).alias("parent"))
    return S.rolled_up(r, "s", "c", parents)


@register("video_f1")
def _(spark, sf_dir):
    images = E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long").withColumn("video_id", F.floor(F.col("case_id") / 320))
    return S.video_f1(images, ["video_id"])


@register("demo_f1")
def _(spark, sf_dir):
    return S.demo_f1(E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long"))


@register("validator_dashboard", f"{WITH} SELECT case_id, count(*) FILTER (WHERE json_vote) AS json, count(*) FILTER (WHERE feature_vote) AS feature, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS surplus, CAST(0 AS BIGINT) AS low_quality FROM shapes WHERE json_vote OR feature_vote GROUP BY case_id")
def _(spark, sf_dir):
    def vote(column, kind):
        return lambda s: s.where(column).select("case_id", F.col("shape_id").alias("id"), F.lit(kind).alias("kind"), F.lit(kind).alias("reason"), F.lit(None).alias("image"))

    runs = [("json", vote("json_vote", "json"), True), ("feature", vote("feature_vote", "feature"), True), ("model", vote("model_vote", "missing"), False)]
    return S.dashboard(S.validated(shapes(spark, sf_dir), runs), ["case_id"])


FRAME_NMS = f"""{WITH}, o AS (SELECT case_id, pred_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pred_id) AS r FROM preds),
    k AS (SELECT case_id, CAST(1 AS BIGINT) AS r, [r] AS kept FROM o WHERE r = 1
      UNION ALL SELECT k.case_id, k.r + 1, CASE WHEN EXISTS (SELECT 1 FROM o a WHERE a.case_id = k.case_id AND list_contains(k.kept, a.r) AND 10 * {INTER} >= 3 * ({AREA_A} + {AREA_B} - {INTER})) THEN k.kept ELSE list_append(k.kept, b.r) END
      FROM k JOIN o b ON b.case_id = k.case_id AND b.r = k.r + 1), z AS (SELECT case_id, arg_max(kept, r) AS kept FROM k GROUP BY case_id)
    SELECT o.case_id, o.pred_id FROM o JOIN z ON z.case_id = o.case_id AND list_contains(z.kept, o.r)"""


@register("frame_nms", FRAME_NMS)
def _(spark, sf_dir):
    d = preds(spark, sf_dir).select("case_id", "score", "pred_id", corners().alias("box"))
    return match.greedy_nms(d, ["case_id"], ["-score", "pred_id"], 0.3).select("case_id", "pred_id")


@register("track_nms")
def _(spark, sf_dir):
    """Tracks of a video by score; one goes if it overlaps a kept one over the frames that both have."""
    from ..operators.batched import by_group
    from ..operators.raster import nms, track_ious
    import numpy as np

    rows = preds(spark, sf_dir).withColumn("video_id", F.floor(F.col("case_id") / 320)).withColumn("frame", F.floor(F.col("case_id") / 32) % 10)
    rows = rows.groupBy("video_id", "pred_id", "frame").agg(F.max("score").alias("score"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])

    def kernel(key, c):
        ids = sorted(set(c["pred_id"]))
        at = [{f: b for i, f, *b in zip(c["pred_id"], c["frame"], c["x0"], c["y0"], c["x1"], c["y1"], strict=True) if i == k} for k in ids]
        score = np.array([max(s for i, s in zip(c["pred_id"], c["score"], strict=True) if i == k) for k in ids], float)
        return [(*key, ids[k]) for k in nms(track_ious(at, at), score, 0.5)]

    return by_group(rows, ["video_id"], ["pred_id", "frame"], kernel, "video_id long, pred_id long")
