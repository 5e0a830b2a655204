"""Queries of video evaluation, sampling and histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import vec as V
from ..operators import evaluate as E
from ..operators import filters as Q
from ..operators import video as Y
from .registry import register, table
from .virtual import WITH, frames, preds, shapes


def _side(df, key):
    v, f = F.floor(F.col("case_id") / 320).alias("video_id"), (F.floor(F.col("case_id") / 32) % 10).alias("frame")
    g = df.groupBy(v, f, F.col(key).alias("id")).agg(*[a(c).alias(c) for a, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], (F.max("score") / 100.0).alias("score"))
    return g.select("video_id", "frame", "id", "score", (F.col("id") % 2).cast("int").alias("cls"), B.box("x0", "y0", "x1", "y1").alias("box"))


@register("image_timesteps", f"{WITH} SELECT case_id AS video_id, shape_id AS image_id, row_number() OVER (PARTITION BY case_id ORDER BY score, shape_id) - 1 AS timestep FROM shapes")
def _(spark, sf_dir):
    return Y.timesteps(shapes(spark, sf_dir).select(F.col("case_id").alias("video_id"), F.col("shape_id").alias("image_id"), F.col("score").alias("frame_index")))


@register("class_agnostic", f"{WITH} SELECT case_id, CAST(1 AS BIGINT) AS category_id, count(*) AS n, sum(CASE WHEN line = 1 THEN 480 ELSE case_id % 7 + 100 END)::BIGINT AS height FROM shapes GROUP BY case_id")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    rows = s.select("case_id", F.col("line").alias("category_id"), F.when(F.col("line") == 1, 480).cast("long").alias("height"), F.lit(None).cast("long").alias("width"), F.col("case_id").alias("video_id"))
    videos = s.select(F.col("case_id").alias("id"), (F.col("case_id") % 7 + 100).alias("height"), F.lit(640).alias("width")).distinct()
    return Y.class_agnostic(Y.with_size(rows, videos)).groupBy("case_id", "category_id").agg(F.count("*").alias("n"), F.sum("height").alias("height"))


@register("phrase_hota")
def _(spark, sf_dir):
    return Y.phrase_hota(_side(shapes(spark, sf_dir), "line"), _side(preds(spark, sf_dir), "pred_id"), ["video_id"], "video_id long", 0.3)


@register("video_teta")
def _(spark, sf_dir):
    return Y.video_teta(_side(shapes(spark, sf_dir), "line"), _side(preds(spark, sf_dir), "pred_id"), ["video_id"], "video_id long", 0.3, nms=0.7)


@register("track_ap")
def _(spark, sf_dir):
    g = _side(shapes(spark, sf_dir), "line")
    m = Y.track_ap(g, _side(preds(spark, sf_dir), "pred_id"), ["video_id"], "video_id long").withColumn("cat", F.lit(1))
    n = Y.track_truths(g.withColumn("cat", F.lit(1)), ["video_id"], ["cat"])
    return E.average_precision(m, n, ["cat", "area"], ["video_id", "id"])


@register("track_summary")
def _(spark, sf_dir):
    """All metrics of whole tracks; lines are categories."""
    g, d = _side(shapes(spark, sf_dir), "line"), _side(preds(spark, sf_dir), "pred_id")
    cat = (F.col("id") % 3).alias("cat")
    m = Y.track_ap(g.select("*", cat), d.select("*", cat), ["video_id", "cat"], "video_id long, cat long")
    return E.coco_summary(m, Y.track_truths(g.select("*", cat), ["video_id", "cat"], ["cat"]), ["cat"], ["video_id", "id"])


@register("merged_reports", f"{WITH} SELECT case_id, count(*) FILTER (WHERE line < 3) AS n, count(*) FILTER (WHERE line >= 3) AS m FROM shapes GROUP BY case_id HAVING count(*) FILTER (WHERE line < 3) > 0 OR count(*) FILTER (WHERE line >= 3) > 0")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    one, two = (s.where(c).groupBy("case_id").agg(F.count("*").alias("n")) for c in ("line < 3", "line >= 3"))
    j = Y.merged([("a", one), ("b", two)], ["case_id"])
    return j.select("case_id", F.coalesce("a_n", F.lit(0)).alias("n"), F.coalesce("b_n", F.lit(0)).alias("m"))


@register("best_history", f"{WITH} SELECT track_id, frame, max((frame * 37) % 101) OVER (PARTITION BY track_id ORDER BY frame) AS best, round(avg((frame * 37) % 101) OVER (PARTITION BY track_id ORDER BY frame), 6) AS mean FROM frames")
def _(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("frame") * 37 % 101
    return frames(spark, sf_dir).select("track_id", "frame", F.max(v).over(w).alias("best"), F.round(F.avg(v).over(w), 6).alias("mean"))


@register("hash_split", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS disjoint FROM orders")
def _(spark, sf_dir):
    """Two halves by a hash of the key: they share nothing and lack nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (Q.chance(F.col("o_orderkey"), salt=5) < 0.5).alias("first"))
    return o.agg(F.count("*").alias("n"), (F.count_distinct("o_orderkey") == F.count("*")).cast("long").alias("disjoint"))


@register("weighted_bce", f"{WITH} SELECT round(avg(CASE WHEN is_error THEN 3 * ln(1 + exp(-(score - 50) / 20.0)) ELSE ln(1 + exp((score - 50) / 20.0)) END), 6) AS loss FROM shapes")
def _(spark, sf_dir):
    x = (F.col("score") - 50) / 20.0
    return shapes(spark, sf_dir).agg(F.round(F.avg(V.bce_with_logits(x, F.col("is_error").cast("double"), positive=3.0)), 6).alias("loss"))


@register("padded_batches", f"{WITH} SELECT case_id % 8 AS chunk, CAST(max(n) AS BIGINT) AS width, count(*) AS rows FROM (SELECT case_id, count(*) AS n FROM shapes GROUP BY case_id) GROUP BY ALL")
def _(spark, sf_dir):
    g = shapes(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_list("shape_id")).alias("ids")).withColumn("chunk", F.col("case_id") % 8)
    width = g.groupBy("chunk").agg(F.max(F.size("ids")).alias("_w"))
    p = g.join(width, "chunk").withColumn("ids", F.concat("ids", F.array_repeat(F.lit(0).cast("long"), F.col("_w") - F.size("ids"))))
    return p.groupBy("chunk").agg(F.max(F.size("ids")).cast("long").alias("width"), F.count("*").alias("rows"))
