"""Queries of pairs, matches, validators and metrics over the virtual annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import poly as P
from ..operators import match, metrics
from .registry import register, table
from .virtual import WITH, frames, preds, shapes

def corners():
    return B.box("x0", "y0", "x1", "y1")

#: SQL of the intersection and the areas of boxes a and b.
INTER = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
IOU = f"(CAST({INTER} AS DOUBLE) / ({AREA_A} + {AREA_B} - {INTER}))"
HULL = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).withColumn("box", corners())


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds(spark, sf_dir).withColumn("box", corners())


def _self_pairs(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("case_id", "shape_id", "box")
    other = s.select("case_id", F.col("shape_id").alias("other_id"), "box")
    return match.pairs(s, other, ["case_id"], overlap=False).where("shape_id < other_id")


def _self(what: str) -> str:
    return f"{WITH} SELECT a.case_id, a.shape_id, b.shape_id AS other_id, {what} FROM shapes a JOIN shapes b ON a.case_id = b.case_id AND a.shape_id < b.shape_id"



@register("box_iou_pairs", _self(f"round({IOU}, 6) AS iou"))
def _(spark, sf_dir):
    return _self_pairs(spark, sf_dir).select("case_id", "shape_id", "other_id", F.round(B.iou(F.col("gt_box"), F.col("dt_box")), 6).alias("iou"))


@register("box_giou_pairs", _self(f"round({IOU} - CAST({HULL} - ({AREA_A} + {AREA_B} - {INTER}) AS DOUBLE) / {HULL}, 9) AS giou"))
def _(spark, sf_dir):
    return _self_pairs(spark, sf_dir).select("case_id", "shape_id", "other_id", F.round(B.giou(F.col("gt_box"), F.col("dt_box")), 9).alias("giou"))


@register("box_ioa_iom", _self(f"round(CAST({INTER} AS DOUBLE) / {AREA_A}, 9) AS ioa, round(CAST({INTER} AS DOUBLE) / least({AREA_A}, {AREA_B}), 9) AS iom"))
def _(spark, sf_dir):
    a, b = F.col("gt_box"), F.col("dt_box")
    return _self_pairs(spark, sf_dir).select("case_id", "shape_id", "other_id", F.round(B.ioa(a, b), 9).alias("ioa"), F.round(B.iom(a, b), 9).alias("iom"))


@register(
    "box_convert",
    f"""{WITH} SELECT case_id, shape_id, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h,
        round(x0 / 200.0, 6) AS nx0, round(least(y1, 60) / 60.0, 6) AS ny1, CAST(x1 AS DOUBLE) AS back FROM shapes""",
)
def _(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    c = B.to_cxcywh(F.col("box"))
    n = B.normalised(B.clip(F.col("box"), 200, 60), 200, 60)
    return s.withColumns({"c": c, "n": n}).select(
        "case_id", "shape_id", "c.cx", "c.cy", "c.w", "c.h", F.round("n.x0", 6).alias("nx0"), F.round("n.y1", 6).alias("ny1"), B.from_xywh(B.to_xywh(B.from_cxcywh(F.col("c"))))["x1"].alias("back")
    )


@register(
    "bond_to_roi",
    f"""{WITH}, b AS (SELECT case_id, shape_id, CAST(x0 AS DOUBLE) x0, CAST(y0 AS DOUBLE) y0, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) d FROM shapes),
        e AS (SELECT case_id, shape_id, least(greatest(x0-(x1-x0)/d*60,0),150) ax, least(greatest(y0-(y1-y0)/d*60,0),120) ay, least(greatest(x1+(x1-x0)/d*60,0),150) bx, least(greatest(y1+(y1-y0)/d*60,0),120) by_ FROM b),
        r AS (SELECT case_id, shape_id, trunc(least(ax,bx)-5)-20 l, trunc(least(ay,by_)-5)-20 t, trunc(greatest(ax,bx)+5)+20 r, trunc(greatest(ay,by_)+5)+20 w FROM e)
        SELECT case_id, shape_id, CAST(least(greatest(l,0),150) AS DOUBLE) x0, CAST(least(greatest(t,0),120) AS DOUBLE) y0, CAST(least(greatest(r,0),150) AS DOUBLE) x1, CAST(least(greatest(w,0),120) AS DOUBLE) y1 FROM r""",
)
def _(spark, sf_dir):
    r = B.bond_roi(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], 150, 120)
    return shapes(spark, sf_dir).select("case_id", "shape_id", r.alias("r")).select("case_id", "shape_id", "r.*")


@register(
    "poly_area_shoelace",
    f"{WITH} SELECT case_id, shape_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM shapes",
)
def _(spark, sf_dir):
    p = P.of_box(F.col("box"))
    return _shapes(spark, sf_dir).select("case_id", "shape_id", P.area(p).alias("area"), P.centroid(p)["x"].alias("cx"), P.centroid(p)["y"].alias("cy"))


@register(
    "poly_bbox",
    f"{WITH} SELECT case_id, shape_id, CAST(y0 + 3 AS DOUBLE) x0, CAST(x0 + 2 AS DOUBLE) y0, CAST(y1 + 3 AS DOUBLE) x1, CAST(x1 + 2 AS DOUBLE) y1 FROM shapes",
)
def _(spark, sf_dir):
    p = P.transposed(P.translated(P.of_box(F.col("box")), 2, 3))
    return _shapes(spark, sf_dir).select("case_id", "shape_id", P.bounds(p).alias("b")).select("case_id", "shape_id", "b.*")


@register(
    "poly_rotate_scale_clip",
    f"""{WITH}, c AS (SELECT *, (x0 + x1) / 2.0 cx, (y0 + y1) / 2.0 cy, (y1 - y0) / 2.0 * 1.5 hw, (x1 - x0) / 2.0 * 1.5 hh FROM shapes)
        SELECT case_id, shape_id, round(least(greatest(cx - hw, 0), 100), 6) x0, round(least(greatest(cy - hh, 0), 100), 6) y0, round(least(greatest(cx + hw, 0), 100), 6) x1, round(least(greatest(cy + hh, 0), 100), 6) y1 FROM c""",
)
def _(spark, sf_dir):
    p = P.of_box(F.col("box"))
    about = P.centroid(p)
    made = P.clipped(P.stretched(P.turned(p, F.radians(F.lit(90.0)), about), 1.5, about), 100, 100)
    b = P.bounds(made)
    return _shapes(spark, sf_dir).select("case_id", "shape_id", *[F.round(b[n], 6).alias(n) for n in ("x0", "y0", "x1", "y1")])


@register(
    "point_in_polygon",
    f"{WITH} SELECT case_id, shape_id, 70 >= x0 AND 70 < x1 AND 40 >= y0 AND 40 < y1 AS covered FROM shapes",
)
def _(spark, sf_dir):
    return _shapes(spark, sf_dir).select("case_id", "shape_id", P.covers(P.of_box(F.col("box")), F.lit(70.0), F.lit(40.0)).alias("covered"))


#: Each corner's distance to the other box's outline, in SQL: outside by the axes, inside the least distance to a side.
def _corner(p: str, q: str) -> str:
    out = []
    for x in ("x0", "x1"):
        for y in ("y0", "y1"):
            dx, dy = f"greatest({q}.x0 - {p}.{x}, {p}.{x} - {q}.x1, 0)", f"greatest({q}.y0 - {p}.{y}, {p}.{y} - {q}.y1, 0)"
            inner = f"least(abs({p}.{x} - {q}.x0), abs({p}.{x} - {q}.x1), abs({p}.{y} - {q}.y0), abs({p}.{y} - {q}.y1))"
            out.append(f"CASE WHEN {dx} = 0 AND {dy} = 0 THEN CAST({inner} AS DOUBLE) ELSE sqrt({dx} * {dx} + {dy} * {dy}) END")
    return ", ".join(out)


@register("hausdorff_rect", _self(f"round(greatest({_corner('a', 'b')}, {_corner('b', 'a')}), 6) AS d"))
def _(spark, sf_dir):
    return _self_pairs(spark, sf_dir).select("case_id", "shape_id", "other_id", F.round(P.hausdorff_boxes(F.col("gt_box"), F.col("dt_box")), 6).alias("d"))


MATCHED = f"{WITH}, m AS (SELECT a.case_id, a.shape_id, b.pred_id, {IOU} AS iou FROM shapes a JOIN preds b ON a.case_id = b.case_id AND 2 * {INTER} >= {AREA_A} + {AREA_B} - {INTER})"


def _matched(spark, sf_dir):
    gt, dt = _shapes(spark, sf_dir).select("case_id", "shape_id", "box"), _preds(spark, sf_dir).select("case_id", "pred_id", "box")
    return gt, dt, match.threshold_match(gt, dt, ["case_id"], 0.5)


@register("threshold_match", f"{MATCHED} SELECT case_id, shape_id, pred_id, round(iou, 6) AS iou FROM m")
def _(spark, sf_dir):
    return _matched(spark, sf_dir)[2].select("case_id", "shape_id", "pred_id", F.round("iou", 6).alias("iou"))


@register("unmatched_gt", f"{MATCHED} SELECT s.case_id, s.shape_id FROM shapes s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = s.case_id AND m.shape_id = s.shape_id)")
def _(spark, sf_dir):
    gt, _, m = _matched(spark, sf_dir)
    return match.unmatched(gt, m, ["case_id", "shape_id"]).select("case_id", "shape_id")


@register("unmatched_pred", f"{MATCHED} SELECT p.case_id, p.pred_id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = p.case_id AND m.pred_id = p.pred_id)")
def _(spark, sf_dir):
    _, dt, m = _matched(spark, sf_dir)
    return match.unmatched(dt, m, ["case_id", "pred_id"]).select("case_id", "pred_id")


@register(
    "best_match",
    f"""{WITH}, p AS (SELECT a.case_id, a.shape_id, b.pred_id, {IOU} AS iou, row_number() OVER (PARTITION BY a.case_id, a.shape_id ORDER BY {IOU} DESC, b.pred_id) r
        FROM shapes a JOIN preds b ON a.case_id = b.case_id AND {INTER} > 0) SELECT case_id, shape_id, pred_id, round(iou, 6) AS iou FROM p WHERE r = 1""",
)
def _(spark, sf_dir):
    gt, dt, _ = _matched(spark, sf_dir)
    return match.best_match(gt, dt, ["case_id"], "shape_id", "pred_id").select("case_id", "shape_id", "pred_id", F.round("iou", 6).alias("iou"))


@register(
    "low_quality_issues",
    f"""{WITH}, p AS (SELECT a.case_id, a.shape_id, b.pred_id, {IOU} AS iou, greatest({_corner('a', 'b')}, {_corner('b', 'a')}) AS d FROM shapes a JOIN preds b ON a.case_id = b.case_id AND {INTER} > 0)
        SELECT case_id, shape_id, pred_id FROM p WHERE iou > 0.5 AND iou < 0.8 AND d > 6""",
)
def _(spark, sf_dir):
    """The rule of Q34 at a distance of 6, as the virtual boxes are small."""
    gt, dt, _ = _matched(spark, sf_dir)
    p = match.pairs(gt, dt, ["case_id"])
    d = P.hausdorff(P.of_box(F.col("gt_box")), P.of_box(F.col("dt_box"))) * 5
    return p.where(match.low_quality(B.iou(F.col("gt_box"), F.col("dt_box")), d)).select("case_id", "shape_id", "pred_id")


def _nms(hit: str) -> str:
    """SQL of greedy suppression; hit: that kept a suppresses b."""
    return f"""{WITH}, o AS (SELECT case_id, shape_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, shape_id) AS r FROM shapes),
    k AS (SELECT case_id, CAST(1 AS BIGINT) AS r, [r] AS kept FROM o WHERE r = 1
      UNION ALL SELECT k.case_id, k.r + 1, CASE WHEN EXISTS (SELECT 1 FROM o a WHERE a.case_id = k.case_id AND list_contains(k.kept, a.r) AND {hit}) THEN k.kept ELSE list_append(k.kept, b.r) END
      FROM k JOIN o b ON b.case_id = k.case_id AND b.r = k.r + 1),
    z AS (SELECT case_id, arg_max(kept, r) AS kept FROM k GROUP BY case_id)
    SELECT o.case_id, o.shape_id FROM o JOIN z ON z.case_id = o.case_id AND list_contains(z.kept, o.r)"""


@register("greedy_nms", _nms(f"2 * {INTER} >= {AREA_A} + {AREA_B} - {INTER}"))
def _(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("case_id", "score", "shape_id", "box")
    return match.greedy_nms(s, ["case_id"], ["-score", "shape_id"], 0.5).select("case_id", "shape_id")


@register("iom_overlap_removal", _nms(f"10 * {INTER} > 3 * least({AREA_A}, {AREA_B})"))
def _(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("case_id", "score", "shape_id", "box")
    return match.greedy_nms(s, ["case_id"], ["-score", "shape_id"], 0.3, at=False, measure="iom").select("case_id", "shape_id")


@register(
    "least_overlapped_hv",
    f"""{WITH}, r AS (SELECT *, CASE WHEN x1 - x0 > y1 - y0 THEN 'h' ELSE 'v' END AS orientation FROM shapes),
        m AS (SELECT a.case_id, a.orientation, a.shape_id, coalesce(max(CASE WHEN b.shape_id IS NOT NULL THEN {IOU} END), 0) AS most
              FROM r a LEFT JOIN r b ON a.case_id = b.case_id AND a.orientation = b.orientation AND a.shape_id <> b.shape_id GROUP BY ALL),
        z AS (SELECT *, row_number() OVER (PARTITION BY case_id, orientation ORDER BY most, shape_id) k FROM m)
        SELECT case_id, orientation, shape_id, round(most, 6) AS most FROM z WHERE k = 1""",
)
def _(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("case_id", "shape_id", "box")
    return match.least_overlapped(s, ["case_id"], "shape_id").select("case_id", "orientation", "shape_id", F.round("most", 6).alias("most"))


ASSOC = f"{WITH}, p AS (SELECT a.case_id, a.shape_id, b.pred_id, {IOU} AS iou FROM shapes a JOIN preds b ON a.case_id = b.case_id AND {INTER} > 0)"


@register(
    "assoc_detections",
    f"""{ASSOC}, b AS (SELECT case_id, pred_id, max(iou) AS most, arg_max(shape_id, iou * 1000000 - shape_id) AS track_id FROM p GROUP BY ALL)
        SELECT d.case_id, d.pred_id AS det_id, CASE WHEN most >= 0.5 THEN track_id END AS track_id, coalesce(most, 0) < 0.5 AS is_new FROM preds d LEFT JOIN b USING (case_id, pred_id)""",
)
def _(spark, sf_dir):
    t = _shapes(spark, sf_dir).select("case_id", F.col("shape_id").alias("track_id"), "box")
    d = _preds(spark, sf_dir).select("case_id", F.col("pred_id").alias("det_id"), "box")
    return match.associate(t, d, ["case_id"])[0]


@register(
    "assoc_tracks",
    f"""{ASSOC}, b AS (SELECT case_id, shape_id, max(iou) AS most FROM p GROUP BY ALL)
        SELECT t.case_id, t.shape_id AS track_id, coalesce(most, 0) >= 0.5 AS is_matched FROM shapes t LEFT JOIN b USING (case_id, shape_id)""",
)
def _(spark, sf_dir):
    t = _shapes(spark, sf_dir).select("case_id", F.col("shape_id").alias("track_id"), "box")
    d = _preds(spark, sf_dir).select("case_id", F.col("pred_id").alias("det_id"), "box")
    return match.associate(t, d, ["case_id"])[1]


#: Videos of ten cases: a case is a frame, a line number a track.
def _tracks(key: str, rows: str) -> str:
    return f"SELECT case_id // 320 AS video_id, (case_id // 32) % 10 AS frame, {key} AS id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 FROM {rows} GROUP BY ALL"



@register(
    "track_iou",
    f"""{WITH}, a AS ({_tracks('line', 'shapes')}), b AS ({_tracks('pred_id', 'preds')}),
        sa AS (SELECT video_id, id, sum((x1-x0)*(y1-y0)) s FROM a GROUP BY ALL), sb AS (SELECT video_id, id, sum((x1-x0)*(y1-y0)) s FROM b GROUP BY ALL),
        i AS (SELECT a.video_id, a.id AS a_id, b.id AS b_id, sum({INTER}) AS inter, count(*) AS shared FROM a JOIN b ON a.video_id = b.video_id AND a.frame = b.frame GROUP BY ALL)
        SELECT i.video_id, a_id, b_id, shared, round(CAST(inter AS DOUBLE) / CAST(sa.s + sb.s - inter AS DOUBLE), 6) AS iou FROM i JOIN sa ON sa.video_id = i.video_id AND sa.id = a_id JOIN sb ON sb.video_id = i.video_id AND sb.id = b_id""",
)
def _(spark, sf_dir):
    def tracks(df, key, name):
        v, f = F.floor(F.col("case_id") / 320).alias("video_id"), (F.floor(F.col("case_id") / 32) % 10).alias("frame")
        g = df.groupBy(v, f, F.col(key).alias(name)).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        return g.select("video_id", "frame", name, corners().alias("box"))

    got = match.track_iou(tracks(shapes(spark, sf_dir), "line", "a_id"), tracks(preds(spark, sf_dir), "pred_id", "b_id"), ["video_id"])
    return got.withColumn("iou", F.round("iou", 6))


@register(
    "recent_occlusion",
    f"""{WITH}, o AS (SELECT *, score % 7 - 1 AS last FROM shapes),
        p AS (SELECT a.case_id, CASE WHEN a.last > b.last AND b.last > -1 THEN a.shape_id WHEN b.last > a.last AND a.last > -1 THEN b.shape_id END AS object_id
              FROM o a JOIN o b ON a.case_id = b.case_id AND a.shape_id < b.shape_id AND 10 * {INTER} >= 3 * ({AREA_A} + {AREA_B} - {INTER}))
        SELECT DISTINCT case_id, object_id FROM p WHERE object_id IS NOT NULL""",
)
def _(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("case_id", F.col("shape_id").alias("object_id"), "box", (F.col("score") % 7 - 1).alias("last_occluded"))
    return match.occlusion_suppressed(s, ["case_id"], 0.3)


@register(
    "nearest_cond_frames",
    f"""{WITH}, c AS (SELECT track_id, frame AS cond FROM frames WHERE miss), t AS (SELECT track_id, frame FROM frames),
        p AS (SELECT t.track_id, t.frame, c.cond, max(CASE WHEN cond < frame THEN cond END) OVER w AS before, min(CASE WHEN cond >= frame THEN cond END) OVER w AS after
              FROM t JOIN c USING (track_id) WINDOW w AS (PARTITION BY t.track_id, t.frame)),
        r AS (SELECT track_id, frame, cond, row_number() OVER (PARTITION BY track_id, frame ORDER BY CASE WHEN cond = before OR cond = after THEN 0 ELSE 1 END, abs(cond - frame), cond) AS rank FROM p)
        SELECT * FROM r WHERE rank <= 4""",
)
def _(spark, sf_dir):
    f = frames(spark, sf_dir)
    return match.nearest_frames(f.select("track_id", "frame"), f.where("miss").select("track_id", F.col("frame").alias("cond")), ["track_id"], 4)


CONF = f"""{WITH}, c AS (SELECT case_id, count(*) FILTER (WHERE is_error AND {{vote}}) tp, count(*) FILTER (WHERE NOT is_error AND NOT {{vote}}) tn, count(*) FILTER (WHERE NOT is_error AND {{vote}}) fp, count(*) FILTER (WHERE is_error AND NOT {{vote}}) fn FROM shapes GROUP BY case_id),
    q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM c)"""
JSON_CONF, FEATURE_CONF = (CONF.replace("{vote}", v) for v in ("json_vote", "feature_vote"))


@register("confusion_by_case", f"{JSON_CONF} SELECT case_id, tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM q")
def _(spark, sf_dir):
    got = metrics.confusion(shapes(spark, sf_dir), ["case_id"], "is_error", "json_vote")
    return got.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@register("feature_confusion", f"{FEATURE_CONF} SELECT case_id, tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM q")
def _(spark, sf_dir):
    got = metrics.confusion(shapes(spark, sf_dir), ["case_id"], "is_error", "feature_vote")
    return got.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@register(
    "model_confusion",
    f"""{MATCHED}, t AS (SELECT s.case_id, s.is_error AS c, EXISTS (SELECT 1 FROM m WHERE m.case_id = s.case_id AND m.shape_id = s.shape_id) AS hit FROM shapes s)
        SELECT case_id, count(*) FILTER (WHERE hit AND c) tp, count(*) FILTER (WHERE hit AND NOT c) tn, count(*) FILTER (WHERE NOT hit AND NOT c) fp, count(*) FILTER (WHERE NOT hit AND c) fn FROM t GROUP BY case_id""",
)
def _(spark, sf_dir):
    _, _, m = _matched(spark, sf_dir)
    hits = m.select("case_id", "shape_id").distinct().withColumn("hit", F.lit(True))
    rows = shapes(spark, sf_dir).join(hits, ["case_id", "shape_id"], "left").na.fill({"hit": False})
    return metrics.model_confusion(rows, ["case_id"], "hit", "is_error").drop("precision", "recall")


@register("macro_pr_nonzero", f"{JSON_CONF} SELECT round(coalesce(avg(precision) FILTER (WHERE precision > 0), 0), 6) AS precision, round(coalesce(avg(recall) FILTER (WHERE recall > 0), 0), 6) AS recall FROM q")
def _(spark, sf_dir):
    got = metrics.macro(metrics.confusion(shapes(spark, sf_dir), ["case_id"], "is_error", "json_vote"), True)
    return got.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("macro_pr_all", f"{JSON_CONF} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM q")
def _(spark, sf_dir):
    got = metrics.macro(metrics.confusion(shapes(spark, sf_dir), ["case_id"], "is_error", "json_vote"), False)
    return got.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


VOTES = ("json_vote", "feature_vote", "model_vote")


def _findings(s: DataFrame) -> DataFrame:
    """False positives and negatives of three validators; every seventh shape has no id."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("validator"), F.col(v).alias("vote")) for v in VOTES])).alias("v")
    rows = s.select("case_id", "shape_id", "is_error", each).where("is_error <> v.vote")
    return rows.select("case_id", "v.validator", F.when(F.col("v.vote"), "fp").otherwise("fn").alias("kind"), F.when(F.col("shape_id") % 7 != 0, F.col("shape_id")).alias("id"))


FIND = f"""{WITH}, v AS ({' UNION ALL '.join(f"SELECT case_id, shape_id, is_error, '{v}' AS validator, {v} AS vote FROM shapes" for v in VOTES)}),
    f AS (SELECT case_id, validator, CASE WHEN vote THEN 'fp' ELSE 'fn' END AS kind, CASE WHEN shape_id % 7 <> 0 THEN shape_id END AS id FROM v WHERE is_error <> vote),
    p AS (SELECT case_id, count(*) FILTER (WHERE is_error) AS pos, count(*) FILTER (WHERE NOT is_error) AS neg FROM shapes GROUP BY case_id),
    u AS (SELECT case_id, count(DISTINCT id) + count(*) FILTER (WHERE id IS NULL) AS fp FROM f WHERE kind = 'fp' GROUP BY case_id),
    i AS (SELECT case_id, count(*) AS fn FROM (SELECT case_id, id FROM f WHERE kind = 'fn' GROUP BY case_id, id HAVING count(DISTINCT validator) = 3) GROUP BY case_id),
    h AS (SELECT p.case_id, greatest(pos - coalesce(fn, 0), 0) AS tp, greatest(neg - coalesce(fp, 0), 0) AS tn, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM p LEFT JOIN u USING (case_id) LEFT JOIN i USING (case_id))"""


@register("hybrid_metrics", f"{FIND} SELECT case_id, tp, tn, fp, fn, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall FROM h")
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    counts = s.groupBy("case_id").agg(F.count_if("is_error").alias("positives"), F.count_if(~F.col("is_error")).alias("negatives"))
    got = metrics.hybrid(_findings(s), counts, ["case_id"], 3)
    return got.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@register("hybrid_union_fp", f"{FIND} SELECT case_id, fp FROM u")
def _(spark, sf_dir):
    f = _findings(shapes(spark, sf_dir)).where("kind = 'fp'")
    return f.groupBy("case_id").agg((F.count_distinct("id") + F.count_if(F.col("id").isNull())).alias("fp"))


@register("hybrid_intersect_fn", f"{FIND} SELECT case_id, fn FROM i")
def _(spark, sf_dir):
    f = _findings(shapes(spark, sf_dir)).where("kind = 'fn'")
    return f.groupBy("case_id", "id").agg(F.count_distinct("validator").alias("n")).where("n = 3").groupBy("case_id").agg(F.count("*").alias("fn"))


@register(
    "merge_issue_reasons",
    f"""{WITH}, i AS (SELECT case_id, shape_id AS id, 1 AS p, 'json' AS reason, 'j' || shape_id AS image FROM shapes WHERE json_vote
          UNION ALL SELECT case_id, shape_id, 2, 'feature', 'f' || shape_id FROM shapes WHERE feature_vote
          UNION ALL SELECT case_id, shape_id, 0, 'model', 'm' || shape_id FROM shapes WHERE model_vote)
        SELECT case_id, id, string_agg(reason, '; ' ORDER BY p) AS reason, arg_max(image, p) AS image, count(*) AS n FROM i GROUP BY case_id, id""",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    parts = [("model_vote", "model", "m"), ("json_vote", "json", "j"), ("feature_vote", "feature", "f")]
    issues = None
    for vote, name, letter in parts:
        one = s.where(vote).select("case_id", F.col("shape_id").alias("id"), F.lit(name).alias("validator"), F.lit(1).alias("seq"), F.lit(name).alias("reason"), F.concat(F.lit(letter), F.col("shape_id").cast("string")).alias("image"))
        issues = one if issues is None else issues.unionByName(one)
    return metrics.merge_reasons(issues, ["case_id"], [n for _, n, _ in parts])


@register(
    "hybrid_summary",
    f"{FIND} SELECT count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(tp / (tp + fp + 1e-8)), 6) AS precision, round(avg(tp / (tp + fn + 1e-8)), 6) AS recall FROM h",
)
def hybrid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three validators merged by case, then averaged over all cases."""
    s = shapes(spark, sf_dir)
    counts = s.groupBy("case_id").agg(F.count_if("is_error").alias("positives"), F.count_if(~F.col("is_error")).alias("negatives"))
    h = metrics.hybrid(_findings(s), counts, ["case_id"], 3)
    return h.agg(
        F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall")
    )


@register(
    "topk_dets",
    f"{WITH}, r AS (SELECT case_id, pred_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pred_id) AS k FROM preds) SELECT case_id, pred_id FROM r WHERE k <= 3",
)
def _(spark, sf_dir):
    return match.top_k(preds(spark, sf_dir), ["case_id"], [F.desc("score"), "pred_id"], 3).select("case_id", "pred_id")


@register(
    "dedup_gather",
    f"{WITH}, p AS (SELECT case_id, line, shape_id, shape_id % 3 AS rank FROM shapes) SELECT case_id, line, shape_id FROM (SELECT *, min(rank) OVER (PARTITION BY case_id, line) m FROM p) WHERE rank = m",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir).withColumn("rank", F.col("shape_id") % 3)
    return match.unique_groups(s, ["case_id", "line"], "rank").select("case_id", "line", "shape_id")


@register(
    "mode_shape_type",
    f"""{WITH}, c AS (SELECT case_id, line % 3 AS kind, count(*) AS n, min(shape_id) AS f FROM shapes GROUP BY ALL)
        SELECT case_id, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, f) k FROM c) WHERE k = 1""",
)
def _(spark, sf_dir):
    return metrics.most_frequent(shapes(spark, sf_dir).withColumn("kind", F.col("line") % 3), ["case_id"], "kind", "shape_id")


@register(
    "feature_stats",
    f"""{WITH} SELECT line, round(avg((x1-x0)*(y1-y0)), 4) AS mean, round(stddev_pop((x1-x0)*(y1-y0)), 4) AS std, CAST(sum((x1-x0)*(y1-y0)) AS BIGINT) AS total, median(CAST(y1 - y0 AS DOUBLE)) AS median FROM shapes GROUP BY line""",
)
def _(spark, sf_dir):
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return shapes(spark, sf_dir).groupBy("line").agg(F.round(F.avg(a), 4).alias("mean"), F.round(F.stddev_pop(a), 4).alias("std"), F.sum(a).alias("total"), F.median((F.col("y1") - F.col("y0")).cast("double")).alias("median"))


@register(
    "feature_hist",
    f"{WITH} SELECT is_error, CAST(least(greatest(floor((x1 - x0) / 100.0 * 30) + 1, 1), 30) AS BIGINT) AS bucket, count(*) AS n FROM shapes GROUP BY ALL",
)
def _(spark, sf_dir):
    return metrics.histogram(shapes(spark, sf_dir).withColumn("w", F.col("x1") - F.col("x0")), ["is_error"], "w", 0, 100)


@register(
    "cosine_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
        s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-10) AS sim FROM q, embeddings)
        SELECT query_id, vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) r FROM s) WHERE r <= 10""",
)
def _(spark, sf_dir):
    from ..operators.recommend import nearest

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(q, e.select("vec_id", "embedding"), "query_id", "vec_id", 10).select("query_id", "vec_id", F.round("sim", 6).alias("sim"))


@register(
    "centre_similarity",
    f"""{WITH} SELECT s.case_id, s.shape_id, p.pred_id, round(greatest(0, 1 - sqrt(((s.x0 + s.x1) / 2.0 - (p.x0 + p.x1) / 2.0) ** 2 + ((s.y0 + s.y1) / 2.0 - (p.y0 + p.y1) / 2.0) ** 2) / 40.0), 6) AS sim,
        (s.x0 + s.x1) / 2.0 - p.x0 AS left, p.y1 - (s.y0 + s.y1) / 2.0 AS bottom FROM shapes s JOIN preds p USING (case_id)""",
)
def _(spark, sf_dir):
    s, p = _shapes(spark, sf_dir).select("case_id", "shape_id", F.col("box").alias("a")), _preds(spark, sf_dir).select("case_id", "pred_id", F.col("box").alias("b"))
    a, b = F.col("a"), F.col("b")
    far = B.to_points(b, (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2)
    return s.join(p, "case_id").select("case_id", "shape_id", "pred_id", F.round(B.centre_similarity(a, b, 40.0), 6).alias("sim"), far["left"].alias("left"), far["bottom"].alias("bottom"))
