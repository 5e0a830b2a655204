"""Queries of planning, removal and output of tracked objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from .registry import register
from .virtual import WITH, preds, shapes

#: A video for each ten images; a line is a track, places of 25 pixels are detections.
VIDEO, FRAME = "case_id // 320", "(case_id // 32) % 10"
V, R = (lambda: F.floor(F.col("case_id") / 320)), (lambda: F.floor(F.col("case_id") / 32) % 10)
MATCHES = f"SELECT DISTINCT {VIDEO} AS video_id, {FRAME} AS frame, line AS track_id, x0 // 25 AS det_id FROM shapes"


def _matches(spark, sf_dir):
    return shapes(spark, sf_dir).select(V().alias("video_id"), R().alias("frame"), F.col("line").alias("track_id"), F.floor(F.col("x0") / 25).alias("det_id")).distinct()


DUPLICATES = f"""m AS ({MATCHES}), f AS (SELECT video_id, track_id, min(frame) AS first FROM m GROUP BY ALL), j AS (SELECT m.*, first FROM m JOIN f USING (video_id, track_id)),
    l AS (SELECT video_id, frame, det_id, arg_min(track_id, first * 1000 + track_id) AS lead FROM j GROUP BY ALL),
    c AS (SELECT j.video_id, j.track_id, j.frame, first, count(*) OVER (PARTITION BY j.video_id, j.track_id, lead ORDER BY j.frame) AS n FROM j JOIN l USING (video_id, frame, det_id) WHERE j.track_id <> lead),
    gone AS (SELECT video_id, track_id, min(frame) AS removed_at FROM c WHERE n >= 2 AND first > frame - 5 GROUP BY ALL)"""


@register("hotstart_duplicates", f"{WITH}, {DUPLICATES} SELECT video_id, track_id, removed_at FROM gone")
def _(spark, sf_dir):
    return S.duplicates(_matches(spark, sf_dir), delay=5, most=2)


@register(
    "holdback_outputs",
    f"""{WITH}, {DUPLICATES}, o AS (SELECT DISTINCT video_id, frame, track_id FROM m), n AS (SELECT video_id, max(frame) + 1 AS n_frames FROM m GROUP BY ALL),
        s AS (SELECT DISTINCT {VIDEO} AS video_id, {FRAME} AS frame, line AS track_id FROM shapes WHERE score % 10 = 0), u AS (SELECT DISTINCT {VIDEO} AS video_id, {FRAME} AS frame, line AS track_id FROM shapes WHERE score % 10 = 1),
        e AS (SELECT o.*, least(frame + 3, n_frames - 1) AS emitted_at, least(frame + 2, n_frames - 1) AS status FROM o JOIN n USING (video_id))
        SELECT e.video_id, e.frame, e.track_id AS object_id, emitted_at FROM e LEFT JOIN gone g ON g.video_id = e.video_id AND g.track_id = e.track_id WHERE (removed_at IS NULL OR removed_at > emitted_at)
          AND NOT EXISTS (SELECT 1 FROM s WHERE s.video_id = e.video_id AND s.frame = e.frame AND s.track_id = e.track_id) AND NOT EXISTS (SELECT 1 FROM u WHERE u.video_id = e.video_id AND u.frame = e.status AND u.track_id = e.track_id)""",
)
def _(spark, sf_dir):
    m = _matches(spark, sf_dir)
    out = m.select("video_id", "frame", F.col("track_id").alias("object_id")).distinct()
    lengths = m.groupBy("video_id").agg((F.max("frame") + 1).alias("n_frames"))
    flagged = lambda k: shapes(spark, sf_dir).where(F.col("score") % 10 == k).select(V().alias("video_id"), R().alias("frame"), F.col("line").alias("object_id")).distinct()
    gone = S.removed_first(S.duplicates(m, delay=5, most=2).withColumnRenamed("track_id", "object_id"), by=["video_id", "object_id"])
    return S.emitted(out, lengths, gone, flagged(0), flagged(1), delay=4, need=3).select("video_id", "frame", "object_id", "emitted_at")


#: The last image of a video is the frame planned for: its predictions are detections, new where the id is odd; lines 1 to 3 are known objects of two workers.
STATE = f"""d AS (SELECT {VIDEO} AS video_id, case_id * 10 + pred_id AS det_id, score, pred_id % 2 = 1 AS is_new FROM preds WHERE {FRAME} = 9),
    k AS (SELECT DISTINCT {VIDEO} AS video_id, line AS object_id, line % 2 AS worker FROM shapes WHERE line <= 3),
    r AS (SELECT DISTINCT {VIDEO} AS video_id, line AS object_id FROM shapes WHERE line <= 3 AND score % 50 = 7), live AS (SELECT * FROM k ANTI JOIN r USING (video_id, object_id)),
    w AS (SELECT v.video_id, x.worker, count(l.object_id) AS load FROM (SELECT DISTINCT video_id FROM k) v CROSS JOIN (VALUES (0), (1), (2)) x(worker) LEFT JOIN live l ON l.video_id = v.video_id AND l.worker = x.worker GROUP BY ALL)"""


def _state(spark, sf_dir):
    s, p = shapes(spark, sf_dir), preds(spark, sf_dir)
    d = p.where(R() == 9).select(V().alias("video_id"), (F.col("case_id") * 10 + F.col("pred_id")).alias("det_id"), "score", (F.col("pred_id") % 2 == 1).alias("is_new"))
    mine = s.where("line <= 3").withColumn("video_id", V())
    k = mine.select("video_id", F.col("line").alias("object_id"), (F.col("line") % 2).alias("worker")).distinct()
    r = mine.where(F.col("score") % 50 == 7).select("video_id", F.col("line").alias("object_id")).distinct()
    left, _, _ = S.without_objects(k, k, r, ["video_id", "object_id"])
    loads = k.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("worker")).distinct()
    loads = loads.join(left.groupBy("video_id", "worker").agg(F.count("*").alias("load")), ["video_id", "worker"], "left").na.fill(0, ["load"])
    return d, k, r, loads


@register(
    "update_plan",
    f"""{WITH}, {STATE}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, det_id) AS r FROM d WHERE is_new AND video_id IN (SELECT video_id FROM k)),
        h AS (SELECT video_id, count(*) AS held FROM live GROUP BY ALL), a AS (SELECT n.video_id, det_id, row_number() OVER (PARTITION BY n.video_id ORDER BY det_id) AS i FROM n LEFT JOIN h USING (video_id) WHERE r <= 6 - coalesce(held, 0)),
        p AS (SELECT video_id, worker, row_number() OVER (PARTITION BY video_id ORDER BY load + g, worker) AS i FROM w, range(0, 60) t(g)), top AS (SELECT video_id, max(object_id) AS m FROM k GROUP BY ALL)
        SELECT a.video_id, 'add' AS action, m + a.i AS object_id, det_id, CAST(p.worker AS BIGINT) AS worker FROM a JOIN p USING (video_id, i) JOIN top USING (video_id)
        UNION ALL SELECT video_id, 'remove', object_id, NULL, CAST(worker AS BIGINT) FROM k SEMI JOIN r USING (video_id, object_id) UNION ALL SELECT video_id, 'keep', object_id, NULL, CAST(worker AS BIGINT) FROM live""",
)
def _(spark, sf_dir):
    d, k, r, loads = _state(spark, sf_dir)
    d = d.join(k.select("video_id").distinct(), "video_id", "left_semi")
    return S.update_plan(d, k, loads, r, most=6)


@register(
    "object_removal",
    f"""{WITH}, {STATE}, c AS (SELECT DISTINCT {VIDEO} AS video_id, {FRAME} AS frame, line AS object_id FROM shapes)
        SELECT c.video_id, count(*) AS cached, count(DISTINCT c.object_id) AS objects, coalesce(any_value(load0), 0) AS load0, coalesce(any_value(load1), 0) AS load1
        FROM c ANTI JOIN r USING (video_id, object_id) LEFT JOIN (SELECT video_id, max(load) FILTER (WHERE worker = 0) AS load0, max(load) FILTER (WHERE worker = 1) AS load1 FROM w GROUP BY video_id) l ON l.video_id = c.video_id GROUP BY c.video_id""",
)
def _(spark, sf_dir):
    _, k, r, _ = _state(spark, sf_dir)
    cached = shapes(spark, sf_dir).select(V().alias("video_id"), R().alias("frame"), F.col("line").alias("object_id")).distinct()
    _, cached, loads = S.without_objects(k, cached, r, ["video_id", "object_id"])
    per = loads.groupBy("video_id").agg(*[F.max(F.when(F.col("worker") == i, F.col("load"))).alias(f"load{i}") for i in (0, 1)])
    return cached.groupBy("video_id").agg(F.count("*").alias("cached"), F.count_distinct("object_id").alias("objects")).join(per, "video_id", "left").na.fill(0)


@register(
    "evaluator_export",
    f"""{WITH}, o AS (SELECT {VIDEO} AS video_id, {FRAME} AS frame, line AS object_id, max((x1 - x0) * (y1 - y0)) AS area FROM shapes GROUP BY ALL),
        n AS (SELECT {VIDEO} AS video_id, line AS object_id, {FRAME} AS frame, max(score) AS area FROM shapes WHERE score > 80 GROUP BY ALL), a AS (SELECT o.video_id, o.frame, o.object_id, coalesce(n.area, o.area) AS area FROM o LEFT JOIN n USING (video_id, frame, object_id)),
        s AS (SELECT DISTINCT o.video_id, o.object_id, CAST(g AS BIGINT) AS frame FROM o, range(0, 10) t(g)) SELECT s.video_id, s.object_id, s.frame, coalesce(area, 0) AS area FROM s LEFT JOIN a USING (video_id, object_id, frame)""",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir).select(V().alias("video_id"), R().alias("frame"), F.col("line").alias("object_id"), "score", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("size"))
    by = ["video_id", "frame", "object_id"]
    out = S.frame_outputs(s.groupBy(*by).agg(F.max("size").alias("area")), s.where("score > 80").groupBy(*by).agg(F.max("score").alias("area")), by)
    return S.for_evaluator(out, s.select("video_id", "object_id").distinct(), s.select("video_id").distinct().withColumn("n_frames", F.lit(10).cast("bigint")))
