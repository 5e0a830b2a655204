"""Queries of tracker state over frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as T
from .registry import register
from .virtual import WITH, frames, shapes


def _hits(spark, sf_dir):
    return frames(spark, sf_dir).select("track_id", "frame", (~F.col("miss")).alias("hit"))


STREAK = f"""{WITH}, i AS (SELECT *, sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS island FROM frames),
    s AS (SELECT track_id, frame, CAST(sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, island ORDER BY frame) AS BIGINT) AS streak FROM i)"""


@register("confirm_status", f"{STREAK} SELECT track_id, frame, streak, max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) = 1 AS is_confirmed FROM s")
def _(spark, sf_dir):
    return T.confirmed(_hits(spark, sf_dir)).select("track_id", "frame", "streak", "is_confirmed")


@register(
    "keep_alive",
    f"""{WITH}, k AS (SELECT track_id, frame, least(8, greatest(-4, CASE WHEN miss THEN -1 ELSE 1 END)) AS alive FROM frames WHERE frame = 1
          UNION ALL SELECT f.track_id, f.frame, least(8, greatest(-4, k.alive + CASE WHEN f.miss THEN -1 ELSE 1 END)) FROM k JOIN frames f ON f.track_id = k.track_id AND f.frame = k.frame + 1)
        SELECT track_id, CAST(arg_max(alive, frame) AS BIGINT) AS alive, count(*) AS frames FROM k GROUP BY track_id""",
)
def _(spark, sf_dir):
    return T.keep_alive(_hits(spark, sf_dir))


@register(
    "hotstart_removed",
    f"""{WITH}, m AS (SELECT track_id, frame, min(frame) OVER (PARTITION BY track_id) AS first, sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS misses FROM frames)
        SELECT track_id, min(frame) AS removed_at FROM m WHERE misses >= 3 AND first > frame - 15 GROUP BY track_id""",
)
def _(spark, sf_dir):
    return T.hotstart_removed(_hits(spark, sf_dir), unmatched=3)


@register("holdback_emit", f"{WITH} SELECT track_id AS video_id, frame, least(frame + 14, max(frame) OVER (PARTITION BY track_id)) AS emitted_at FROM frames")
def _(spark, sf_dir):
    return T.held_back(frames(spark, sf_dir).select(F.col("track_id").alias("video_id"), "frame"), 15)


@register(
    "last_occluded",
    f"{WITH} SELECT track_id, frame, coalesce(max(CASE WHEN miss THEN frame END) OVER (PARTITION BY track_id ORDER BY frame), -1) AS last_occluded FROM frames",
)
def _(spark, sf_dir):
    return T.last_occluded(frames(spark, sf_dir).withColumnRenamed("miss", "occluded")).select("track_id", "frame", "last_occluded")


ACTION = "CASE WHEN {t} IN ('purchase') THEN 'propagate' WHEN {t} = 'signup' THEN 'add' WHEN {t} = 'click' THEN 'refine' WHEN {t} = 'error' THEN 'remove' ELSE 'look' END"


@register(
    "action_plan",
    f"""{WITH}, l AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, {ACTION.format(t='event_type')} AS action FROM events),
        g AS (SELECT * FROM l WHERE action <> 'look'),
        e AS (SELECT session, step, lag(step) OVER (PARTITION BY session ORDER BY step) AS prev, row_number() OVER (PARTITION BY session ORDER BY step DESC) AS r FROM g WHERE action = 'propagate'),
        z AS (SELECT e.session, e.prev, count(g.step) AS n, count(*) FILTER (WHERE g.action = 'add') AS adds FROM e LEFT JOIN g ON g.session = e.session AND g.step < e.step AND g.step > coalesce(e.prev, -1) WHERE r = 1 GROUP BY ALL)
        SELECT session, CASE WHEN prev IS NULL OR adds > 0 THEN 'full' WHEN n > 0 THEN 'partial' ELSE 'fetch' END AS plan FROM z""",
)
def _(spark, sf_dir):
    from .registry import table

    log = spark.sql(
        f"SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, {ACTION.format(t='event_type')} AS action FROM {{events}}", events=table(spark, sf_dir, "events")
    ).where("action <> 'look'")
    return T.action_plan(log)


@register(
    "processing_order",
    f"""{WITH}, f AS (SELECT case_id AS video_id, min(shape_id + score % 5) AS first FROM shapes GROUP BY ALL)
        SELECT video_id, CAST(g - first AS BIGINT) AS place, CAST(g AS BIGINT) AS frame FROM f, range(0, 8) t(g) WHERE g >= first""",
)
def _(spark, sf_dir):
    p = shapes(spark, sf_dir).select(F.col("case_id").alias("video_id"), (F.col("shape_id") + F.col("score") % 5).alias("frame"))
    return T.processing_order(p, 8)
