"""Frame-ordered state of tracked objects, over whole histories; `annolyte.streaming` has it as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confirmed(hits: DataFrame, track: str = "track_id", frame: str = "frame", hit: str = "hit", need: int = 3) -> DataFrame:
    """Adds streak (hits in a row, 0 on a miss) and is_confirmed (from the first streak of `need` on, for good)."""
    w = Window.partitionBy(track).orderBy(frame)
    island = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w)
    rows = hits.withColumn("_island", island)
    run = F.sum(F.when(F.col(hit), 1).otherwise(0)).over(Window.partitionBy(track, "_island").orderBy(frame))
    rows = rows.withColumn("streak", run.cast("long"))
    return rows.withColumn("is_confirmed", F.max(F.col("streak") >= need).over(w)).drop("_island")


def _fold_keep_alive(start: int, low: int, high: int):
    return lambda s, h: F.least(F.greatest(s + F.when(h, 1).otherwise(-1), F.lit(low)), F.lit(high))


def keep_alive(hits: DataFrame, track: str = "track_id", frame: str = "frame", hit: str = "hit", start: int = 0, low: int = -4, high: int = 8) -> DataFrame:
    """The keep-alive counter after the last frame: up on a hit, down on a miss, within bounds at each step (I4)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(frame, F.col(hit).alias("h")))), lambda s: s["h"])
    return hits.groupBy(track).agg(ordered.alias("_h")).select(track, F.aggregate("_h", F.lit(start), _fold_keep_alive(start, low, high)).cast("long").alias("alive"), F.size("_h").cast("long").alias("frames"))


def hotstart_removed(hits: DataFrame, delay: int = 15, unmatched: int = 8, track: str = "track_id", frame: str = "frame", hit: str = "hit") -> DataFrame:
    """Tracks with `unmatched` misses while younger than `delay` frames, and the frame they are removed at."""
    w = Window.partitionBy(track)
    rows = hits.withColumns({"_first": F.min(frame).over(w), "_miss": F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w.orderBy(frame))})
    gone = rows.where((F.col("_miss") >= unmatched) & (F.col("_first") > F.col(frame) - delay))
    return gone.groupBy(track).agg(F.min(frame).alias("removed_at"))


def held_back(frames: DataFrame, delay: int, video: str = "video_id", frame: str = "frame") -> DataFrame:
    """When each frame's output is emitted: with the frame `delay` - 1 later, or all at the end."""
    last = F.max(frame).over(Window.partitionBy(video))
    return frames.withColumn("emitted_at", F.least(F.col(frame) + delay - 1, last))


def last_occluded(rows: DataFrame, track: str = "track_id", frame: str = "frame", occluded: str = "occluded") -> DataFrame:
    """Adds the last frame so far at which the object was occluded, -1 for never."""
    w = Window.partitionBy(track).orderBy(frame)
    return rows.withColumn("last_occluded", F.coalesce(F.last(F.when(F.col(occluded), F.col(frame)), ignorenulls=True).over(w), F.lit(-1)))


def action_plan(log: DataFrame, session: str = "session", step: str = "step", action: str = "action") -> DataFrame:
    """What the last propagation request of a log needs: full, partial or fetch.

    full if nothing was propagated before or objects were added since; partial if only
    prompts were refined or objects removed since; fetch if nothing changed. Actions: propagate, add, refine, remove.
    """
    w = Window.partitionBy(session).orderBy(step)
    before = F.last(F.when(F.col(action) == "propagate", F.col(step)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("_before", before)
    ends = rows.where(F.col(action) == "propagate").groupBy(session).agg(F.max_by(F.struct(F.col(step).alias("s"), F.col("_before").alias("b")), step).alias("e"))
    since = log.join(ends, session).where((F.col(step) < F.col("e.s")) & (F.col(step) > F.coalesce("e.b", F.lit(-1))))
    seen = since.groupBy(session).agg(F.count_if(F.col(action) == "add").alias("adds"), F.count("*").alias("n"))
    out = ends.join(seen, session, "left").na.fill(0, ["adds", "n"])
    plan = F.when(F.col("e.b").isNull() | (F.col("adds") > 0), "full").when(F.col("n") > 0, "partial").otherwise("fetch")
    return out.select(session, plan.alias("plan"))


def processing_order(prompts: DataFrame, n_frames: int, video: str = "video_id", frame: str = "frame", reverse: bool = False) -> DataFrame:
    """Frames to process from the earliest prompted one on; backwards from the one before it."""
    first = prompts.groupBy(video).agg(F.min(frame).alias("_f"))
    if reverse:
        order = F.when(F.col("_f") > 0, F.sequence(F.col("_f") - 1, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")))
    else:
        order = F.when(F.col("_f") < n_frames, F.sequence(F.col("_f"), F.lit(n_frames - 1).cast("bigint")))
    return first.select(video, F.posexplode(order).alias("place", frame)).withColumn("place", F.col("place").cast("long"))
