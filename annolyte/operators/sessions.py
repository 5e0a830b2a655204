"""Planning, removal and output of tracked objects, as set operations over whole videos.

Each function takes and returns plain tables keyed by video (`by`), frame and object, so a frame's plan is a join and a
window instead of a loop over workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracking import processing_order


def duplicates(matches: DataFrame, by: str = "video_id", delay: int = 15, most: int = 8, reverse: bool = False) -> DataFrame:
    """Tracks that share their detection with one that appeared earlier, `most` frames long, while younger than `delay` frames.

    matches: by, frame, det_id, track_id. Of the tracks of a detection the first to appear leads (of equals the least id); each other
    one forms a pair with it. Returns by, track_id, removed_at: the frame at which a pair's count reaches `most` within the delay.
    reverse: the video is played backwards, so the last frame comes first.
    """
    frame = -F.col("frame") if reverse else F.col("frame")
    m = matches.select(by, "det_id", "track_id", frame.alias("_f")).distinct()
    first = m.groupBy(by, "track_id").agg(F.min("_f").alias("_first"))
    m = m.join(first, [by, "track_id"])
    lead = m.groupBy(by, "_f", "det_id").agg(F.min_by("track_id", F.struct("_first", "track_id")).alias("_lead"))
    pair = m.join(lead, [by, "_f", "det_id"]).where("track_id <> _lead")
    count = F.count("*").over(Window.partitionBy(by, "track_id", "_lead").orderBy("_f"))
    gone = pair.withColumn("_n", count).where((F.col("_n") >= most) & (F.col("_first") > F.col("_f") - delay))
    at = -F.min("_f") if reverse else F.min("_f")
    return gone.groupBy(by, "track_id").agg(at.alias("removed_at"))


def removed_first(*removals: DataFrame, by: list[str]) -> DataFrame:
    """The first removal of each object by any rule."""
    rows = removals[0]
    for r in removals[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy(*by).agg(F.min("removed_at").alias("removed_at"))


def assigned(new: DataFrame, loads: DataFrame, by: str = "video_id", order: str = "det_id", worker: str = "worker", turn: str | None = None) -> DataFrame:
    """New objects, in order, each to the least loaded worker at its turn; of equals the first (I7). turn: a column for the turn, from 1.

    loads: by, worker, load. A worker of load n has places n, n + 1, ...; the i-th object takes the i-th place of all workers by
    (place, worker), which is what one choice after another comes to.
    """
    ranked = new.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    n = new.groupBy(by).agg(F.count("*").cast("int").alias("_n"))
    places = loads.join(n, by).select(by, worker, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"), "load")
    places = places.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(F.col("load") + F.col("_k"), worker))).select(by, "_i", worker)
    out = ranked.join(places, [by, "_i"], "left")
    return out.withColumnRenamed("_i", turn) if turn else out.drop("_i")


def update_plan(dets: DataFrame, known: DataFrame, loads: DataFrame, removed: DataFrame, by: str = "video_id", most: int | None = None) -> DataFrame:
    """What a frame changes, a row for each object: by, action (add, remove, keep), object_id, det_id, worker.

    dets: by, det_id, score, is_new; known: by, object_id, worker; removed: by, object_id. New detections get ids above all known ones in the
    order of det_id, ids of removed objects are not used again; only as many of the best score are added as `most` objects allow.
    """
    live = known.join(removed, [by, "object_id"], "left_anti")
    new = dets.where("is_new")
    if most is not None:
        held = live.groupBy(by).agg(F.count("*").alias("_held"))
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "det_id"))
        new = new.join(held, by, "left").withColumn("_r", rank).where(F.col("_r") <= F.lit(most) - F.coalesce("_held", F.lit(0))).drop("_r", "_held")
    top = known.groupBy(by).agg(F.max("object_id").alias("_top"))
    # One numbering gives both id and worker: of rows with one det_id, a second could take another order.
    added = assigned(new, loads, by, turn="_turn").join(top, by, "left").withColumn("object_id", F.coalesce("_top", F.lit(-1)) + F.col("_turn"))
    none = F.lit(None).cast("bigint")
    return (
        added.select(by, F.lit("add").alias("action"), "object_id", "det_id", "worker")
        .unionByName(known.join(removed, [by, "object_id"], "left_semi").select(by, F.lit("remove").alias("action"), "object_id", none.alias("det_id"), "worker"))
        .unionByName(live.select(by, F.lit("keep").alias("action"), "object_id", none.alias("det_id"), "worker"))
    )


def without_objects(objects: DataFrame, cached: DataFrame, removed: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, cached outputs and the number of objects a worker has left, after a removal (I16). by: video and object."""
    left = objects.join(removed, by, "left_anti")
    loads = objects.select(by[0], "worker").distinct().join(left.groupBy(by[0], "worker").agg(F.count("*").alias("load")), [by[0], "worker"], "left").na.fill(0, ["load"])
    return left, cached.join(removed, by, "left_anti"), loads


def emitted(outputs: DataFrame, lengths: DataFrame, removed: DataFrame, suppressed: DataFrame, unconfirmed: DataFrame, delay: int, need: int, by: str = "video_id") -> DataFrame:
    """Outputs as they are emitted after being held back (I13): the rows of outputs that stay, with emitted_at.

    A frame comes out with the frame `delay` - 1 later, or with the last. An object goes from it if it was removed by then, if it is
    suppressed on the frame, or if it is unconfirmed on the frame `need` - 1 later, which ends at the video's last.
    outputs: by, frame, object_id; lengths: by, n_frames; removed: by, object_id, removed_at; suppressed, unconfirmed: by, frame, object_id.
    """
    last = F.col("n_frames") - 1
    rows = outputs.join(lengths, by).withColumns({"emitted_at": F.least(F.col("frame") + max(delay, 1) - 1, last), "_status": F.least(F.col("frame") + need - 1, last)})
    rows = rows.join(removed, [by, "object_id"], "left").where(F.col("removed_at").isNull() | (F.col("removed_at") > F.col("emitted_at")))
    rows = rows.join(suppressed.select(by, "frame", "object_id"), [by, "frame", "object_id"], "left_anti")
    rows = rows.join(unconfirmed.select(by, F.col("frame").alias("_status"), "object_id"), [by, "_status", "object_id"], "left_anti")
    return rows.drop("removed_at", "n_frames", "_status")


def frame_outputs(propagated: DataFrame, added: DataFrame, by: list[str]) -> DataFrame:
    """Propagated objects and new ones of a frame; a new one's output counts where both have it."""
    return propagated.join(added.select(*by), by, "left_anti").unionByName(added)


def for_evaluator(outputs: DataFrame, objects: DataFrame, lengths: DataFrame, by: str = "video_id", value: str = "area") -> DataFrame:
    """A row for each object and frame of its video, with 0 where the object has no output."""
    spine = objects.join(lengths, by).select(by, "object_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame"))
    return spine.join(outputs.select(by, "object_id", "frame", value), [by, "object_id", "frame"], "left").na.fill(0, [value])


class Sessions:
    """Sessions over videos: start, prompt, remove, propagate, reset, close (I10). State is what was asked for; frames stay tables."""

    def __init__(self):
        self.open: dict[str, dict] = {}

    def start(self, session: str, n_frames: int) -> str:
        if session in self.open:
            raise ValueError(f"session {session} is open")
        self.open[session] = {"n_frames": n_frames, "prompts": [], "removed": set()}
        return session

    def _of(self, session: str) -> dict:
        if session not in self.open:
            raise KeyError(f"no session {session}")
        return self.open[session]

    def prompt(self, session: str, frame: int, object_id: int) -> None:
        state = self._of(session)
        if not 0 <= frame < state["n_frames"]:
            raise ValueError(f"frame {frame} is not in the video")
        state["removed"].discard(object_id)
        state["prompts"].append((frame, object_id))

    def remove(self, session: str, object_id: int) -> None:
        self._of(session)["removed"].add(object_id)

    def reset(self, session: str) -> None:
        self._of(session).update(prompts=[], removed=set())

    def close(self, session: str) -> None:
        self.open.pop(session, None)

    def propagate(self, spark, session: str, direction: str = "both") -> DataFrame:
        """pass, place, frame, object_id: frames in the order they are processed, forwards from the first prompt, then backwards from the one before it."""
        if direction not in ("forward", "backward", "both"):
            raise ValueError(f"no direction {direction}")
        state = self._of(session)
        live = [(session, f, o) for f, o in state["prompts"] if o not in state["removed"]]
        prompts = spark.createDataFrame(live, "video_id string, frame bigint, object_id bigint")
        objects = prompts.select("video_id", "object_id").distinct()
        passes = [d for d in ("forward", "backward") if direction in (d, "both")]
        made = [processing_order(prompts, state["n_frames"], reverse=d == "backward").withColumn("pass", F.lit(d)) for d in passes]
        rows = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        return rows.join(objects, "video_id").select("pass", "place", "frame", "object_id")
