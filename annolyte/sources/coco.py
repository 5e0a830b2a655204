"""COCO and YT-VIS data sets as tables, and predictions as rows for their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = "array<struct<id: bigint, file_name: string, width: bigint, height: bigint, text_input: string>>"
ANNOTATIONS = "array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, area: double, iscrowd: bigint, segmentation: variant>>"
CATEGORIES = "array<struct<id: bigint, name: string>>"
VIDEOS = "array<struct<id: bigint, file_names: array<string>, width: bigint, height: bigint>>"
TRACKS = "array<struct<id: bigint, video_id: bigint, category_id: bigint, iscrowd: bigint, score: double, bboxes: array<array<double>>, areas: array<double>, segmentations: array<variant>>>"


def running_ids(rows: DataFrame, by: list[str], group: str, order: list, name: str, start: int = 0) -> DataFrame:
    """Numbers rows in order of group, then order, within by. Rows are numbered within their group; only a count
    for each group goes through one ordered pass, so no task holds all rows."""
    n = rows.groupBy(*by, group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order)) - 1
    return rows.join(n, [*by, group]).withColumn(name, (F.col("_before") + place + start).cast("long")).drop("_before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """dataset (the path), v: the document as VARIANT."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("dataset"), F.try_parse_json("value").alias("v"))


def relation(docs: DataFrame, name: str, kind: str) -> DataFrame:
    return docs.select("dataset", F.inline(F.try_variant_get("v", f"$.{name}", kind)))


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories. A data set may come in several documents, each with some of its images and their
    annotations; categories that several of them list count once."""
    return relation(docs, "images", IMAGES), relation(docs, "annotations", ANNOTATIONS), relation(docs, "categories", CATEGORIES).distinct()


def by_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images in order of id with their annotations, those without any too."""
    a = annotations.groupBy("dataset", F.col("image_id").alias("id")).agg(F.collect_list(F.struct("id", "category_id", "bbox", "area", "iscrowd")).alias("annotations"))
    out = images.join(a, ["dataset", "id"], "left")
    empty = F.array().cast("array<struct<id: bigint, category_id: bigint, bbox: array<double>, area: double, iscrowd: bigint>>")
    return out.withColumn("annotations", F.coalesce(F.array_sort("annotations"), empty)).orderBy("dataset", "id")


def datapoints(images: DataFrame, annotations: DataFrame, categories: DataFrame, chunk: int, negatives: bool = True) -> DataFrame:
    """A row per image and chunk of categories: queries (category, text, object ids). negatives: categories without objects too.

    The chunks of a data set are a bounded list, joined by data set; annotations join by image and category.
    """
    w = Window.partitionBy("dataset").orderBy("id")
    c = categories.withColumn("_n", F.row_number().over(w) - 1).select("dataset", F.col("id").alias("category_id"), "name", F.floor(F.col("_n") / chunk).cast("long").alias("chunk"))
    objects = annotations.groupBy("dataset", "image_id", "category_id").agg(F.sort_array(F.collect_list("id")).alias("objects"))
    pairs = images.select("dataset", F.col("id").alias("image_id")).join(c, "dataset").join(objects, ["dataset", "image_id", "category_id"], "left" if negatives else "inner")
    q = F.struct("category_id", F.col("name").alias("text"), F.coalesce("objects", F.array().cast("array<bigint>")).alias("objects"))
    return pairs.groupBy("dataset", "image_id", "chunk").agg(F.sort_array(F.collect_list(q)).alias("queries"))


def one_based(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids from 1 in those relations that contain the id 0, and references to them."""

    def shift(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
        flag = to.groupBy("dataset").agg(F.max((F.col("id") == 0).cast("int")).alias("_zero"))
        return rows.join(flag, "dataset", "left").withColumn(column, F.col(column) + F.coalesce("_zero", F.lit(0))).drop("_zero")

    a = shift(shift(shift(annotations, "image_id", images), "category_id", categories), "id", annotations)
    return shift(images, "id", images), a, shift(categories, "id", categories)


def completed(results: DataFrame) -> DataFrame:
    """Result rows with bbox, area and id filled in where they lack: area from the box, ids by a running number in each image's order."""
    r = results.withColumn("area", F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]))
    return running_ids(r, ["dataset"], "image_id", [F.desc("score"), F.to_json("bbox")], "id", 1).withColumn("iscrowd", F.lit(0))


def unknown_images(results: DataFrame, images: DataFrame) -> DataFrame:
    """Result rows of images that the data set lacks: must be none."""
    return results.join(images.select("dataset", F.col("id").alias("image_id")), ["dataset", "image_id"], "left_anti")


def video_frames(videos: DataFrame) -> DataFrame:
    """Images of videos: dataset, id (running), video_id, frame_index, file_name, width, height."""
    f = videos.select("dataset", F.col("id").alias("video_id"), "width", "height", F.posexplode("file_names").alias("frame_index", "file_name"))
    return running_ids(f, ["dataset"], "video_id", ["frame_index"], "id")


def track_annotations(tracks: DataFrame, images: DataFrame, pred: bool = False) -> DataFrame:
    """Per-frame rows of tracks; frames without a box are skipped, and a box on a frame that its video lacks raises an error. pred: also zero boxes, and areas are completed from boxes.

    tracks as TRACKS, images as `video_frames`.
    """
    per = F.posexplode(F.arrays_zip("bboxes", "areas"))
    t = tracks.select("dataset", F.col("id").alias("track_id"), "video_id", "category_id", "iscrowd", "score", per.alias("frame_index", "z"))
    t = t.select("*", F.col("z.bboxes").alias("bbox"), F.col("z.areas").alias("area")).drop("z").where("bbox IS NOT NULL")
    if pred:
        t = t.where(~F.forall("bbox", lambda v: v <= 0)).withColumn("area", F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("bbox")[2] * F.col("bbox")[3]))
    joined = t.join(images.select("dataset", "video_id", "frame_index", F.col("id").alias("image_id")), ["dataset", "video_id", "frame_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no frame "), F.col("frame_index").cast("string"), F.lit(" in video "), F.col("video_id").cast("string"))).cast("bigint")
    joined = joined.withColumn("image_id", F.when(F.col("image_id").isNull(), missing).otherwise(F.col("image_id")))
    return running_ids(joined, ["dataset"], "video_id", ["frame_index", "track_id"], "id")


def prediction_rows(preds: DataFrame) -> DataFrame:
    """For the writer: xywh boxes and scores to five decimals, half to even as Python rounds."""
    return preds.withColumns({"bbox": F.transform("bbox", lambda v: F.bround(v, 5)), "score": F.bround("score", 5)})


def mask_area(counts: Column) -> Column:
    """Pixels of an uncompressed mask: every second run."""
    return F.aggregate(F.transform(counts, lambda c, i: F.when(i % 2 == 1, c).otherwise(0)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def pair_ids(gt: DataFrame, negatives: DataFrame, video: str = "video_id", category: str = "category_id") -> DataFrame:
    """A surrogate id from 1 for each (video, category) of either table."""
    both = gt.select(video, category).union(negatives.select(video, category)).distinct()
    return running_ids(both, [], video, [category], "pair_id", 1)


def detections(spark: SparkSession, path: str, sep: str = ",", time_col: int = 0, id_col: int = 1, crowd_cols: dict[int, list[float]] | None = None, keep: dict[int, list[float]] | None = None) -> DataFrame:
    """Delimited detections: timestep, id, values, is_crowd. keep: by column, the values that rows must have (Q39)."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    cells = F.transform(F.split(F.trim("value"), sep if sep != " " else r"\s+"), lambda v: F.trim(v).try_cast("double"))
    rows = raw.select(cells.alias("values"))
    for column, values in (keep or {}).items():
        rows = rows.where(F.col("values")[column].isin(*values))
    crowd = F.lit(False)
    for column, values in (crowd_cols or {}).items():
        crowd = crowd | F.col("values")[column].isin(*values)
    return rows.select(F.col("values")[time_col].cast("long").alias("timestep"), F.col("values")[id_col].cast("long").alias("id"), "values", crowd.alias("is_crowd"))


def load_results(results: DataFrame, images: DataFrame) -> DataFrame:
    """Result rows completed as `completed` does; rows of images that the data set lacks raise an error."""
    known = images.select("dataset", F.col("id").alias("image_id"), F.lit(True).alias("_known"))
    r = results.join(known, ["dataset", "image_id"], "left")
    error = F.raise_error(F.concat(F.lit("results of an unknown image "), F.col("image_id").cast("string"))).cast("bigint")
    return completed(r.withColumn("image_id", F.when(F.col("_known"), F.col("image_id")).otherwise(error)).drop("_known"))


def track_results(frames: DataFrame, n_frames: DataFrame, per_frame_scores: bool = False) -> DataFrame:
    """video_id, category_id, bboxes (xywh), score, segmentations, areas, one row a track, as the writer of video results has them.

    frames: video_id, track_id, category_id, frame, score, box, area, segmentation; n_frames: video_id, n_frames. Frames without the track have a zero box,
    no segmentation and area 0. Adds per_frame_scores if asked for.
    """
    b = F.col("box")
    one = F.struct(F.array(*[v.cast("double") for v in (b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])]).alias("bbox"), "segmentation", F.coalesce("area", F.lit(0.0)).cast("double").alias("area"))
    t = frames.groupBy("video_id", "track_id").agg(F.max("category_id").alias("category_id"), F.max("score").alias("score"), F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("bigint"), one))).alias("_by"))
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames").cast("bigint") - 1), lambda f: F.try_element_at("_by", f))
    t = t.join(n_frames, "video_id").withColumn("_at", at)
    zero = F.array(*[F.lit(0.0)] * 4)
    out = t.select(
        "video_id", "track_id", "category_id", F.transform("_at", lambda x: F.coalesce(x["bbox"], zero)).alias("bboxes"), "score",
        F.transform("_at", lambda x: x["segmentation"]).alias("segmentations"), F.transform("_at", lambda x: F.coalesce(x["area"], F.lit(0.0))).alias("areas"),
    )
    return out.withColumn("per_frame_scores", F.array_repeat("score", F.size("areas"))) if per_frame_scores else out


def dialect(spark: SparkSession, path: str, among: str = ",;\t| ") -> str:
    """The sign that parts columns: of those that cut the first lines into equally many columns the one that makes most (A10)."""
    lines = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(20).collect()]
    cut = {c: {len(x.strip().split(c)) for x in lines} for c in among}
    fits = [(min(n), -among.index(c), c) for c, n in cut.items() if len(n) == 1 and min(n) > 1]
    return max(fits)[2] if fits else ","


def unzipped(spark: SparkSession, path: str, ending: str = ".txt") -> DataFrame:
    """archive, name, value: the lines of text files in ZIP archives (A10). An archive is read in one task, as it can't be split."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(ending)):
                        lines = z.read(name).decode("utf-8", "replace").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([at] * len(lines), pa.string()), pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], ["archive", "name", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, value string")
