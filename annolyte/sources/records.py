"""Loaders and writers of query records, masklets, results and viewer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phrase_queries(images: DataFrame) -> DataFrame:
    """One query for each image row with its noun phrase: dataset, image_id, query_id (running), text."""
    w = Window.partitionBy("dataset").orderBy("id")
    return images.select("dataset", F.col("id").alias("image_id"), (F.row_number().over(w) - 1).cast("long").alias("query_id"), F.col("text_input").alias("text"))


def video_phrase_queries(videos: DataFrame, pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """A query for each video, phrase and frame: dataset, video_id, category_id, text, frame_index, file_name.

    pairs: dataset, video_id, category_id, name. A pair whose name isn't its category's raises an error.
    """
    j = pairs.join(categories.select("dataset", F.col("id").alias("category_id"), F.col("name").alias("_name")), ["dataset", "category_id"])
    j = j.withColumn("text", F.when(F.col("name") == F.col("_name"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unlike names of category "), F.col("category_id").cast("string")))))
    return j.join(videos.select("dataset", F.col("id").alias("video_id"), F.posexplode("file_names").alias("frame_index", "file_name")), ["dataset", "video_id"]).drop("name", "_name")


def relations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds image_index and query_index, ids as places from 0; boxes, normalised xywh, become corners in pixels within the image.

    rows: by, image_id, query_id, width, height, bbox (array of four).
    """
    w = lambda c: Window.partitionBy(*by).orderBy(c)
    lim = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    b, wd, ht = F.col("bbox"), F.col("width"), F.col("height")
    corners = F.array(lim(b[0] * wd, wd), lim(b[1] * ht, ht), lim((b[0] + b[2]) * wd, wd), lim((b[1] + b[3]) * ht, ht))
    return rows.withColumns({"image_index": (F.dense_rank().over(w("image_id")) - 1).cast("long"), "query_index": (F.dense_rank().over(w("query_id")) - 1).cast("long"), "corners": corners})


def unequal_stages(queries: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose stages have unlike numbers of queries: must be none."""
    n = queries.groupBy(*by, "stage").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count_distinct("n").alias("kinds")).where("kinds > 1")


def frames_needed(frames: DataFrame, wanted: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Only frames that are asked for, before anything is decoded; a sidecar's path where there is one. Frame addresses may be `path@frame`."""
    kept = frames.join(wanted.select("frame_id").distinct(), "frame_id", "left_semi")
    kept = kept.withColumns({"file": F.substring_index("path", "@", 1), "place": F.when(F.col("path").contains("@"), F.substring_index("path", "@", -1).try_cast("long"))})
    return kept if sidecars is None else kept.join(sidecars.select("frame_id", F.col("path").alias("sidecar")), "frame_id", "left")


def skipped(queries: DataFrame, by: list[str], most_outputs: int, most_queries: int) -> DataFrame:
    """Groups to leave out: without queries, with too many, or with a query of too many outputs."""
    g = queries.groupBy(*by).agg(F.max("n_outputs").alias("_o"), F.count("*").alias("_q"))
    return g.where((F.col("_o") > most_outputs) | (F.col("_q") > most_queries)).select(*by)


def masklets(annotations: DataFrame, prediction: bool) -> DataFrame:
    """image_id, obj_id (place in the image), box (relative xywh), prob.

    A box with a value above 1 is in pixels. Ground truth has probability 1. annotations: image_id, id, bbox, score, width, height.
    """
    b = F.col("bbox")
    size = F.array("width", "height", "width", "height")
    rel = F.when(F.array_max(b) > 1.0, F.zip_with(b, size, lambda v, s: v / s)).otherwise(b)
    w = Window.partitionBy("image_id").orderBy("id")
    return annotations.select("image_id", (F.row_number().over(w) - 1).cast("long").alias("obj_id"), rel.alias("box"), (F.col("score").cast("double") if prediction else F.lit(1.0)).alias("prob"))


def frame_lookup(tracks: DataFrame, video, frame: int, empty: Column | None = None) -> DataFrame:
    """Annotations of one frame of one video, by phrase; null masks become `empty`. tracks: video_id, phrase, id, masks."""
    at = F.try_element_at("masks", F.lit(frame + 1))
    return tracks.where(F.col("video_id") == video).select("video_id", "phrase", "id", (at if empty is None else F.coalesce(at, empty)).alias("mask")).orderBy("phrase", "id")


def resolved(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path: the image under the root, else under its case, else as given; null if no such file. files: path."""
    known = files.select(F.col("path").alias("_p")).distinct()
    out = issues
    tries = {"_root": F.col("image"), "_case": F.concat_ws("/", "case_path", "image"), "_abs": F.when(F.col("image").startswith("/"), F.col("image"))}
    for name, ref in tries.items():
        out = out.withColumn("_ref", ref).join(known.withColumnRenamed("_p", name), F.col("_ref") == F.col(name), "left").drop("_ref")
    return out.withColumn("path", F.coalesce("_root", "_case", "_abs")).drop("_root", "_case", "_abs")


def viewer_export(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """key, json: shapes regrouped by label, each with the viewer's fixed fields; other keys of the document stay in `rest` (VARIANT, may be null)."""
    shape = F.struct(*[F.lit("default").alias(n) for n in ("vertex_color", "line_color", "fill_color")], F.col("type").alias("Type"), "points", F.col("image").alias("Image_List"), F.col("attributes").alias("Attributes"))
    one = rows.groupBy(key, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", shape.alias("s"))), lambda a, b: F.signum(a["place"] - b["place"]).cast("int")), lambda x: x["s"]).alias("Shapes"), F.min("place").alias("first"))
    label = F.struct("first", F.struct(F.col("label").alias("Label"), "Shapes", F.lit("OK").alias("Status"), F.lit(0).alias("Unit_ID")).alias("l"))
    whole = one.groupBy(key).agg(F.collect_list(label).alias("ls"))
    ordered = F.transform(F.array_sort("ls", lambda a, b: F.signum(a["first"] - b["first"]).cast("int")), lambda x: x["l"])
    return whole.select(key, F.to_json(F.struct(ordered.alias("Labels"))).alias("json"))


def result_documents(issues: DataFrame, metrics: DataFrame, by: list[str]) -> DataFrame:
    """by, json: counts, precision, recall and the list of findings of each case, as the result files have them."""
    found = issues.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("image").alias("issue_image"), F.col("reason").alias("data failure reason")))).alias("found"))
    j = metrics.join(found, by, "left")
    doc = F.struct(
        F.coalesce("found", F.array().cast("array<struct<id: string, issue_image: string, `data failure reason`: string>>")).alias("Labels with Issue"),
        F.col("tp").alias("True Positives Num"), F.col("tn").alias("True Negatives Num"), F.col("fp").alias("False Positives Num"), F.col("fn").alias("False Negatives Num"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
    )
    return j.select(*by, F.to_json(doc).alias("json"))


def with_header(files: DataFrame, **fields) -> DataFrame:
    """Header fields of documents set to plain values: package, optics, label, global attributes."""
    return files.withColumns({k: F.lit(v) for k, v in fields.items()})


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


#: The feature table's columns.
FEATURES = "log_case string, shape_id string, stroke_width double, stroke_length double, average_hue double, hue_sd double, average_saturation double, saturation_sd double, average_value double, value_sd double, label boolean"


def read_features(spark, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).option("header", True).csv(path)


#: Order of the summary's fields that come first: fixed names. Others follow as they come.
SUMMARY = "HOTA DetA AssA DetRe DetPr AssRe AssPr LocA OWTA HOTA(0) LocA(0) HOTALocA(0) MOTA MOTP MODA CLR_Re CLR_Pr MTR PTR MLR CLR_TP CLR_FN CLR_FP IDSW MT PT ML Frag sMOTA IDF1 IDR IDP IDTP IDFN IDFP Dets GT_Dets IDs GT_IDs".split()


def write_summary(summary: DataFrame, path: str) -> None:
    """One row of metrics as text: names, then values, parted by spaces, known fields first."""
    names = [c for c in SUMMARY if c in summary.columns] + [c for c in summary.columns if c not in SUMMARY]
    summary.select(*[F.col(f"`{c}`") for c in names]).coalesce(1).write.mode("overwrite").option("header", True).option("sep", " ").csv(path)


def write_details(details: DataFrame, combined: DataFrame, path: str, seq: str = "seq") -> None:
    """A row for each sequence, in order, then the one of all, named COMBINED. Both have the same metrics."""
    rows = details.withColumn("_last", F.lit(0)).unionByName(combined.withColumn(seq, F.lit("COMBINED")).withColumn("_last", F.lit(1)))
    names = [c for c in details.columns if c != seq]
    ordered = rows.repartition(1).sortWithinPartitions("_last", seq)  # a row for each sequence of a data set
    ordered.select(seq, *[F.col(f"`{c}`") for c in names]).write.mode("overwrite").option("header", True).csv(path)


def read_details(spark, path: str, seq: str = "seq") -> DataFrame:
    """The rows of `write_details` as numbers; the last is named COMBINED_SEQ. Rows without a sequence or of another length are left out."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    raw = raw.where(F.col(seq).isNotNull() & (F.col(seq) != ""))
    name = F.when(F.col(seq) == "COMBINED", "COMBINED_SEQ").otherwise(F.col(seq)).alias(seq)
    return raw.select(name, *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c != seq])


def exemplars(spark, path: str) -> DataFrame:
    """name (the folder), embedding, roi, wire_width of each exemplar_info.json below path; no width counts as 0."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="exemplar_info.json")
    v = F.try_parse_json("value")
    return raw.select(
        _folder().alias("name"),
        F.coalesce(F.try_variant_get(v, "$.image_embedding", "array<double>"), F.array().cast("array<double>")).alias("embedding"),
        F.try_variant_get(v, "$.roi", "array<double>").alias("roi"),
        F.coalesce(F.try_variant_get(v, "$['wire width']", "double"), F.lit(0.0)).alias("wire_width"),
    )


def log_cases(spark, path: str) -> DataFrame:
    """name (the folder), exemplar, embedding of each label_clean.json below path."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="label_clean.json")
    v = F.try_parse_json("value")
    return raw.select(
        _folder().alias("name"),
        F.try_variant_get(v, "$.globalAttributes.exemplar_name", "string").alias("exemplar"),
        F.coalesce(F.try_variant_get(v, "$.globalAttributes.image_embedding", "array<double>"), F.array().cast("array<double>")).alias("embedding"),
    )


def _folder():
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
