"""Annotation files: one JSON document for each case, read into a table of shapes and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_part

POINTS = "array<array<double>>"
SHAPE = f"struct<Type: string, points: {POINTS}, proposed_points: {POINTS}, Image_List: array<string>, thickness: array<double>, Attributes: variant, score: double>"
FILE = f"struct<Labels: array<struct<Label: string, Shapes: array<{SHAPE}>, Status: string, Unit_ID: bigint>>, globalAttributes: variant>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """case_id (the path), json: the raw text stays, as rules must see type errors that a typed parse hides."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("case_id"), F.col("value").alias("json"))


def shapes_of(files: DataFrame, names: list[str] | None = None, scale: float = 1.0, key: str = "case_id", json: str = "json") -> DataFrame:
    """A row per shape and requested name: key, label, name, selected, label_index, shape_index, type, points, proposed_points, thickness, images, attributes, score.

    A name selects labels that contain it, in any case; each (label, name) pair gives the label's shapes once, selected or
    not (Q1). Without names all are selected (Q2). Thickness is dropped if it starts with 0 or has not one value
    for each point, else scaled like the points (Q4). Files that are no such JSON give no rows.
    """
    parsed = files.select(key, F.try_variant_get(F.try_parse_json(F.col(json)), "$", FILE).alias("f"))
    labels = parsed.select(key, F.posexplode("f.Labels").alias("label_index", "l"))
    if names is None:
        labels = labels.withColumns({"name": F.lit(None).cast("string"), "selected": F.lit(True)})
    else:
        labels = labels.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("selected", has_part(F.col("l.Label"), F.col("name")))
    rows = labels.select(key, "label_index", "name", "selected", F.col("l.Label").alias("label"), F.posexplode("l.Shapes").alias("shape_index", "s"))
    scaled = lambda ps: F.transform(ps, lambda p: F.transform(p, lambda v: v * scale))
    thick = F.when((F.size("s.thickness") == F.size("s.points")) & ~F.coalesce(F.try_element_at("s.thickness", F.lit(1)) == 0, F.lit(True)), F.transform("s.thickness", lambda v: v * scale))
    return rows.select(
        key, "label", "name", "selected", "label_index", "shape_index", F.col("s.Type").alias("type"), scaled(F.col("s.points")).alias("points"), scaled(F.col("s.proposed_points")).alias("proposed_points"),
        thick.alias("thickness"), F.col("s.Image_List").alias("images"), F.col("s.Attributes").alias("attributes"), F.col("s.score").alias("score"),
    )


def to_json(shapes: DataFrame, key: str = "case_id") -> DataFrame:
    """key, json: shapes back in their labels, both in order; null fields are left out."""
    s = F.struct(
        "shape_index",
        F.struct(F.col("type").alias("Type"), "points", "proposed_points", F.col("images").alias("Image_List"), "thickness", F.col("attributes").alias("Attributes"), "score").alias("s"),
    )
    one = shapes.groupBy(key, "label_index", "label").agg(F.collect_list(s).alias("ss"))
    one = one.withColumn("Shapes", F.transform(_in_order(F.col("ss"), "shape_index"), lambda x: x["s"]))
    label = F.struct("label_index", F.struct(F.col("label").alias("Label"), "Shapes").alias("l"))
    whole = one.groupBy(key).agg(F.collect_list(label).alias("ls"))
    return whole.select(key, F.to_json(F.struct(F.transform(_in_order(F.col("ls"), "label_index"), lambda x: x["l"]).alias("Labels"))).alias("json"))


def _in_order(items: Column, index: str) -> Column:
    """Sorted by one field: VARIANTs among the others have no order."""
    return F.array_sort(items, lambda a, b: F.when(a[index] < b[index], -1).when(a[index] > b[index], 1).otherwise(0))


def write(files: DataFrame, path: str, key: str = "case_id") -> None:
    """One text row for each case, partitioned by case; a new version is a new path."""
    files.write.mode("overwrite").partitionBy(key).text(path)


def header_only(files: DataFrame, json: str = "json") -> DataFrame:
    """The document's header without its labels."""
    v = F.try_parse_json(F.col(json))
    return files.withColumn(json, F.to_json(F.struct(*[F.try_variant_get(v, f"$.{n}", "variant").alias(n) for n in ("flags", "globalAttributes", "vertexColor", "lineColor", "fillColor")])))


def viewer_rows(files: DataFrame, key: str = "case_id", json: str = "json") -> DataFrame:
    """key, label, type, points from either layout: labels with shapes, or flat annotations as polygons `object_<category>`."""
    own = shapes_of(files, key=key, json=json).select(key, F.coalesce("label", F.lit("unlabeled")).alias("label"), F.coalesce("type", F.lit("polygon")).alias("type"), "points")
    flat = files.select(key, F.explode(F.try_variant_get(F.try_parse_json(F.col(json)), "$.annotations", "array<struct<category_id: bigint, segmentation: array<array<double>>>>")).alias("a")).where(F.size("a.segmentation") > 0)
    ring = F.col("a.segmentation")[0]
    n = F.floor(F.size(ring) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.element_at(ring, 2 * i + 1), F.element_at(ring, 2 * i + 2)))).otherwise(F.array().cast(POINTS))
    return own.unionByName(flat.select(key, F.concat(F.lit("object_"), F.col("a.category_id")).alias("label"), F.lit("polygon").alias("type"), pairs.alias("points")))


def case_list(spark: SparkSession, path: str) -> DataFrame:
    """dataset, case_name, place of each line `dataset/case` that isn't blank."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    return lines.select(F.regexp_extract("v", "^(.*)/[^/]*$", 1).alias("dataset"), F.substring_index("v", "/", -1).alias("case_name"))


def name_pool(spark: SparkSession, path: str) -> DataFrame:
    """place, name of a comma-separated pool."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.filter(F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")).alias("place", "name"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """path, frame (place in numeric order of file names, by folder), content of image files."""
    from pyspark.sql import Window

    from ..functions.text import dirname, frame_number

    raw = spark.read.format("binaryFile").load(path)
    w = Window.partitionBy(dirname(F.col("path"))).orderBy(F.col("n").asc_nulls_last(), "path")
    return raw.withColumn("n", frame_number(F.col("path"))).select("path", (F.row_number().over(w) - 1).cast("long").alias("frame"), "content")


def config(source) -> dict:
    """Settings from a YAML file or a dict."""
    if isinstance(source, dict):
        return source
    import yaml

    with open(source) as f:
        return yaml.safe_load(f)
