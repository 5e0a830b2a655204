"""Rule validation of annotation JSON, and the name filter of its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_part

#: What the label and shape rules allow: fixed values.
LABELS, TYPES, LIMIT = ("wire",), ("polygon",), 5120


def _kind(v: Column) -> Column:
    """null, object, array, string, number or boolean."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def label_violation(v: Column, labels=LABELS) -> Column:
    """The first rule that a label (VARIANT) breaks, or null."""
    label, shapes = _get(v, "Label"), _get(v, "Shapes")
    return (
        F.when(_kind(v) != "object", "label is no object")
        .when(label.isNull(), "'Label' is required")
        .when(shapes.isNull(), "'Shapes' is required")
        .when(_kind(label) != "string", "'Label' is no string")
        .when(~F.try_variant_get(v, "$.Label", "string").isin(*labels), "'Label' is not allowed")
        .when(_kind(shapes) != "array", "'Shapes' is no array")
        .when(F.size(_items(shapes)) < 1, "'Shapes' is empty")
    )


def shape_violation(v: Column, types=TYPES, limit: float = LIMIT) -> Column:
    """The first rule that a shape (VARIANT) breaks, or null. Only `points` is checked, not proposals (Q5)."""
    kind, points, attrs, cat = _get(v, "Type"), _get(v, "points"), _get(v, "Attributes"), _get(v, "Attributes.category_id")
    each = _items(points)
    bad_number = lambda n: F.coalesce(_kind(n) != "number", F.lit(True))
    out = lambda n: (F.try_variant_get(n, "$", "double") < 0) | (F.try_variant_get(n, "$", "double") > limit)
    return (
        F.when(_kind(v) != "object", "shape is no object")
        .when(kind.isNull(), "'Type' is required")
        .when(points.isNull(), "'points' is required")
        .when(attrs.isNull(), "'Attributes' is required")
        .when(_kind(kind) != "string", "'Type' is no string")
        .when(~F.try_variant_get(v, "$.Type", "string").isin(*types), "'Type' is not allowed")
        .when(_kind(points) != "array", "'points' is no array")
        .when(F.size(each) < 1, "'points' is empty")
        .when(F.exists(each, lambda p: F.coalesce(_kind(p) != "array", F.lit(True)) | (F.coalesce(F.size(_items(p)), F.lit(0)) != 2)), "a point is no pair")
        .when(F.exists(each, lambda p: F.exists(_items(p), bad_number)), "a coordinate is no number")
        .when(F.exists(each, lambda p: F.exists(_items(p), out)), "a coordinate is out of range")
        .when(_kind(attrs) != "object", "'Attributes' is no object")
        .when(cat.isNull(), "'category_id' is required")
        .when(_kind(cat) != "number", "'category_id' is no number")
    )


def issues(files: DataFrame, key: str = "case_id", json: str = "json") -> DataFrame:
    """Findings of both passes: key, pass, id ('NA' for shapes without one), reason.

    A label that breaks a rule gives a finding for each of its shapes, none if it has none (Q7); a shape may
    be found by both passes. Text that is no JSON gives no rows.
    """
    labels = files.select(key, F.explode(F.try_variant_get(F.try_parse_json(F.col(json)), "$.Labels", "array<variant>")).alias("label"))
    shapes = labels.select(key, label_violation(F.col("label")).alias("lv"), F.explode(F.try_variant_get(F.col("label"), "$.Shapes", "array<variant>")).alias("shape"))
    ident = F.coalesce(F.try_variant_get(F.col("shape"), "$.Attributes.category_id", "string"), F.lit("NA"))
    made = shapes.select(key, ident.alias("id"), "lv", shape_violation(F.col("shape")).alias("sv"))
    first = made.where("lv IS NOT NULL").select(key, F.lit("label").alias("pass"), "id", F.col("lv").alias("reason"))
    return first.unionByName(made.where("sv IS NOT NULL").select(key, F.lit("shape").alias("pass"), "id", F.col("sv").alias("reason")))


def select_labels(labels: DataFrame, names: list[str] | None, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(selected, remaining) by case-insensitive part: once for each name that matches, and for each that does not (Q1). No names: all (Q2)."""
    if names is None:
        return labels, labels.limit(0)
    each = labels.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    hit = has_part(F.col(label), F.col("name"))
    return each.where(hit), each.where(~hit)
