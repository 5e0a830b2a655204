"""Deliberate corruption of annotations, which labels itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import poly as P

#: Errors of a whole image, and of single shapes; their shares of a thousand.
WHOLE = ("invalid label", "blur", "low_contrast", "darken")
KINDS = ("invalid shape type", "out of range points", "rotation", "scaling")
WHOLE_SHARE, SHAPE_SHARE = 100, 400


def corrupt(shapes: DataFrame, case: str, shape: str) -> DataFrame:
    """Adds kind (null for clean shapes): a tenth of the cases whole, of the others' shapes four tenths.

    Draws are arithmetic on the keys, so that they repeat in any engine, at any partitioning.
    """
    c, s = F.col(case), F.col(shape)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % 4 + 1).cast("int"))
    kind = F.when((c * 7919) % 1000 < WHOLE_SHARE, pick(WHOLE, c * 31)).when((c * 7919 + s * 104729) % 1000 < SHAPE_SHARE, pick(KINDS, c * 31 + s * 17))
    return shapes.withColumn("kind", kind)


def apply(shapes: DataFrame, width: int = 5120, height: int = 5120) -> DataFrame:
    """Adds label, type, points, original_points and label_error to rows with kind and x0, y0, x1, y1, case_id, shape_id."""
    original = P.of_box(B.box("x0", "y0", "x1", "y1"))
    about = P.centroid(F.col("original_points"))
    unit = ((F.col("case_id") * 13 + F.col("shape_id") * 7) % 1000) / 1000.0
    angle, factor = 5 + 5 * unit, 1.3 + 0.3 * unit
    k = F.col("kind")
    points = (
        F.when(k == "out of range points", F.concat("original_points", F.array(P.point(F.lit(6000), F.lit(6000)))))
        .when(k == "rotation", P.clipped(P.turned(F.col("original_points"), F.radians(angle), about), width - 1, height - 1))
        .when(k == "scaling", P.clipped(P.stretched(F.col("original_points"), factor, about), width - 1, height - 1))
        .otherwise(F.col("original_points"))
    )
    reason = (
        F.when(k == "rotation", F.format_string("Shape points are rotated by %.2f degrees", angle))
        .when(k == "scaling", F.format_string("Shape points are scaled by a factor of %.2f", factor))
        .when(k.isNotNull(), k)
    )
    return shapes.withColumn("original_points", original).withColumns({
        "label": F.when(k == "invalid label", "InvalidLabelName").otherwise("wire"),
        "type": F.when(k == "invalid shape type", "InvalidShapeType").otherwise("polygon"),
        "points": points,
        "label_error": reason,
    })
