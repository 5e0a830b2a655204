"""The feature classifier: a shallow tree that shuns false positives, and its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

#: What the tree sees; how much more a clean shape weighs than a wrong one; its depth.
COLUMNS, CLEAN_WEIGHT, DEPTH = ("stroke_width", "stroke_length", "average_value", "value_sd"), 100.0, 5


def fit(rows: DataFrame, columns=COLUMNS, label: str = "label", clean_weight: float = CLEAN_WEIGHT, depth: int = DEPTH):
    """A gini tree over rows; clean ones (label 0) weigh clean_weight."""
    from pyspark.ml.classification import DecisionTreeClassifier

    w = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).withColumn("_weight", F.when(F.col(label) == 0, clean_weight).otherwise(1.0))
    made = _assembled(w, columns).withColumn(label, F.col(label).cast("double"))
    return DecisionTreeClassifier(labelCol=label, featuresCol="_features", weightCol="_weight", maxDepth=depth, impurity="gini", maxBins=256, seed=1).fit(made)


def _assembled(rows: DataFrame, columns) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep").transform(rows)


def issues(model, rows: DataFrame, columns=COLUMNS) -> DataFrame:
    """Rows that the tree holds for wrong, with the reason."""
    got = model.transform(_assembled(rows, columns)).where("prediction = 1")
    return got.drop("_features", "rawPrediction", "probability", "prediction").withColumn("reason", F.lit("Predicted as label error by feature validator"))


def quality(model, rows: DataFrame, columns=COLUMNS, label: str = "label") -> DataFrame:
    """precision, recall, fp, fn."""
    p, t = F.col("prediction") == 1, F.col(label) == 1
    c = model.transform(_assembled(rows, columns)).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return c.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "fp", "fn")
