"""Confusion counts, averages and the merging of several validators' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 for an empty denominator."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(rows: DataFrame, by: list[str], truth: str, vote: str) -> DataFrame:
    """tp, tn, fp, fn, precision and recall of a validator, by group."""
    t, v = F.col(truth), F.col(vote)
    counts = rows.groupBy(*by).agg(
        F.count_if(t & v).alias("tp"), F.count_if(~t & ~v).alias("tn"), F.count_if(~t & v).alias("fp"), F.count_if(t & ~v).alias("fn")
    )
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def model_confusion(rows: DataFrame, by: list[str], matched: str, corrupted: str) -> DataFrame:
    """A model's counts: matched and corrupted is a true positive, matched and clean a true negative (Q10)."""
    m, c = F.col(matched), F.col(corrupted)
    counts = rows.groupBy(*by).agg(F.count_if(m & c).alias("tp"), F.count_if(m & ~c).alias("tn"), F.count_if(~m & ~c).alias("fp"), F.count_if(~m & c).alias("fn"))
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def macro(rows: DataFrame, skip_zeros: bool) -> DataFrame:
    """Means of precision and recall over groups, with or without zeros (Q29); 0 for none."""
    keep = lambda c: F.when(F.col(c) > 0, F.col(c)) if skip_zeros else F.col(c)
    return rows.agg(F.coalesce(F.avg(keep("precision")), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(keep("recall")), F.lit(0.0)).alias("recall"))


def hybrid(findings: DataFrame, counts: DataFrame, by: list[str], validators: int) -> DataFrame:
    """Metrics of several validators together (Q27).

    findings: by, validator, kind ('fp' or 'fn'), id (null for one without an id). A false
    positive of any counts, those without an id each for itself; a false negative counts if all missed it.
    counts: by, positives, negatives, those of the first validator. 1e-8 is added to denominators.
    """
    fp = findings.where("kind = 'fp'").groupBy(*by).agg((F.count_distinct("id") + F.count_if(F.col("id").isNull())).alias("fp"))
    fn = findings.where("kind = 'fn'").groupBy(*by, "id").agg(F.count_distinct("validator").alias("n")).where(F.col("n") == validators).groupBy(*by).agg(F.count("*").alias("fn"))
    out = counts.join(fp, by, "left").join(fn, by, "left").na.fill(0, ["fp", "fn"])
    tp, tn = F.greatest(F.col("positives") - F.col("fn"), F.lit(0)), F.greatest(F.col("negatives") - F.col("fp"), F.lit(0))
    out = out.withColumns({"tp": tp, "tn": tn})
    return out.select(*by, "tp", "tn", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)).alias("recall"))


def merge_reasons(issues: DataFrame, by: list[str], order: list[str], sep: str = "; ") -> DataFrame:
    """One row by id: reasons joined in the order of the validators, the image of the last that has one (Q28).

    issues: by, id, validator, seq, reason, image. Of a validator's issues on one id, the last counts.
    """
    last = issues.groupBy(*by, "id", "validator").agg(F.max_by(F.struct("reason", "image"), "seq").alias("r"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("validator"))
    rows = last.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("r.reason").alias("reason"), F.col("r.image").alias("image")))).alias("rs"))
    return rows.select(*by, "id", F.array_join("rs.reason", sep).alias("reason"), F.element_at("rs", -1)["image"].alias("image"), F.size("rs").cast("long").alias("n"))


def pack_fitness(bins: DataFrame, by: list[str], k: float = 2.0) -> DataFrame:
    """Sum of utilisations to the power k, over the square of the number of bins."""
    return bins.groupBy(*by).agg((F.sum(F.pow("utilisation", F.lit(k))) / (F.count("*") * F.count("*"))).alias("fitness"))


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, n: int = 30) -> DataFrame:
    b = F.greatest(F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n)), F.lit(n)), F.lit(1))
    return rows.withColumn("bucket", b.cast("long")).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return c.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(*by, f"m.{value}", "m.n")
