"""Queries of rule validation, corruption and text rules that feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.corrupt import KINDS, WHOLE, corrupt
from .registry import register, table
from .virtual import WITH, shapes

#: Annotation JSON of a case: its label is at times wrong, as are types and coordinates.
JSON = """'{"Labels": [{"Label": "' || CASE WHEN case_id % 11 = 0 THEN 'InvalidLabelName' ELSE 'wire' END || '", "Shapes": [' || string_agg(
    '{"Type": "' || CASE WHEN shape_id % 5 = 0 THEN 'blob' ELSE 'polygon' END || '", "points": [[' || x0 || ', ' || y0 || '], [' || CASE WHEN score = 7 THEN 6000 ELSE x1 END || ', ' || y1 || ']]' ||
    CASE WHEN score = 9 THEN '' ELSE ', "Attributes": {' || CASE WHEN score = 13 THEN '' ELSE '"category_id": ' || shape_id END || '}' END || '}', ', ' ORDER BY shape_id) || ']}]}'"""


def _files(spark, sf_dir) -> DataFrame:
    part = F.concat(
        F.lit('{"Type": "'), F.when(F.col("shape_id") % 5 == 0, "blob").otherwise("polygon"), F.lit('", "points": [['), F.col("x0"), F.lit(", "), F.col("y0"), F.lit("], ["),
        F.when(F.col("score") == 7, 6000).otherwise(F.col("x1")), F.lit(", "), F.col("y1"), F.lit("]]"),
        F.when(F.col("score") == 9, "").otherwise(F.concat(F.lit(', "Attributes": {'), F.when(F.col("score") == 13, "").otherwise(F.concat(F.lit('"category_id": '), F.col("shape_id"))), F.lit("}"))), F.lit("}"),
    )
    g = shapes(spark, sf_dir).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shape_id", part.alias("p")))), lambda s: s["p"]), ", ").alias("ps"))
    label = F.when(F.col("case_id") % 11 == 0, "InvalidLabelName").otherwise("wire")
    return g.select("case_id", F.concat(F.lit('{"Labels": [{"Label": "'), label, F.lit('", "Shapes": ['), "ps", F.lit("]}]}")).alias("json"))


#: The rules restated on the columns that the JSON is made of.
SHAPE_RULE = """CASE WHEN score = 9 THEN '''Attributes'' is required' WHEN shape_id % 5 = 0 THEN '''Type'' is not allowed' WHEN score = 7 THEN 'a coordinate is out of range' WHEN score = 13 THEN '''category_id'' is required' END"""
IDENT = "CASE WHEN score IN (9, 13) THEN 'NA' ELSE CAST(shape_id AS VARCHAR) END"


@register(
    "json_issue_messages",
    f"""{WITH}, s AS (SELECT case_id, {IDENT} AS id, {SHAPE_RULE} AS v FROM shapes)
        SELECT case_id, 'label' AS pass, id, '''Label'' is not allowed' AS reason FROM s WHERE case_id % 11 = 0
        UNION ALL SELECT case_id, 'shape', id, v FROM s WHERE v IS NOT NULL""",
)
def _(spark, sf_dir):
    return rules.issues(_files(spark, sf_dir))


@register("rule_label_schema", f"{WITH} SELECT DISTINCT case_id, CASE WHEN case_id % 11 = 0 THEN '''Label'' is not allowed' END AS reason FROM shapes")
def _(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("json"), "$.Labels[0]", "variant")
    return _files(spark, sf_dir).select("case_id", rules.label_violation(v).alias("reason"))


@register("rule_shape_schema", f"{WITH} SELECT case_id, reason, count(*) AS n FROM (SELECT case_id, {SHAPE_RULE} AS reason FROM shapes) GROUP BY ALL")
def _(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("json"), "$.Labels[0].Shapes", "array<variant>")
    each = _files(spark, sf_dir).select("case_id", F.explode(v).alias("v")).select("case_id", rules.shape_violation(F.col("v")).alias("reason"))
    return each.groupBy("case_id", "reason").agg(F.count("*").alias("n"))


@register("label_name_select", "SELECT o_orderkey, n AS name FROM orders, (VALUES ('urgent'), ('HIGH'), ('e')) t(n) WHERE contains(lower(o_orderpriority), lower(n))")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return rules.select_labels(o, ["urgent", "HIGH", "e"])[0].select("o_orderkey", "name")


@register("label_name_remain", "SELECT o_orderkey, n AS name FROM orders, (VALUES ('urgent'), ('HIGH'), ('e')) t(n) WHERE NOT contains(lower(o_orderpriority), lower(n))")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return rules.select_labels(o, ["urgent", "HIGH", "e"])[1].select("o_orderkey", "name")


#: Kinds by arithmetic on keys, so that any engine draws the same.
DRAW = "CASE WHEN (case_id * 7919) % 1000 < 100 THEN (case_id * 31) % 4 WHEN (case_id * 7919 + shape_id * 104729) % 1000 < 400 THEN 4 + (case_id * 31 + shape_id * 17) % 4 END"


@register("corrupt_plan", f"{WITH}, d AS (SELECT case_id, shape_id, {DRAW} AS k FROM shapes) SELECT case_id, shape_id, CASE k {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate((*WHOLE, *KINDS)))} END AS kind FROM d")
def _(spark, sf_dir):
    return corrupt(shapes(spark, sf_dir), "case_id", "shape_id").select("case_id", "shape_id", "kind")


@register(
    "corrupt_counts",
    f"{WITH}, d AS (SELECT {DRAW} AS k FROM shapes) SELECT CASE k {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate((*WHOLE, *KINDS)))} ELSE 'clean' END AS kind, count(*) AS n FROM d GROUP BY ALL",
)
def _(spark, sf_dir):
    return corrupt(shapes(spark, sf_dir), "case_id", "shape_id").groupBy(F.coalesce("kind", F.lit("clean")).alias("kind")).agg(F.count("*").alias("n"))


@register(
    "corrupt_roundtrip_recall",
    f"{WITH}, d AS (SELECT {DRAW} AS k FROM shapes) SELECT CASE k {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate((*WHOLE, *KINDS)))} ELSE 'clean' END AS kind, count(*) AS n, count(*) FILTER (WHERE k IN (0, 4, 5)) AS flagged FROM d GROUP BY ALL",
)
def _(spark, sf_dir):
    """The rules find all invalid labels, types and coordinates, and none of the other kinds."""
    from ..operators.corrupt import apply

    c = apply(corrupt(shapes(spark, sf_dir), "case_id", "shape_id"))
    label = F.to_variant_object(F.struct(F.col("label").alias("Label"), F.array(F.lit(1)).alias("Shapes")))
    shape = F.to_variant_object(F.struct(F.col("type").alias("Type"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("points"), F.struct(F.col("shape_id").alias("category_id")).alias("Attributes")))
    bad = rules.label_violation(label).isNotNull() | rules.shape_violation(shape).isNotNull()
    return c.select(F.coalesce("kind", F.lit("clean")).alias("kind"), bad.alias("b")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("b").alias("flagged"))
