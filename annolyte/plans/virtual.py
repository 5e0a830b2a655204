"""Annotation tables derived from the star schema, the same in Spark and in SQL.

shapes: ground-truth boxes by case (an order), with a score, an error mark and three validators'
votes. preds: boxes near most of them. frames: detections of tracks by frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

SHAPES = """
  SELECT l_orderkey AS case_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_discount) AS BIGINT) AS shape_id,
    CAST(l_partkey % 100 AS BIGINT) AS x0, CAST(l_suppkey % 50 AS BIGINT) AS y0,
    CAST(l_partkey % 100 + 20 + CAST(l_quantity AS BIGINT) AS BIGINT) AS x1,
    CAST(l_suppkey % 50 + 20 + 5 * l_linenumber AS BIGINT) AS y1,
    CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber * 11) % 100 AS BIGINT) AS score,
    l_returnflag = 'R' AS is_error,
    l_linestatus = 'F' AND l_partkey % 3 = 0 AS json_vote,
    l_quantity > 25 AS feature_vote,
    l_suppkey % 4 < 2 AS model_vote,
    CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem"""

PREDS = """
  SELECT case_id, shape_id AS pred_id,
    x0 + (x0 * 7 + y0 * 3 + shape_id) % 9 - 4 AS x0, y0 + (x0 * 5 + shape_id * 2) % 7 - 3 AS y0,
    x1 + (x0 + y0) % 9 - 4 AS x1, y1 + (y0 * 3 + x0) % 7 - 3 AS y1, score
  FROM shapes WHERE (shape_id + x0) % 5 <> 0"""

FRAMES = """
  SELECT user_id AS track_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame,
    event_type = 'error' AS miss
  FROM events"""

#: A prefix that gives DuckDB the same tables.
WITH = f"WITH RECURSIVE shapes AS ({SHAPES}), preds AS ({PREDS}), frames AS ({FRAMES})"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHAPES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDS.replace("FROM shapes", "FROM {shapes}"), shapes=shapes(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAMES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
