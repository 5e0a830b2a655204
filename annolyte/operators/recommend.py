"""Exemplar recommendation: nearest log cases by embedding, and the exemplars they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import dot
from .match import top_k


#: Queries that are held by a task at once.
QUERIES = 2048


def nearest(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, k: int, others: bool = False) -> DataFrame:
    """The k items of highest cosine for each query; of equals the least key. Adds sim. others: an item of the query's own key doesn't count.

    Queries are dealt by hash into blocks of about `QUERIES`; each block is one array that every task scans its items against, in a
    pass of its own, so that what is broadcast does not grow with the queries. Every task keeps k items a query before the shuffle.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    q = queries.select(query_key, F.col("embedding").alias("_q")).withColumns({"_nq": F.sqrt(dot(F.col("_q"), F.col("_q"))), "_block": F.pmod(F.xxhash64(query_key), F.lit(blocks))})
    i = items.select(item_key, F.col("embedding").alias("_e")).withColumn("_ne", F.sqrt(dot(F.col("_e"), F.col("_e"))))
    found = None
    for block in range(blocks):
        packed = q.where(F.col("_block") == block).agg(F.collect_list(F.struct(query_key, "_q", "_nq")).alias("_all"))
        each = i.join(F.broadcast(packed)).select(item_key, "_e", "_ne", F.explode("_all").alias("q"))
        if others:
            each = each.where(F.col(item_key) != F.col(f"q.{query_key}"))
        sim = dot(F.col("_e"), F.col("q._q")) / (F.col("q._nq") * F.col("_ne") + 1e-10)
        best = top_k(each.select(F.col(f"q.{query_key}").alias(query_key), item_key, sim.alias("sim")), [query_key], [F.desc("sim"), item_key], k)
        found = best if found is None else found.unionByName(best)
    return found


def missing_references(edges: DataFrame, vertices: DataFrame, edge_key: str, vertex_key: str) -> DataFrame:
    """Edges whose end is no vertex; must be empty before they are added."""
    return edges.join(vertices.select(F.col(vertex_key).alias(edge_key)), edge_key, "left_anti")


def exemplars_of(neighbours: DataFrame, edges: DataFrame, query_key: str, case_key: str, mode: str = "last") -> DataFrame:
    """Exemplars of the neighbours found. last: of the farthest of the k alone, as callers with k = 1 can't tell (Q26); all: of each."""
    found = neighbours
    if mode == "last":
        worst = neighbours.groupBy(query_key).agg(F.min_by(case_key, F.struct(F.col("sim"), -F.col(case_key))).alias(case_key))
        found = worst
    return found.join(edges, case_key).select(query_key, case_key, "exemplar").distinct()
