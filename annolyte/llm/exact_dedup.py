"""Exact duplicates by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries sketch (the frequent-items sketch behind `approx_top_k`, whose counters merge
map-side in bounded memory) names the most frequent digests. Their groups are counted exactly
with partial aggregation, and the verified winners, at most `HEAVY`, are broadcast: rows with a
frequent digest get their group without a shuffle. All other rows take an ordinary shuffle by
digest, after partial counts. Since at most HEAVY digests can hold more than 1/HEAVY of the rows each and the sketch
finds those, no shuffled group is larger than about that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, without_spaces

#: Digests that are split off at most; counters of the sketch.
HEAVY, COUNTERS = 256, 8192


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: _id, _n (code points), _digest (SHA-256 of the normalised text), _row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.length(text).alias("_n"),
        F.sha2(without_spaces(text), 256).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )


def frequent(keys: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries: the likeliest frequent digests, `heavy` rows at most."""
    top = keys.agg(F.expr(f"approx_top_k(_digest, {heavy}, {counters})").alias("top"))
    return top.select(F.explode("top.item").alias("_digest"))


def _best():
    """Sorts first: most code points, then smallest id (nulls last), then the first row read."""
    return F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Groups documents whose texts are equal apart from ASCII white space.

    Returns a row per input row: the id column, keep_id (id of the row that stays), group_size,
    kept, text_sha256. Of a group the row with the most code points stays, then the smallest id; of
    rows repeated whole just one is kept. Null texts count as empty and form a group with the
    empty ones. A null id sorts after all others. An empty table gives no rows. Other columns
    of docs are not read.
    """
    keys = materialize(digests(docs, id_col, text_col), "digests")
    winners = materialize(
        keys.join(F.broadcast(frequent(keys, heavy, counters)), "_digest").groupBy("_digest").agg(F.count("*").alias("_size"), F.min(_best()).alias("_keep")),
        "frequent",
    )
    hot = keys.join(F.broadcast(winners), "_digest")
    cold = keys.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    # Groups are counted map-side first; only those of several rows are joined back, by a join whose large partitions can be split.
    groups = cold.groupBy("_digest").agg(F.count("*").alias("_size"), F.min(_best()).alias("_keep")).where("_size > 1")
    cold = cold.join(groups, "_digest", "left").withColumns({"_size": F.coalesce("_size", F.lit(1)), "_keep": F.coalesce("_keep", _best())}).select(*hot.columns)
    return hot.unionByName(cold).select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
