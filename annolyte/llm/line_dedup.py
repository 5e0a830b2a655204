"""Line deduplication by site-relative frequency.

Lines are counted by host: the pages that contain a line, divided by all pages of the host. Lines
above a boilerplate ratio are dropped. Only hashes of lines are shuffled, and counts are
combined before the shuffle, so that neither a host with most pages nor a line on all
of them gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, materialize, unwrapped, wrapped

#: A line on more than this share of a host's pages, and on MIN_PAGES of them at least, is boilerplate.
RATIO, MIN_PAGES = 0.02, 4
#: Boilerplate lines that are broadcast at most; more are joined by shuffles.
BROADCAST = 200_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Lines are equal if they are so apart from ASCII white space around them; null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.md5(bare))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _line (hash), _pages of the lines to drop. A page counts a line once. Null hosts form one host."""
    pages = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.array_distinct(F.filter(F.transform(lines(F.col(text_col)), line_key), lambda x: x.isNotNull())).alias("_lines"))
    # The host's total travels as a count of a key of its own, in the same shuffle.
    keys = F.concat(F.array(F.lit("")), F.col("_lines"))
    counts = pages.select("_host", F.explode(keys).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_pages"))
    counts = materialize(counts.where((F.col("_pages") >= min_pages) | (F.col("_line") == "")), "line-counts")
    totals = counts.where("_line = ''").select("_host", F.col("_pages").alias("_total"))
    return counts.where("_line <> ''").join(totals, "_host").where(F.col("_pages") > F.col("_total") * ratio).select("_host", "_line", "_pages")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast: int = BROADCAST, prefix: str = "_") -> DataFrame:
    """docs with `_text` (the text without its boilerplate lines), `_lines` and `_dropped` (numbers of lines).

    Every row stays, with all its columns, but for those of the three names; another prefix than `_` spares them. Blank lines stay too. A null text gives a null `_text` with no lines; an empty one stays empty.
    """
    bad = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    text, own = field(text_col), F.coalesce(field(host_col), F.lit(""))
    all_lines = lines(text)
    rows = wrapped(docs)
    if bad.count() <= broadcast:
        # Checked size: the lines of a host travel with it to every executor; texts are not shuffled.
        by_host = bad.groupBy("_host").agg(F.map_from_arrays(F.collect_list("_line"), F.collect_list(F.lit(True))).alias("_bad"))
        joined = rows.join(F.broadcast(by_host), own == F.col("_host"), "left")
        is_bad = lambda x: F.map_contains_key(F.col("_bad"), F.coalesce(line_key(x), F.lit("")))
    else:
        keyed = docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.col(host_col), F.lit("")).alias("_host"),
            F.explode(F.array_distinct(F.filter(F.transform(lines(F.col(text_col)), line_key), lambda x: x.isNotNull()))).alias("_line"),
        )
        hits = keyed.join(bad, ["_host", "_line"]).groupBy("_id", "_host").agg(F.collect_set("_line").alias("_bad"))
        joined = rows.join(hits, field(id_col).eqNullSafe(F.col("_id")) & (own == F.col("_host")), "left")
        is_bad = lambda x: F.array_contains(F.col("_bad"), F.coalesce(line_key(x), F.lit("")))
    kept = F.when(F.col("_bad").isNull() | text.isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~is_bad(x)))
    made = joined.withColumn("_kept", kept)
    n = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(all_lines)).cast("long")
    return unwrapped(made, docs.columns, {
        f"{prefix}text": F.when(text.isNotNull(), F.array_join("_kept", "\n")),
        f"{prefix}lines": n,
        f"{prefix}dropped": F.when(n == 0, F.lit(0)).otherwise(F.size(all_lines) - F.size("_kept")).cast("long"),
    })
