"""One document of each near-duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, may_be_in
from .ngram_join import jaccard_components


#: The id's name in tables joined to the input's, which may have any other column.
OWN = "_near_duplicate_of_id"


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of their component; all columns stay.

    Documents that link with nothing stay, as do rows without an id. Of rows that repeat an id, the one
    of the least text stays (nulls last), and of these the first as JSON.
    Only the ids of rows to drop are joined back, and only to rows that a small filter takes for such.
    """
    found = materialize(jaccard_components(docs, id_col, text_col).withColumnsRenamed({id_col: OWN}), "near")
    ids = found.where(F.col(OWN).isNotNull())
    drop = ids.where(F.col(OWN) != F.col("component_id")).select(OWN).distinct()
    drop = materialize(drop, "drop")
    # Rows that a filter of fixed size finds clean take no part in the join.
    suspect = may_be_in(drop, OWN, F.col(id_col).cast("bigint"))
    kept = docs.where(~suspect).unionByName(docs.where(suspect).join(drop, F.col(id_col) == F.col(OWN), "left_anti"))
    repeated = ids.groupBy(OWN).agg(F.count("*").alias("n")).where("n > 1").select(OWN)
    if not repeated.take(1):
        return kept
    repeated = materialize(repeated, "repeated")
    once = kept.join(repeated, F.col(id_col) == F.col(OWN), "left_anti")
    again = kept.join(repeated, F.col(id_col) == F.col(OWN), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = again.groupBy(F.col(id_col).alias(OWN)).agg(F.min_by(row, F.struct(F.col(text_col).isNull(), F.col(text_col), F.to_json(row))).alias("_first"))
    return once.unionByName(first.select("_first.*"))
