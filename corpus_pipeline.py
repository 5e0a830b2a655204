"""From raw documents to packed training sequences.

Stages run one after another; what each returns is written as Parquet and read again as the
documents of the next. All but the last return the columns of documents. Documents may have other columns of any
name, which stay as they are; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolyte.llm.common import WORD, free_prefix, materialize, table, without_spaces
from annolyte.llm.line_dedup import drop_boilerplate
from annolyte.llm.near_dedup import keep_one_of_each
from annolyte.llm.packing import pack
from annolyte.llm.secret_scan import scan
from annolyte.llm.toxicity import held_out, keep_nontoxic, train
from annolyte.shipping import ship


def _with_text(made: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with another text, and n_chars as it follows from that."""
    changed = {"text": F.col(text), "n_chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")}
    return made.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the model's base score and stay. Rows that repeat are judged alike. Without labels nothing goes.
    """
    ship(spark)
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return keep_nontoxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays.

    Null texts stay null, documents without a source share one. Each row is a page of its host.
    """
    prefix = free_prefix(docs.columns)
    return _with_text(drop_boilerplate(docs, prefix=prefix), docs.columns, f"{prefix}text")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id; of rows that repeat an id one stays.

    Texts without words are like no other and stay, as do rows without an id.
    """
    ship(spark)
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. Null texts stay null."""
    prefix = free_prefix(docs.columns)
    return _with_text(scan(docs, prefix=prefix), docs.columns, f"{prefix}redacted")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins: doc_id, piece, start, length, shard, bin, fill, in words.

    Texts without words are pieces of length 0. Rows that repeat are packed as often as they occur; null ids are dealt out by place.
    """
    ship(spark)
    sized = docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"),
        F.xxhash64(without_spaces(F.col("text"))).alias("cluster"),
    )
    return pack(sized, "doc_id", "words", "source", "cluster")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted classifier, set joins and packing have no SQL form. Tests hold `run` against a plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
