"""One query for each corpus operator, over its whole tables, and the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .chat_format import format_chats, loss_texts, read_turns
from .common import WORD, table, without_spaces
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints_of_edits
from .language_id import identify
from .line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from .ngram_join import jaccard_components
from .packing import pack
from .secret_scan import scan
from .sentencepiece_bpe import encoding_digests
from .toxicity import THRESHOLD, held_out, score_texts, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        @functools.wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = shipped
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_language_id")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return made.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "host", "lang", "prob", "text_lang", "declared", "suffix",
    )


@query(
    "op2_exact_dedup",
    r"""WITH t AS (
          SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT doc_id, length(x) AS n, sha256(norm) AS text_sha256 FROM t),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM k)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: A turn whose text holds the marks of the template: given by the query's contract.
MARKED = "<|im_end|><|im_start|>assistant ok"


@query(
    "op3_chat_format",
    rf"""WITH c AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'),
        e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(n + length(role) + {len("<|im_start|>") + len("<|im_end|>") + 2}) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT -1L AS conv_id, inline(array(struct(0L AS turn, 'user' AS role, '{MARKED}' AS text), struct(1L AS turn, 'assistant' AS role, '{MARKED}' AS text)))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    made = format_chats(records)
    back = made.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op4_ngram_jaccard")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its candidates, findings, and the digest of its redacted text."""
    made = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("_candidates").alias("n_candidates"),
        F.size("_findings").cast("long").alias("n_findings"),
        F.col("_findings").alias("findings"),
        F.sha2(F.coalesce("_redacted", F.lit("")), 256).alias("redacted_sha256"),
    )


@query("op6_toxicity")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op7_best_fit_packing")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents in bins of 4096; equal texts (without white space) are a duplicate cluster."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"),
        F.xxhash64(without_spaces(F.col("text"))).alias("cluster"),
    )
    return pack(docs, "doc_id", "words", "source", "cluster")


@query(
    "op8_line_dedup",
    rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
        k AS (SELECT doc_id, host, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
        c AS (SELECT host, bare, count(DISTINCT doc_id) AS pages FROM k WHERE bare <> '' GROUP BY host, bare),
        t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
        b AS (SELECT host, bare FROM c JOIN t USING (host) WHERE pages > total * {RATIO} AND pages >= {MIN_PAGES}),
        m AS (SELECT k.doc_id, k.pos, k.line, b.bare IS NOT NULL AS bad FROM k LEFT JOIN b ON k.host = b.host AND k.bare = b.bare)
        SELECT doc_id, CASE WHEN count(*) = 1 AND max(line) = '' THEN 0 ELSE count(*) END AS n_lines,
          count(*) FILTER (WHERE bad) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS text_sha256
        FROM m GROUP BY doc_id""",
)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return made.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("text_sha256"))


@query("op9_fingerprints")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
