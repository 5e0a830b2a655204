"""Queries of filters and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vec as V
from ..operators import filters as Q
from .registry import register, table
from .virtual import WITH, frames, preds, shapes


def _queries(spark, sf_dir):
    """A query for each order: its stage, its image (the customer) and its text."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 4).alias("stage"), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))).alias("text"))


def _objects(spark, sf_dir):
    s = shapes(spark, sf_dir)
    return s.select(F.col("case_id").alias("query_id"), F.concat("case_id", F.lit("/"), "shape_id").alias("object_id"), (F.col("x0") * 0).alias("x"), (F.col("score") - 60).alias("y"), (F.col("x0") * 0).alias("w"), (F.col("score") - 60).alias("h"), ((F.col("score") - 20) / 1e6).alias("area"), (F.col("line") == 3).alias("is_crowd"))


@register("filter_text", "SELECT o_orderkey AS query_id FROM orders WHERE lower(replace(o_orderpriority, '-', ' ')) NOT IN ('1 urgent', '5 low')")
def _(spark, sf_dir):
    return Q.without_texts(_queries(spark, sf_dir), [" 1 URGENT", "5 low "]).select("query_id")


@register("keep_max_queries", "SELECT o_custkey AS image_id, least(count(*), 3) AS n, CAST(least(count(*) FILTER (WHERE o_orderkey % 4 = 0), 3) AS BIGINT) AS positives FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    q = Q.keep_most(_queries(spark, sf_dir).withColumn("p", F.col("stage") == 0), ["image_id"], 3, "p")
    return q.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if("p").alias("positives"))


@register(
    "filter_zero_box",
    f"{WITH} SELECT DISTINCT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT case_id FROM shapes WHERE score <= 60)",
)
def _(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return Q.without_zero_boxes(_queries(spark, sf_dir), o.select("query_id", "object_id"), o).select("query_id")


@register("filter_too_many", f"{WITH} SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT case_id FROM shapes GROUP BY case_id HAVING count(*) > 4)")
def _(spark, sf_dir):
    return Q.without_many_outputs(_queries(spark, sf_dir), _objects(spark, sf_dir), 4).select("query_id")


@register("filter_objects", f"{WITH} SELECT case_id AS query_id, count(*) AS n FROM shapes WHERE score > 20 AND line <> 3 GROUP BY case_id")
def _(spark, sf_dir):
    return Q.usable_objects(_objects(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"))


@register(
    "filter_applicator_reids",
    """WITH q AS (SELECT o_custkey AS g, o_orderkey AS query_id, o_orderkey % 4 AS stage FROM orders WHERE o_orderkey % 3 <> 0),
        k AS (SELECT * FROM q WHERE g IN (SELECT g FROM q WHERE stage = 0))
        SELECT g, query_id, CAST(dense_rank() OVER (PARTITION BY g ORDER BY query_id) - 1 AS BIGINT) AS new_query, CAST(dense_rank() OVER (PARTITION BY g ORDER BY stage) - 1 AS BIGINT) AS new_stage FROM k""",
)
def _(spark, sf_dir):
    q = _queries(spark, sf_dir).where("query_id % 3 <> 0").withColumn("g", F.col("image_id"))
    images = q.select("g", "image_id").distinct()
    objects = _objects(spark, sf_dir).select("query_id", "object_id").join(q.select("query_id", "g", "image_id"), "query_id").drop("query_id")
    outputs = _objects(spark, sf_dir).select("query_id", "object_id").join(q.select("query_id", "g"), "query_id")
    return Q.applied(q, images, objects, outputs, ["g"])[0].select("g", "query_id", F.col("new_query").cast("long"), F.col("new_stage").cast("long"))


@register(
    "filter_applicator_objects",
    """WITH q AS (SELECT o_custkey AS g, o_orderkey AS query_id, o_orderkey % 4 AS stage FROM orders WHERE o_orderkey % 3 <> 0),
        k AS (SELECT * FROM q WHERE g IN (SELECT g FROM q WHERE stage = 0)) SELECT k.g, count(*) AS n FROM k JOIN lineitem ON l_orderkey = query_id GROUP BY k.g""",
)
def _(spark, sf_dir):
    q = _queries(spark, sf_dir).where("query_id % 3 <> 0").withColumn("g", F.col("image_id"))
    images = q.select("g", "image_id").distinct()
    objects = _objects(spark, sf_dir).select("query_id", "object_id").join(q.select("query_id", "g", "image_id"), "query_id").drop("query_id")
    outputs = _objects(spark, sf_dir).select("query_id", "object_id").join(q.select("query_id", "g"), "query_id")
    return Q.applied(q, images, objects, outputs, ["g"])[3].groupBy("g").agg(F.count("*").alias("n"))


@register("prefix_suffix", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 = 0 THEN 'a ' || lower(replace(o_orderpriority, '-', ' ')) || '.' ELSE lower(replace(o_orderpriority, '-', ' ')) END AS text FROM orders")
def _(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", Q.with_affixes(F.col("text"), "a ", ".", F.col("stage") == 0).alias("text"))


@register("hide_objects", f"{WITH} SELECT case_id, shape_id FROM shapes s WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.case_id = s.case_id AND p.pred_id = s.shape_id AND p.score < 30) AND score % 5 <> 0")
def _(spark, sf_dir):
    s, p = shapes(spark, sf_dir), preds(spark, sf_dir).withColumnRenamed("pred_id", "shape_id")
    return Q.shown(s.select("case_id", "shape_id"), [p.where("score < 30"), s.where("score % 5 = 0")], ["case_id", "shape_id"])


@register(
    "best_mask",
    f"""{WITH}, m AS (SELECT case_id, shape_id, greatest(score - 50, 0) AS iou, (x0 * 7) % 100 AS score FROM shapes), v AS (SELECT *, CASE WHEN max(iou) OVER (PARTITION BY case_id) > 0 THEN iou ELSE score END AS v FROM m)
        SELECT case_id, shape_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, shape_id) r FROM v) WHERE r = 1""",
)
def _(spark, sf_dir):
    m = shapes(spark, sf_dir).select("case_id", "shape_id", F.greatest(F.col("score") - 50, F.lit(0)).alias("iou"), (F.col("x0") * 7 % 100).alias("score"))
    return Q.best_mask(m, ["case_id"], "shape_id")


@register("new_object_limit", f"{WITH}, r AS (SELECT case_id, pred_id AS det_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pred_id) k FROM preds) SELECT case_id, det_id FROM r WHERE k <= 4 - case_id % 3")
def _(spark, sf_dir):
    d = preds(spark, sf_dir).select("case_id", F.col("pred_id").alias("det_id"), "score", (F.col("case_id") % 3).alias("tracked"))
    return Q.limited_new(d, ["case_id"], "tracked", 4).select("case_id", "det_id")


@register("positive_split", f"{WITH} SELECT p.case_id, p.pred_id FROM preds p WHERE EXISTS (SELECT 1 FROM shapes s WHERE s.case_id = p.case_id AND s.line % 3 = p.pred_id % 3)")
def _(spark, sf_dir):
    d = preds(spark, sf_dir).select("case_id", "pred_id", (F.col("pred_id") % 3).alias("cat"))
    return Q.with_truth(d, shapes(spark, sf_dir).select("case_id", (F.col("line") % 3).alias("cat")), ["case_id", "cat"]).select("case_id", "pred_id")


@register("stage_sample", f"{WITH}, t AS (SELECT track_id, max(frame - 1) + 1 AS n FROM frames GROUP BY ALL), s AS (SELECT track_id, greatest(least(7, (n - 2) // 3), 1) AS step FROM t) SELECT f.track_id, f.frame - 1 AS stage, (f.frame - 2) // step AS new_stage FROM frames f JOIN s USING (track_id) WHERE f.frame >= 2 AND (f.frame - 2) % step = 0 AND (f.frame - 2) // step < 4")
def _(spark, sf_dir):
    f = frames(spark, sf_dir).select("track_id", (F.col("frame") - 1).alias("stage"))
    return Q.staged(f, ["track_id"], 4, 7, 1).select("track_id", "stage", "new_stage")


@register("tile_frames", "SELECT r_regionkey, CAST(f AS INT) AS frame FROM region, range(0, 5) t(f)")
def _(spark, sf_dir):
    return Q.tiled(table(spark, sf_dir, "region").select("r_regionkey"), 5)


@register("edge_suppressed", f"{WITH} SELECT case_id, shape_id FROM shapes WHERE NOT ((x0 + x1) / 400.0 < 0.25 OR (x0 + x1) / 400.0 > 0.75 OR (y0 + y1) / 400.0 < 0.25 OR (y0 + y1) / 400.0 > 0.75)")
def _(spark, sf_dir):
    from ..functions import box as B

    n = B.normalised(B.box("x0", "y0", "x1", "y1"), 200, 200)
    return shapes(spark, sf_dir).where(~B.near_edge(n, 0.25)).select("case_id", "shape_id")


@register("presence_threshold", f"{WITH} SELECT case_id, shape_id, round(1 / (1 + exp(-(score - 50) / 10.0)), 6) AS p FROM shapes WHERE score > 60")
def _(spark, sf_dir):
    p = V.sigmoid((F.col("score") - 50) / 10.0)
    return shapes(spark, sf_dir).withColumn("q", p).where(F.col("q") > 1 / (1 + 2.718281828459045**-1.0) + 1e-9).select("case_id", "shape_id", F.round("q", 6).alias("p"))


#: Punctuation of ASCII in SQL.
PUNCT = X.PUNCTUATION.replace("'", "''")


@register("text_canonicalize", f"SELECT doc_id, sha256(trim(regexp_replace(lower(translate(replace(text, '_', ' '), '{PUNCT}', '')), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.canonical(F.col("text")), 256).alias("digest"))


@register(
    "text_clean",
    """SELECT page_id, sha256(trim(regexp_replace(lower(trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS digest FROM pages""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.lowered(X.cleaned(F.col("html"))), 256).alias("digest"))


@register("token_regex", "SELECT conv_id, turn, len(regexp_extract_all(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '''s|''t|''re|''ve|''m|''ll|''d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+')) AS n FROM conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


@register("context_pad", "SELECT conv_id, turn, CAST(least(len(string_split(text, ' ')) + 2, 16) AS BIGINT) AS used, CAST(16 AS BIGINT) AS n FROM conversations")
def _(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 1)
    c = X.context(ids, 49406, 49407, 16)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(c, lambda i: i != 0)).cast("long").alias("used"), F.size(c).cast("long").alias("n"))


@register("evaluated_images", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    truths = [o.select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % m != 0).alias("is_instance_exhaustive")) for m in (3, 5, 7)]
    return Q.evaluated_images(truths)


@register("excluded_images", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return Q.excluded_images([o.select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % m != 0).alias("is_instance_exhaustive")) for m in (5, 7)])


@register("filter_geometric", f"{WITH} SELECT o_orderkey AS query_id FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT case_id FROM shapes WHERE score > 70))")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 4 == 0, "geometric").otherwise("wire").alias("text"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(1.0))).alias("input_box"))
    return Q.without_empty_geometric(q, shapes(spark, sf_dir).where("score > 70").select(F.col("case_id").alias("query_id"))).select("query_id")


@register("semantic_only", "SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(1.0))).alias("input_box"))
    return Q.semantic_only(q).select("query_id")


@register("exhaustive_queries", "SELECT 'instance' AS kind, o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'pixel', o_orderkey FROM orders WHERE o_orderkey % 3 <> 2")
def _(spark, sf_dir):
    flag = F.when(F.col("o_orderkey") % 3 == 1, True).when(F.col("o_orderkey") % 3 == 2, False)
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), flag.alias("is_exhaustive"), flag.alias("is_pixel_exhaustive"))
    made = [Q.exhaustive(q, k).select(F.lit(k).alias("kind"), "query_id") for k in ("instance", "pixel")]
    return made[0].unionByName(made[1])


@register("category_whitelist", f"{WITH} SELECT case_id, shape_id FROM shapes WHERE line IN (1, 4, 6)")
def _(spark, sf_dir):
    return Q.listed(shapes(spark, sf_dir), [1, 4, 6], "line").select("case_id", "shape_id")


@register("roi_split", f"{WITH} SELECT case_id, shape_id, x1 - x0 > 50 OR y1 - y0 > 40 AS large FROM shapes")
def _(spark, sf_dir):
    from ..functions import box as B

    large, small = Q.split_by_size(shapes(spark, sf_dir).withColumn("box", B.box("x0", "y0", "x1", "y1")), 50, 40)
    return large.select("case_id", "shape_id", F.lit(True).alias("large")).unionByName(small.select("case_id", "shape_id", F.lit(False).alias("large")))


@register("valid_masks", f"{WITH} SELECT case_id, pred_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pred_id) - 1 AS place FROM preds WHERE score % 9 >= 5")
def _(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("mask", F.repeat(F.lit("a"), (F.col("score") % 9).cast("int")))
    return Q.valid_masks(p, ["case_id"]).select("case_id", "pred_id", F.col("place").cast("long").alias("place"))


@register(
    "loaded_videos",
    f"""{WITH}, n AS (SELECT case_id AS video_id, count(*) FILTER (WHERE score % 2 = 0) AS n FROM shapes GROUP BY ALL), ok AS (SELECT video_id FROM n WHERE n <= 1),
        f AS (SELECT a.video_id AS asked, coalesce(b.video_id, (SELECT min(video_id) FROM ok)) AS video_id FROM n a ASOF LEFT JOIN ok b ON a.video_id <= b.video_id)
        SELECT asked, f.video_id, shape_id AS query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score, shape_id) - 1 AS BIGINT) AS place, true AS is_exhaustive FROM f JOIN shapes s ON s.case_id = f.video_id""",
)
def _(spark, sf_dir):
    s = shapes(spark, sf_dir)
    q = s.select(F.col("case_id").alias("video_id"), F.col("shape_id").alias("query_id"), F.col("score").alias("query_processing_order"), F.col("is_error").alias("is_exhaustive"))
    o = s.select(F.col("case_id").alias("video_id"), (F.col("score") % 2).alias("image_id"))
    return Q.loaded_videos(q, o, 1, True).select("asked", "video_id", "query_id", F.col("place").cast("long").alias("place"), "is_exhaustive")


@register("editor_list", f"{WITH} SELECT case_id, shape_id, shape_id IN (1, 3) AS is_selected FROM shapes WHERE shape_id <> 2")
def _(spark, sf_dir):
    return Q.edited(shapes(spark, sf_dir), [1, 3], [2]).select("case_id", "shape_id", "is_selected")


@register("remapped_names", "SELECT o_orderkey, 'remapped_vid_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/' || o_orderpriority AS name FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.remapped_name(F.col("o_orderkey"), F.col("o_orderpriority")).alias("name"))

