"""Queries of the evaluators and of packing, over the virtual annotation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B
from ..operators import evaluate as E
from ..operators import kernels as K
from ..operators.batched import by_group
from .registry import register
from .virtual import WITH, preds, shapes

def corners():
    return B.box("x0", "y0", "x1", "y1")



def _images(spark, sf_dir):
    """Each line number of a case is an image: the sides are kept small, and some images lack one."""
    gt = shapes(spark, sf_dir).where("score % 3 <> 0").select("case_id", F.col("shape_id").alias("id"), corners().alias("box"))
    dt = preds(spark, sf_dir).where("score % 4 <> 1").select("case_id", F.col("pred_id").alias("id"), (F.col("score") / 100.0 + 0.3).alias("score"), corners().alias("box"))
    spine = shapes(spark, sf_dir).select("case_id").distinct()
    return E.sided(gt, dt, ["case_id"], spine)


SIDES = f"""{WITH}, g AS (SELECT case_id, count(*) AS n FROM shapes WHERE score % 3 <> 0 GROUP BY case_id), d AS (SELECT case_id, count(*) AS n FROM preds WHERE score % 4 <> 1 AND score >= 20 GROUP BY case_id),
    i AS (SELECT s.case_id, coalesce(g.n, 0) AS n_gt, coalesce(d.n, 0) AS n_dt FROM (SELECT DISTINCT case_id FROM shapes) s LEFT JOIN g USING (case_id) LEFT JOIN d USING (case_id))"""


@register("cgf1_sides", f"{SIDES} SELECT case_id, n_gt, n_dt FROM i")
def _(spark, sf_dir):
    return E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long").where("thr = 0.5").select("case_id", "n_gt", "n_dt")


@register("cgf1_counts")
def _(spark, sf_dir):
    return E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long")


@register("cgf1_dataset")
def _(spark, sf_dir):
    return E.cgf1_dataset(E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long"))


@register(
    "il_mcc",
    f"""{SIDES}, c AS (SELECT count(*) FILTER (WHERE n_gt > 0 AND n_dt > 0) tp, count(*) FILTER (WHERE n_gt = 0 AND n_dt > 0) fp, count(*) FILTER (WHERE n_gt > 0 AND n_dt = 0) fn, count(*) FILTER (WHERE n_gt = 0 AND n_dt = 0) tn FROM i)
        SELECT tp, fp, fn, tn, round((tp * tn - fp * fn) / (sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6), 6) AS mcc FROM c""",
)
def _(spark, sf_dir):
    d = E.cgf1_dataset(E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long")).where("thr = 0.5")
    return d.select(F.col("il_tp").alias("tp"), F.col("il_fp").alias("fp"), F.col("il_fn").alias("fn"), F.col("il_tn").alias("tn"), F.round("il_mcc", 6).alias("mcc"))


@register("oracle_best_gt")
def _(spark, sf_dir):
    rows = _images(spark, sf_dir)
    two = rows.withColumn("truth", F.explode(F.array(F.lit(0), F.lit(1)))).where("truth = 0 OR side <> 0 OR id % 2 = 0")
    return E.best_of_truths(E.cgf1_images(two, ["case_id", "truth"], "case_id long, truth int"), ["case_id"], "truth")


@register("coco_ap")
def _(spark, sf_dir):
    rows = _images(spark, sf_dir)
    m = E.ap_matches(rows, ["case_id"], "case_id long").withColumn("cat", F.col("case_id") % 4)
    n = rows.where("side = 0").groupBy((F.col("case_id") % 4).alias("cat")).agg(F.count("*").alias("n_gt"))
    return E.average_precision(m, n, ["cat"], ["case_id", "id"])


@register("coco_summary")
def _(spark, sf_dir):
    rows = _images(spark, sf_dir)
    cat = (F.col("case_id") % 4).alias("cat")
    m = E.coco_matches(rows, ["case_id"], "case_id long").select("*", cat)
    return E.coco_summary(m, E.truths_by_area(rows.select("*", cat), ["cat"]), ["cat"], ["case_id", "id"])


@register("rarity_average")
def _(spark, sf_dir):
    """Line numbers are categories; those that few images have are rare."""
    rows = _images(spark, sf_dir)
    m = E.ap_matches(rows, ["case_id"], "case_id long").withColumn("cat", F.col("case_id") % 16)
    truth = rows.where("side = 0").withColumn("cat", F.col("case_id") % 16)
    ap = E.average_precision(m, truth.groupBy("cat").agg(F.count("*").alias("n_gt")), ["cat"], ["case_id", "id"]).groupBy("cat").agg(F.avg("ap").alias("ap"))
    return E.rarity_average(ap, truth.groupBy("cat").agg((F.count_distinct("case_id") * F.col("cat")).alias("n_images")).select("cat", "n_images"), "cat", 2000, 8000)


@register("metric_catalogue")
def _(spark, sf_dir):
    return E.catalogue(E.cgf1_dataset(E.cgf1_images(_images(spark, sf_dir), ["case_id"], "case_id long")))


def _tracks(spark, sf_dir):
    v, f = F.floor(F.col("case_id") / 320).alias("video_id"), (F.floor(F.col("case_id") / 32) % 10).alias("frame")

    def side(df, key, n):
        g = df.groupBy(v, f, F.col(key).alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        return g.select("video_id", "frame", F.lit(n).alias("side"), "id", corners().alias("box"))

    return side(shapes(spark, sf_dir), "line", 0).unionByName(side(preds(spark, sf_dir), "pred_id", 1))


@register("hota_components")
def _(spark, sf_dir):
    return E.with_final(E.hota_sequences(_tracks(spark, sf_dir), ["video_id"], "video_id long"))


@register("hota_combined")
def _(spark, sf_dir):
    return E.hota_combined(E.hota_sequences(_tracks(spark, sf_dir), ["video_id"], "video_id long"), [])


@register("teta_components")
def _(spark, sf_dir):
    rows = _tracks(spark, sf_dir).withColumn("cls", (F.col("id") % 2).cast("int"))
    return E.teta_combined(E.teta_sequences(rows, ["video_id"], "video_id long"), ["video_id"])


def _side_sql(key: str, rows: str) -> str:
    return f"SELECT case_id // 320 AS video_id, (case_id // 32) % 10 AS frame, {key} AS id FROM {rows} GROUP BY ALL"


@register(
    "count_metric",
    f"""{WITH}, g AS ({_side_sql('line', 'shapes')}), d AS ({_side_sql('pred_id', 'preds')}), u AS (SELECT *, 0 AS side FROM g UNION ALL SELECT *, 1 FROM d)
        SELECT video_id, count(*) FILTER (WHERE side = 1) AS dets, count(*) FILTER (WHERE side = 0) AS gt_dets, count(DISTINCT id) FILTER (WHERE side = 1) AS ids, count(DISTINCT id) FILTER (WHERE side = 0) AS gt_ids, count(DISTINCT frame) AS frames FROM u GROUP BY video_id""",
)
def _(spark, sf_dir):
    t, d = _tracks(spark, sf_dir), F.col("side") == 1
    return t.groupBy("video_id").agg(
        F.count_if(d).alias("dets"), F.count_if(~d).alias("gt_dets"), F.count_distinct(F.when(d, F.col("id"))).alias("ids"), F.count_distinct(F.when(~d, F.col("id"))).alias("gt_ids"), F.count_distinct("frame").alias("frames")
    )


@register("hungarian_match")
def _(spark, sf_dir):
    rows = _images(spark, sf_dir)

    def kernel(key, c):
        g = [(i, b) for i, b, s in zip(c["id"], c["box"], c["side"], strict=True) if s == 0]
        d = [(i, b) for i, b, s in zip(c["id"], c["box"], c["side"], strict=True) if s == 1]
        ious = K.box_ious(E._boxes([b for _, b in g]), E._boxes([b for _, b in d]))
        return [(*key, g[i][0], d[j][0], float(ious[i, j])) for i, j in K.assign(ious)]

    return by_group(rows, ["case_id"], ["side", "id"], kernel, "case_id long, gt_id long, dt_id long, iou double")


def _regions(spark, sf_dir):
    return shapes(spark, sf_dir).select("case_id", "shape_id", (F.col("x0") * 10).alias("x0"), (F.col("y0") * 10).alias("y0"), (F.col("x0") * 10 + (F.col("x1") - F.col("x0")) * 2).alias("x1"), (F.col("y0") * 10 + (F.col("y1") - F.col("y0")) * 2).alias("y1"))


PART = "case_id long, partition_id long, n long, x0 double, y0 double, x1 double, y1 double, members array<long>"


def partitions(rows, fov=(400.0, 400.0)):
    """Regions of interest clustered by case; those larger than the field are left out here and reported by `oversized`."""

    def kernel(key, c):
        keep = [(i, b) for i, *b in zip(c["shape_id"], c["x0"], c["y0"], c["x1"], c["y1"], strict=True) if b[2] - b[0] <= fov[0] and b[3] - b[1] <= fov[1]]
        out = []
        for p, ids in enumerate(K.cluster([b for _, b in keep], fov)):
            bs = [keep[i][1] for i in ids]
            out.append((*key, p, len(ids), float(min(b[0] for b in bs)), float(min(b[1] for b in bs)), float(max(b[2] for b in bs)), float(max(b[3] for b in bs)), [keep[i][0] for i in ids]))
        return out

    return by_group(rows, ["case_id"], ["shape_id"], kernel, PART)


def oversized(rows, fov=(400.0, 400.0)):
    """Regions that no field of view holds: must be none before partitions are cut out."""
    return rows.where((F.col("x1") - F.col("x0") > fov[0]) | (F.col("y1") - F.col("y0") > fov[1]))


@register("oversized_regions", f"{WITH} SELECT case_id, shape_id FROM shapes WHERE (x1 - x0) * 2 > 100 OR (y1 - y0) * 2 > 80")
def _(spark, sf_dir):
    return oversized(_regions(spark, sf_dir), (100.0, 80.0)).select("case_id", "shape_id")


@register("chc_cluster")
def _(spark, sf_dir):
    return partitions(_regions(spark, sf_dir))


def packed(parts, genetic: bool, size: int = 1008, **kw):
    """Partitions placed into bins by case: case_id, bin_id, partition_id, x, y, w, h, turned, utilisation, fitness."""

    def kernel(key, c):
        sizes = {p: (x1 - x0, y1 - y0) for p, x0, y0, x1, y1 in zip(c["partition_id"], c["x0"], c["y0"], c["x1"], c["y1"], strict=True)}
        if genetic:
            bins, fit, *_ = K.Genetic(sizes, size, size, **kw).run(history=False)
        else:
            bins = K.greedy_pack(sizes, size, size)
            fit = K.fitness(bins)
        return [(*key, b, *p, bin_.utilisation, fit) for b, bin_ in enumerate(bins or []) for p in bin_.placed]

    return by_group(parts, ["case_id"], ["partition_id"], kernel, "case_id long, bin_id long, partition_id long, x long, y long, w long, h long, turned boolean, utilisation double, fitness double")


@register("greedy_binpack")
def _(spark, sf_dir):
    return packed(partitions(_regions(spark, sf_dir)), False)


@register("ga_binpack")
def _(spark, sf_dir):
    """The genetic search, with its full budget of 50 x 20."""
    return packed(partitions(_regions(spark, sf_dir)), True)


@register("pack_fitness")
def _(spark, sf_dir):
    from ..operators.metrics import pack_fitness

    bins = packed(partitions(_regions(spark, sf_dir)), False).select("case_id", "bin_id", "utilisation").distinct()
    return pack_fitness(bins, ["case_id"])


@register(
    "grid_tiles",
    f"{WITH} SELECT case_id, shape_id, CAST(greatest(ceil((x1 - x0) / 27.0), 1) * greatest(ceil((y1 - y0) / 27.0), 1) AS BIGINT) AS tiles FROM shapes",
)
def _(spark, sf_dir):
    return shapes(spark, sf_dir).select("case_id", "shape_id", B.grid_tiles((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"), 30.0).alias("tiles"))


@register(
    "contained_regions",
    f"""{WITH} SELECT a.case_id, a.shape_id, b.shape_id AS region_id FROM shapes a JOIN shapes b ON a.case_id = b.case_id AND a.shape_id <> b.shape_id
        AND a.x0 >= b.x0 - 2 AND a.y0 >= b.y0 - 2 AND a.x1 <= b.x1 + 2 AND a.y1 <= b.y1 + 2""",
)
def _(spark, sf_dir):
    from ..operators.match import contained_in

    s = shapes(spark, sf_dir).select("case_id", "shape_id", corners().alias("box"))
    return contained_in(s, s.withColumnRenamed("shape_id", "region_id"), ["case_id"], -2.0).where("shape_id <> region_id").select("case_id", "shape_id", "region_id")


@register("containment_suppress")
def _(spark, sf_dir):
    """Three passes of order-dependent suppression of contained shapes (Q15, Q16)."""
    from ..operators.kernels import suppress_contained

    def kernel(key, c):
        rows = [(s / 100.0 + 0.2, (x0, y0, x1, y1)) for s, x0, y0, x1, y1 in zip(c["score"], c["x0"], c["y0"], c["x1"], c["y1"], strict=True)]
        ids = list(range(len(rows)))
        for _ in range(3):
            kept = suppress_contained([rows[i] for i in ids], 0.8)
            ids = [ids[k] for k in kept]
        return [(*key, c["shape_id"][i]) for i in ids]

    return by_group(shapes(spark, sf_dir).select("case_id", "shape_id", "score", "x0", "y0", "x1", "y1"), ["case_id"], ["shape_id"], kernel, "case_id long, shape_id long")
