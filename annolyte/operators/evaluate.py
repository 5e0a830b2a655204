"""Evaluators: concept-gated F1, average precision, and tracking accuracy (HOTA, TETA)."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stored import materialize
from .batched import by_group
from .kernels import assign, box_ious

#: Thresholds: fixed values.
IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))
EPS = np.finfo("float").eps


def _boxes(values: list) -> np.ndarray:
    return np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in values], float).reshape(-1, 4)


def sided(gt: DataFrame, dt: DataFrame, by: list[str], spine: DataFrame | None = None) -> DataFrame:
    """Ground truth (side 0) and detections (side 1) in one table: by, side, id, score, box. spine: groups that count even if empty (side 2)."""
    a = gt.select(*by, F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), F.lit(1.0).alias("score"), "box")
    b = dt.select(*by, F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), "box")
    out = a.unionByName(b)
    if spine is not None:
        none = F.lit(None)
        out = out.unionByName(spine.select(*by, F.lit(2).alias("side"), none.cast("long").alias("id"), none.cast("double").alias("score"), none.cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("box")))
    return out


def cgf1_images(rows: DataFrame, by: list[str], keys: str, least: float = 0.5) -> DataFrame:
    """Counts of each image at ten thresholds: by, thr, n_gt, n_dt, tp, fp, fn, f1.

    rows as `sided` gives them, keys their DDL. Detections below `least` are left out; the rest are matched
    one to one for the greatest total IoU.
    """

    def kernel(key: tuple, c: dict) -> list[tuple]:
        g = _boxes([b for b, s in zip(c["box"], c["side"], strict=True) if s == 0])
        d = _boxes([b for b, s, p in zip(c["box"], c["side"], c["score"], strict=True) if s == 1 and p >= least])
        ious = box_ious(d, g)
        got = np.array([ious[i, j] for i, j in assign(ious)])
        out = []
        for t in IOU_THRESHOLDS:
            tp = int((got >= t).sum())
            fp, fn = len(d) - tp, len(g) - tp
            p, r = tp / (tp + fp + 1e-4), tp / (tp + fn + 1e-4)
            out.append((*key, t, len(g), len(d), tp, fp, fn, 2 * p * r / (p + r + 1e-4)))
        return out

    return by_group(rows, by, ["side", "id"], kernel, f"{keys}, thr double, n_gt long, n_dt long, tp long, fp long, fn long, f1 double")


def cgf1_dataset(images: DataFrame) -> DataFrame:
    """The data set's metrics at each threshold, from `cgf1_images`.

    Images without either side only count at image level. cgF1 is the micro F1 over positive images times the
    image-level correlation (MCC).
    """
    gt, dt = F.col("n_gt") > 0, F.col("n_dt") > 0
    a = images.groupBy("thr").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.coalesce(F.sum(F.when(gt, F.col("fp"))), F.lit(0)).alias("pfp"),
        F.avg(F.when(gt & dt, F.col("f1"))).alias("_pf"),
        F.sum(F.when(gt, F.col("f1"))).alias("_sf"), F.count_if(gt & dt).alias("_nf"),
        F.count_if(gt & dt).alias("il_tp"), F.count_if(~gt & dt).alias("il_fp"), F.count_if(gt & ~dt).alias("il_fn"), F.count_if(~gt & ~dt).alias("il_tn"),
    )
    col = F.col
    div = lambda x, y, e: x / (y + e)
    harm = lambda p, r, e: 2 * p * r / (p + r + e)
    a = a.withColumns({
        "precision": div(col("tp"), col("tp") + col("fp"), 1e-4), "recall": div(col("tp"), col("tp") + col("fn"), 1e-4), "positive_precision": div(col("tp"), col("tp") + col("pfp"), 1e-4),
        "il_precision": div(col("il_tp"), col("il_tp") + col("il_fp"), 1e-6), "il_recall": div(col("il_tp"), col("il_tp") + col("il_fn"), 1e-6), "il_fpr": div(col("il_fp"), col("il_fp") + col("il_tn"), 1e-6),
        "il_mcc": (col("il_tp") * col("il_tn") - col("il_fp") * col("il_fn")) / (F.sqrt((col("il_tp") + col("il_fp")).cast("double") * (col("il_tp") + col("il_fn")) * (col("il_tn") + col("il_fp")) * (col("il_tn") + col("il_fn"))) + 1e-6),
    })
    a = a.withColumns({
        "f1": harm(col("precision"), col("recall"), 1e-4), "positive_micro_f1": harm(col("positive_precision"), col("recall"), 1e-4),
        "positive_macro_f1": F.coalesce(col("_sf") / F.nullif(col("_nf"), F.lit(0)), F.lit(0.0)), "il_f1": harm(col("il_precision"), col("il_recall"), 1e-6),
    })
    return a.withColumn("cgf1", col("positive_micro_f1") * col("il_mcc")).drop("_pf", "_sf", "_nf")


def best_of_truths(images: DataFrame, by: list[str], truth: str) -> DataFrame:
    """Of several ground truths of an image, the one of the best mean F1; the first of equals."""
    mean = images.groupBy(*by, truth).agg(F.avg("f1").alias("mean"))
    return mean.groupBy(*by).agg(F.max_by(F.struct(truth, "mean"), F.struct(F.col("mean"), -F.col(truth))).alias("b")).select(*by, f"b.{truth}", "b.mean")


def ap_matches(rows: DataFrame, by: list[str], keys: str, most: int = 100) -> DataFrame:
    """by, thr, id, score, hit: detections of each image, best score first, each taking the free ground truth of highest IoU."""

    def kernel(key: tuple, c: dict) -> list[tuple]:
        g = _boxes([b for b, s in zip(c["box"], c["side"], strict=True) if s == 0])
        dets = sorted(((-p, i, b) for b, s, p, i in zip(c["box"], c["side"], c["score"], c["id"], strict=True) if s == 1), key=lambda x: x[:2])[:most]
        ious = box_ious(_boxes([b for _, _, b in dets]), g)
        out = []
        for t in IOU_THRESHOLDS:
            taken = np.zeros(len(g), bool)
            for k, (p, i, _) in enumerate(dets):
                best, at = min(t, 1 - 1e-10), -1
                for j in range(len(g)):
                    if not taken[j] and ious[k, j] >= best:
                        best, at = ious[k, j], j
                if at >= 0:
                    taken[at] = True
                out.append((*key, t, i, -p, at >= 0))
        return out

    return by_group(rows, by, ["side", "id"], kernel, f"{keys}, thr double, id long, score double, hit boolean")


#: Area ranges in pixels, and numbers of detections an image is judged by: fixed values.
AREAS = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))
MOST_DETECTIONS = (1, 10, 100)


def judged(key: tuple, dets: list[tuple[int, float]], near: list[list[float]], size_d: list[float], size_g: list[float], many: list[bool], areas: tuple) -> list[tuple]:
    """(key, area, thr, id, rank, score, hit) of the detections (id, -score), best first, that count in each area range.

    near: their IoUs with all ground truth; many: ground truth that may be matched again and doesn't count.
    """
    out = []
    for name, low, high in areas:
        aside = [c or not low <= x <= high for c, x in zip(many, size_g, strict=True)]
        for t in IOU_THRESHOLDS:
            taken: set[int] = set()
            least = min(t, 1 - 1e-10)
            for k, (i, p) in enumerate(dets):
                # One that counts before one that doesn't, then by IoU; of equals the last, as each later one that is no worse takes over.
                best = max(((not aside[j], v, j) for j, v in enumerate(near[k]) if v >= least and (many[j] or j not in taken)), default=None)
                if best:
                    taken.add(best[2])
                if best[0] if best else low <= size_d[k] <= high:
                    out.append((*key, name, t, i, k + 1, -p, best is not None))
    return out


def judged_bits(dets: list[tuple[int, float]], near: list[list[float]], size_d: list[float], size_g: list[float], many: list[bool], areas: tuple) -> list[tuple]:
    """As `judged`, a row (area, id, rank, score, counts, hits) for all thresholds, each of which has a bit in the last two.

    Matching depends on which ground truth counts and which IoUs reach the threshold, so ranges and thresholds that agree in this are matched once.
    """
    values = sorted({v for row in near for v in row})
    leasts = [min(t, 1 - 1e-10) for t in IOU_THRESHOLDS]
    levels = [bisect.bisect_left(values, least) for least in leasts]
    done: dict[tuple, list[tuple[int, int]]] = {}

    def masks(aside: tuple, inside: tuple) -> list[tuple[int, int]]:
        out = [(0, 0)] * len(dets)
        for level in dict.fromkeys(levels):
            least = leasts[levels.index(level)]
            bits = sum(1 << n for n, x in enumerate(levels) if x == level)
            taken: set[int] = set()
            for k in range(len(dets)):
                best = max(((not aside[j], v, j) for j, v in enumerate(near[k]) if v >= least and (many[j] or j not in taken)), default=None)
                if best:
                    taken.add(best[2])
                if best[0] if best else inside[k]:
                    out[k] = out[k][0] | bits, out[k][1] | (bits if best else 0)
        return out

    rows = []
    for name, low, high in areas:
        key = tuple(c or not low <= x <= high for c, x in zip(many, size_g, strict=True)), tuple(low <= x <= high for x in size_d)
        if all(key[0]) and not any(key[1]):
            continue
        if key not in done:
            done[key] = masks(*key)
        rows += [(name, i, k + 1, -p, *done[key][k]) for k, (i, p) in enumerate(dets) if done[key][k][0]]
    return rows


def coco_matches(rows: DataFrame, by: list[str], keys: str, areas: tuple = AREAS, most: int = 100) -> DataFrame:
    """by, area, thr, id, rank, score, hit: as `ap_matches`, for each area range; detections that count neither way are left out.

    Ground truth outside the range, or marked by a column `crowd`, may be matched but doesn't count, nor does its detection; one that counts is
    preferred. Unmatched detections outside the range don't count. A crowd may match several, by the share of the detection inside it.
    """
    crowds = "crowd" in rows.columns

    def kernel(key: tuple, c: dict) -> list[tuple]:
        sides = list(zip(c["side"], c["box"], c["score"], c["id"], c["crowd"] if crowds else [False] * len(c["id"]), strict=True))
        g, crowd = _boxes([b for s, b, *_ in sides if s == 0]), np.array([bool(x) for s, _, _, _, x in sides if s == 0], bool)
        dets = sorted(((-p, i, b) for s, b, p, i, _ in sides if s == 1), key=lambda x: x[:2])[:most]
        d = _boxes([b for _, _, b in dets])
        size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        ious = box_ious(d, g)
        if crowd.any():
            wide = np.minimum(d[:, None, 2:], g[None, :, 2:]) - np.maximum(d[:, None, :2], g[None, :, :2])
            ious = np.where(crowd[None], wide.clip(0).prod(2) / np.maximum(size(d), EPS)[:, None], ious)
        return [(*key, *r) for r in judged_bits([(i, p) for p, i, _ in dets], ious.tolist(), size(d).tolist(), size(g).tolist(), crowd.tolist(), areas)]

    found = by_group(rows, by, ["side", "id"], kernel, f"{keys}, area string, id long, rank int, score double, counts int, hits int")
    found = materialize(found, "matches")  # it's read several times, and each would run the kernel again
    thresholds = F.array(*[F.struct(F.lit(1 << n).alias("bit"), F.lit(t).alias("thr")) for n, t in enumerate(IOU_THRESHOLDS)])
    each = found.withColumn("t", F.explode(thresholds)).where(F.col("counts").bitwiseAND(F.col("t.bit")) > 0)
    return each.select(*by, "area", F.col("t.thr").alias("thr"), "id", "rank", "score", (F.col("hits").bitwiseAND(F.col("t.bit")) > 0).alias("hit"))


def truths_by_area(rows: DataFrame, cat: list[str], areas: tuple = AREAS) -> DataFrame:
    """cat, area, n_gt: ground truth that counts in each range."""
    b = F.col("box")
    size = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    g = rows.where(F.col("side") == 0)
    g = g.where(~F.coalesce(F.col("crowd"), F.lit(False))) if "crowd" in rows.columns else g
    within = F.array_compact(F.array(*[F.when((size >= low) & (size <= high), F.lit(name)) for name, low, high in areas]))
    return g.select(*cat, F.explode(within).alias("area")).groupBy(*cat, "area").agg(F.count("*").alias("n_gt"))


def coco_summary(matches: DataFrame, totals: DataFrame, cat: list[str], order: list[str], most: tuple = MOST_DETECTIONS) -> DataFrame:
    """metric, value: AP, AP50, AP75, AP by area, AR by number of detections and by area, as means over categories that have ground truth.

    matches as `coco_matches`, with the columns of cat; totals as `truths_by_area`. A metric without any such category is -1.
    """
    ap = average_precision(matches, totals, [*cat, "area"], order)
    ap = totals.select(*cat, "area").crossJoin(matches.sparkSession.createDataFrame([(t,) for t in IOU_THRESHOLDS], "thr double")).join(ap, [*cat, "area", "thr"], "left").na.fill(0.0, ["ap"])
    limit = F.explode(F.array(*[F.lit(m) for m in most])).alias("most")
    hits = matches.select(*cat, "area", "thr", "rank", "hit", limit).where("rank <= most AND hit").groupBy(*cat, "area", "thr", "most").agg(F.count("*").alias("tp"))
    spine = totals.crossJoin(matches.sparkSession.createDataFrame([(t, m) for t in IOU_THRESHOLDS for m in most], "thr double, most int"))
    ar = spine.join(hits, [*cat, "area", "thr", "most"], "left").withColumn("ar", F.coalesce("tp", F.lit(0)) / F.col("n_gt"))
    named = [("AP", ap, "area = 'all'", "ap"), ("AP50", ap, "area = 'all' AND thr = 0.5", "ap"), ("AP75", ap, "area = 'all' AND thr = 0.75", "ap")]
    named += [(f"AP_{a}", ap, f"area = '{a}'", "ap") for a, *_ in AREAS[1:]]
    named += [(f"AR{m}", ar, f"area = 'all' AND most = {m}", "ar") for m in most]
    named += [(f"AR_{a}", ar, f"area = '{a}' AND most = {max(most)}", "ar") for a, *_ in AREAS[1:]]
    each = lambda rows, column: rows.agg(*[F.coalesce(F.avg(F.when(F.expr(cond), F.col(column))), F.lit(-1.0)).alias(name) for name, _, cond, c in named if c == column])
    tall = lambda wide: wide.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in wide.columns]), F.array(*wide.columns))).alias("metric", "value"))
    return tall(each(ap, "ap")).unionByName(tall(each(ar, "ar")))


def rarity_average(ap: DataFrame, images: DataFrame, cat: str, rare: int = 10, common: int = 100) -> DataFrame:
    """bucket, ap, n: mean AP of categories on up to `rare` images, up to `common`, and more; and `all`, the mean of the buckets.

    ap: cat, ap; images: cat, n_images.
    """
    kind = F.when(F.col("n_images") <= rare, "rare").when(F.col("n_images") <= common, "common").otherwise("frequent")
    per = ap.join(images, cat).groupBy(kind.alias("bucket")).agg(F.avg("ap").alias("ap"), F.count("*").alias("n"))
    return per.unionByName(per.agg(F.lit("all").alias("bucket"), F.avg("ap").alias("ap"), F.sum("n").alias("n")))


#: Score ranges that detections are ranked in side by side, for each unit of score.
RANGES = 1024


def average_precision(matches: DataFrame, totals: DataFrame, cat: list[str], order: list[str], points: int = 101) -> DataFrame:
    """cat, thr, ap: precision at `points` recalls, from detections ranked over all images.

    totals: cat, n_gt. Precision at a recall is the best at it or beyond; 0 where it is never reached. Detections are ranked within ranges of their
    score, and the sums of the ranges above are added, so that no category is ordered in one task.
    """
    key = [*cat, "thr"]
    m = matches.withColumns({"_range": F.floor(F.col("score") * RANGES), "_hit": F.col("hit").cast("long")})
    sums = m.groupBy(*key, "_range").agg(F.count("*").alias("_n0"), F.sum("_hit").alias("_tp0"))
    above = Window.partitionBy(*key).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_range", F.coalesce(F.sum("_n0").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_tp0").over(above), F.lit(0)).alias("_tp0"))
    w = Window.partitionBy(*key, "_range").orderBy(F.desc("score"), *order)
    ranked = m.withColumns({"_n": F.row_number().over(w), "_tp": F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    ranked = ranked.join(sums, [*key, "_range"]).withColumns({"_n": F.col("_n") + F.col("_n0"), "_tp": F.col("_tp") + F.col("_tp0")}).join(totals, cat)
    curve = ranked.withColumns({"_recall": F.col("_tp") / F.col("n_gt"), "_precision": F.col("_tp") / F.col("_n")})
    # Each detection serves the recall points up to its recall: the highest point is enough, the envelope does the rest.
    at = F.floor(F.col("_recall") * (points - 1) + 1e-9).cast("int")
    top = curve.groupBy(*key, at.alias("_at")).agg(F.max("_precision").alias("_p"))
    down = Window.partitionBy(*key).orderBy(F.desc("_at"))
    env = top.withColumns({"_env": F.max("_p").over(down.rowsBetween(Window.unboundedPreceding, 0)), "_below": F.coalesce(F.lead("_at").over(down), F.lit(-1))})
    return env.groupBy(*key).agg((F.sum(F.col("_env") * (F.col("_at") - F.col("_below"))) / points).alias("ap"))


#: The catalogue of metrics: seven of the data set, averaged over thresholds and at two of them, and five of images. Fixed names and order.
_DATA = ("cgF1", "precision", "recall", "F1", "positive_macro_F1", "positive_micro_F1", "positive_micro_precision")
_IMAGE = ("IL_precision", "IL_recall", "IL_F1", "IL_FPR", "IL_MCC")
METRICS = tuple((m, m in _IMAGE, None) for m in _DATA + _IMAGE) + tuple((m, False, t) for t in (0.5, 0.75) for m in _DATA)
#: Where `cgf1_dataset` has a metric.
_COLUMNS = dict(zip(_DATA + _IMAGE, ("cgf1", "precision", "recall", "f1", "positive_macro_f1", "positive_micro_f1", "positive_precision", "il_precision", "il_recall", "il_f1", "il_fpr", "il_mcc"), strict=True))


def metric_index(name: str, threshold: float | None = None) -> int:
    """The place of a metric in `METRICS`."""
    for i, (n, _, t) in enumerate(METRICS):
        if (n, t) == (name, threshold):
            return i
    raise ValueError(f"no metric {name} at {threshold}")


def catalogue(dataset: DataFrame) -> DataFrame:
    """place, name, threshold, value of all metrics, from the rows of `cgf1_dataset`, one for each threshold."""
    at = {None: F.lit(True), 0.5: F.abs(F.col("thr") - 0.5) < 1e-9, 0.75: F.abs(F.col("thr") - 0.75) < 1e-9}
    values = dataset.agg(*[F.avg(F.when(at[t], F.col(_COLUMNS[n]))).alias(f"m{i}") for i, (n, _, t) in enumerate(METRICS)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(t).cast("double").alias("threshold"), F.col(f"m{i}").alias("value")) for i, (n, _, t) in enumerate(METRICS)]
    return values.select(F.inline(F.array(*rows)))


def _sequence(c: dict):
    """gt and tracker ids and similarities by frame, ids dense."""
    frames: dict[int, tuple[list, list]] = {}
    for f, s, i, b in zip(c["frame"], c["side"], c["id"], c["box"], strict=True):
        if s < 2:
            frames.setdefault(f, ([], []))[s].append((i, b))
    gts = {i: k for k, i in enumerate(sorted({i for g, _ in frames.values() for i, _ in g}))}
    tks = {i: k for k, i in enumerate(sorted({i for _, d in frames.values() for i, _ in d}))}
    steps = []
    for f in sorted(frames):
        g, d = frames[f]
        steps.append((np.array([gts[i] for i, _ in g], int), np.array([tks[i] for i, _ in d], int), box_ious(_boxes([b for _, b in g]), _boxes([b for _, b in d]))))
    return len(gts), len(tks), steps


def alignment(n_gt: int, n_tk: int, steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How well each pair of ids fits over the sequence, and how often each id occurs."""
    share, count_g, count_t = np.zeros((n_gt, n_tk)), np.zeros(n_gt), np.zeros(n_tk)
    for g, t, sim in steps:
        rest = sim.sum(0)[None, :] + sim.sum(1)[:, None] - sim
        share[np.ix_(g, t)] += np.divide(sim, rest, out=np.zeros_like(sim), where=rest > EPS)
        count_g[g] += 1
        count_t[t] += 1
    return share / np.maximum(count_g[:, None] + count_t[None, :] - share, EPS), count_g, count_t


HOTA_FIELDS = "alpha double, tp long, fn long, fp long, assa double, assre double, asspr double, loca double"


def hota_kernel(c: dict) -> list[tuple]:
    n_gt, n_tk, steps = _sequence(c)
    all_g, all_t = sum(len(g) for g, _, _ in steps), sum(len(t) for _, t, _ in steps)
    if not all_g or not all_t:
        return [(a, 0, all_g, all_t, 0.0, 0.0, 0.0, 1.0) for a in ALPHAS]
    fit, count_g, count_t = alignment(n_gt, n_tk, steps)
    tp, loc = np.zeros(len(ALPHAS)), np.zeros(len(ALPHAS))
    hits = np.zeros((len(ALPHAS), n_gt, n_tk))
    for g, t, sim in steps:
        for i, j in assign(fit[np.ix_(g, t)] * sim):
            ok = sim[i, j] >= np.array(ALPHAS) - EPS
            tp += ok
            loc += ok * sim[i, j]
            hits[ok, g[i], t[j]] += 1
    both = np.maximum(1, count_g[None, :, None] + count_t[None, None, :] - hits)
    mean = lambda x: (hits * x).sum((1, 2)) / np.maximum(1, tp)
    a, r, p = mean(hits / both), mean(hits / np.maximum(1, count_g[None, :, None])), mean(hits / np.maximum(1, count_t[None, None, :]))
    loc = np.maximum(1e-10, loc) / np.maximum(1e-10, tp)
    return [(al, int(tp[k]), int(all_g - tp[k]), int(all_t - tp[k]), float(a[k]), float(r[k]), float(p[k]), float(loc[k])) for k, al in enumerate(ALPHAS)]


def hota_sequences(rows: DataFrame, by: list[str], keys: str) -> DataFrame:
    """by and HOTA_FIELDS of each sequence; rows: by, frame, side, id, box (spine rows keep empty sequences)."""
    return by_group(rows, by, ["frame", "side", "id"], lambda key, c: [(*key, *r) for r in hota_kernel(c)], f"{keys}, {HOTA_FIELDS}")


def with_final(rows: DataFrame) -> DataFrame:
    """Adds the fields that follow from counts and association."""
    c = F.col
    one = lambda x: F.greatest(F.lit(1), x)
    rows = rows.withColumns({"detre": c("tp") / one(c("tp") + c("fn")), "detpr": c("tp") / one(c("tp") + c("fp")), "deta": c("tp") / one(c("tp") + c("fn") + c("fp"))})
    return rows.withColumns({"hota": F.sqrt(c("deta") * c("assa")), "owta": F.sqrt(c("detre") * c("assa"))})


def hota_combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sequences together: counts add up; association and location average by true positives."""
    c = F.col
    mean = lambda n: (F.sum(c(n) * c("tp")) / F.greatest(F.lit(1.0), F.sum("tp"))).alias(n)
    loc = (F.greatest(F.lit(1e-10), F.sum(c("loca") * c("tp"))) / F.greatest(F.lit(1e-10), F.sum("tp"))).alias("loca")
    return with_final(rows.groupBy(*by, "alpha").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), mean("assa"), mean("assre"), mean("asspr"), loc))


def hota_class_mean(rows: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Plain means over classes of `with_final` rows; counts add up. skip_empty: without classes that have no detection at an alpha."""
    some = F.col("tp") + F.col("fn") + F.col("fp") > 0
    avg = lambda n: F.avg(F.when(some, F.col(n)) if skip_empty else F.col(n)).alias(n)
    return rows.groupBy("alpha").agg(*[F.sum(n).alias(n) for n in ("tp", "fn", "fp")], *[avg(n) for n in ("hota", "deta", "assa", "detre", "detpr", "assre", "asspr", "loca", "owta")])


TETA_FIELDS = "alpha double, loc_tp long, loc_fn long, loc_fp long, assoca double, assocre double, assocpr double, cls_tp long, cls_fn long"


def teta_kernel(c: dict) -> list[tuple]:
    """As HOTA, with classes apart: an unmatched detection is a location error only if it lies on a ground truth (IoU of at least 0.5)."""
    n_gt, n_tk, steps = _sequence(c)
    kinds: dict[tuple, int] = {}
    for f, s, i, k in zip(c["frame"], c["side"], c["id"], c["cls"], strict=True):
        kinds[f, s, i] = k
    order = sorted({f for f, s in zip(c["frame"], c["side"], strict=True) if s < 2})
    raw = {(f, s): [i for i in ids] for f in order for s in (0, 1) for ids in [[i for g, t, i in zip(c["frame"], c["side"], c["id"], strict=True) if g == f and t == s]]}
    all_g = sum(len(g) for g, _, _ in steps)
    n = len(TETA_ALPHAS)
    if not all_g or not any(len(t) for _, t, _ in steps):
        return [(a, 0, all_g, 0, 0.0, 0.0, 0.0, 0, 0) for a in TETA_ALPHAS]
    fit, count_g, count_t = alignment(n_gt, n_tk, steps)
    tp, fn, fp, ctp, cfn = (np.zeros(n, int) for _ in range(5))
    hits = np.zeros((n, n_gt, n_tk))
    for f, (g, t, sim) in zip(order, steps, strict=True):
        pairs = assign(fit[np.ix_(g, t)] * sim)
        near = set(np.flatnonzero((sim >= 0.5).any(0)).tolist()) if len(g) else set()
        for k, a in enumerate(TETA_ALPHAS):
            ok = [(i, j) for i, j in pairs if sim[i, j] >= a - EPS]
            tp[k] += len(ok)
            fn[k] += len(g) - len(ok)
            fp[k] += len(near - {j for _, j in ok})
            same = sum(kinds[f, 0, raw[f, 0][i]] == kinds[f, 1, raw[f, 1][j]] for i, j in ok)
            if a >= 0.5:
                ctp[k] += same
                cfn[k] += len(ok) - same
            for i, j in ok:
                hits[k, g[i], t[j]] += 1
    both = np.maximum(1, count_g[None, :, None] + count_t[None, None, :] - hits)
    mean = lambda x: (hits * x).sum((1, 2)) / np.maximum(1, tp)
    a_, r_, p_ = mean(hits / both), mean(hits / np.maximum(1, count_g[None, :, None])), mean(hits / np.maximum(1, count_t[None, None, :]))
    return [(al, int(tp[k]), int(fn[k]), int(fp[k]), float(a_[k]), float(r_[k]), float(p_[k]), int(ctp[k]), int(cfn[k])) for k, al in enumerate(TETA_ALPHAS)]


TETA_ALPHAS = tuple(round(0.05 * i, 2) for i in range(20))


def teta_sequences(rows: DataFrame, by: list[str], keys: str) -> DataFrame:
    """by and TETA_FIELDS of each sequence; rows: by, frame, side, id, cls, box."""
    return by_group(rows, by, ["frame", "side", "id"], lambda key, c: [(*key, *r) for r in teta_kernel(c)], f"{keys}, {TETA_FIELDS}")


def teta_combined(rows: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    mean = lambda n: (F.sum(c(n) * c("loc_tp")) / F.greatest(F.lit(1.0), F.sum("loc_tp"))).alias(n)
    g = rows.groupBy(*by, "alpha").agg(*[F.sum(n).alias(n) for n in ("loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn")], mean("assoca"), mean("assocre"), mean("assocpr"))
    one = lambda x: F.greatest(F.lit(1), x)
    g = g.withColumns({"loca": c("loc_tp") / one(c("loc_tp") + c("loc_fn") + c("loc_fp")), "clsa": c("cls_tp") / one(c("cls_tp") + c("cls_fn"))})
    return g.withColumn("teta", (c("loca") + c("assoca") + c("clsa")) / 3)
