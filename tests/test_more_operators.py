"""Operators without SQL, by hand, by exhaustive search or by a plain loop over the same rows."""

import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolyte.operators import assemble as S
from annolyte.operators import evaluate as E
from annolyte.operators import features, filters, images, metrics, sessions
from annolyte.operators import kernels as K
from annolyte.sources import coco, records

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SIDED = f"img long, side int, id long, score double, box {BOX}"


def sided(spark, rows):
    return spark.createDataFrame([(i, s, k, p, None if b is None else tuple(map(float, b))) for i, s, k, p, b in rows], SIDED)


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def plain_summary(rows):
    """The metrics by loops: images, then thresholds, then recall points."""
    out = {}
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    imgs = sorted({r[0] for r in rows})
    for name, low, high in E.AREAS:
        n_gt = sum(low <= size(r[4]) <= high for r in rows if r[1] == 0)
        for t in E.IOU_THRESHOLDS:
            found = []
            for i in imgs:
                g = [r[4] for r in rows if r[0] == i and r[1] == 0]
                g = sorted(g, key=lambda b: not low <= size(b) <= high)
                used = set()
                for rank, (p, k, b) in enumerate(sorted(((-r[3], r[2], r[4]) for r in rows if r[0] == i and r[1] == 1))):
                    best, at = min(t, 1 - 1e-10), None
                    for j, x in enumerate(g):
                        if j in used or (at is not None and low <= size(g[at]) <= high and not low <= size(x) <= high):
                            continue
                        if plain_iou(b, x) >= best:
                            best, at = plain_iou(b, x), j
                    if at is not None:
                        used.add(at)
                        if low <= size(g[at]) <= high:
                            found.append((p, i, k, True, rank))
                    elif low <= size(b) <= high:
                        found.append((p, i, k, False, rank))
            found.sort()
            tp = np.cumsum([f[3] for f in found]) if found else np.zeros(0)
            precision = [tp[n] / (n + 1) for n in range(len(found))]
            ap = np.mean([max((precision[n] for n in range(len(found)) if tp[n] / n_gt >= q / 100 - 1e-12), default=0.0) for q in range(101)]) if n_gt else None
            out[name, t, "ap"] = ap
            for m in E.MOST_DETECTIONS:
                out[name, t, m] = sum(f[3] and f[4] < m for f in found) / n_gt if n_gt else None
    mean = lambda keys: float(np.mean([out[k] for k in keys if out[k] is not None])) if any(out[k] is not None for k in keys) else -1.0
    got = {"AP": mean([("all", t, "ap") for t in E.IOU_THRESHOLDS]), "AP50": mean([("all", 0.5, "ap")]), "AP75": mean([("all", 0.75, "ap")])}
    for a in ("small", "medium", "large"):
        got[f"AP_{a}"] = mean([(a, t, "ap") for t in E.IOU_THRESHOLDS])
        got[f"AR_{a}"] = mean([(a, t, 100) for t in E.IOU_THRESHOLDS])
    for m in E.MOST_DETECTIONS:
        got[f"AR{m}"] = mean([("all", t, m) for t in E.IOU_THRESHOLDS])
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_coco_summary_equals_loops(spark, seed):
    r = random.Random(seed)
    rows, k = [], 0
    for i in range(12):
        for _ in range(r.randint(0, 4)):
            x, y, w, h = r.randint(0, 200), r.randint(0, 200), r.randint(10, 120), r.randint(10, 120)
            k += 1
            rows.append((i, 0, k, 1.0, (x, y, x + w, y + h)))
            for _ in range(r.randint(0, 2)):
                k += 1
                d = lambda: r.randint(-4, 4)
                rows.append((i, 1, k, r.random(), (x + d(), y + d(), x + w + d(), y + h + d())))
        if r.random() < 0.5:
            k += 1
            rows.append((i, 1, k, r.random(), (5, 5, 40, 30)))
    df = sided(spark, rows)
    m = E.coco_matches(df, ["img"], "img long").withColumn("cat", F.lit(1))
    got = {x.metric: x.value for x in E.coco_summary(m, E.truths_by_area(df.withColumn("cat", F.lit(1)), ["cat"]), ["cat"], ["img", "id"]).collect()}
    want = plain_summary(rows)
    assert got.keys() == want.keys()
    for name, v in want.items():
        assert got[name] == pytest.approx(v, abs=1e-9), name
    # Precision over all score ranges is that of one ordered pass.
    all_m = E.ap_matches(df, ["img"], "img long").withColumn("cat", F.lit(1))
    ap = E.average_precision(all_m, df.where("side = 0").withColumn("cat", F.lit(1)).groupBy("cat").agg(F.count("*").alias("n_gt")), ["cat"], ["img", "id"])
    assert np.mean([x.ap for x in ap.collect()]) == pytest.approx(want["AP"], abs=1e-9)


def test_crowds_count_neither_way(spark):
    rows = [(1, 0, 1, 1.0, (0, 0, 10, 10)), (1, 0, 2, 1.0, (20, 0, 60, 40)), (1, 1, 3, 0.9, (0, 0, 10, 10)), (1, 1, 4, 0.8, (22, 2, 32, 12)), (1, 1, 5, 0.7, (40, 10, 50, 20))]
    df = sided(spark, rows).withColumn("crowd", F.col("id") == 2)
    got = E.coco_matches(df, ["img"], "img long").where("area = 'all' AND thr = 0.5").collect()
    assert [(x.id, x.hit) for x in got] == [(3, True)]
    assert {x.area: x.n_gt for x in E.truths_by_area(df, ["img"]).collect()} == {"all": 1, "small": 1}


def test_rarity_and_catalogue(spark):
    ap = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.9)], "cat int, ap double")
    n = spark.createDataFrame([(1, 3), (2, 10), (3, 500)], "cat int, n_images int")
    got = {r.bucket: (round(r.ap, 6), r.n) for r in E.rarity_average(ap, n, "cat").collect()}
    assert got == {"rare": (0.3, 2), "frequent": (0.9, 1), "all": (0.6, 3)}
    assert len(E.METRICS) == 26 and E.metric_index("cgF1") == 0 and E.metric_index("IL_MCC") == 11 and E.metric_index("cgF1", 0.75) == 19
    with pytest.raises(ValueError):
        E.metric_index("IL_F1", 0.5)
    rows = sided(spark, [(1, 0, 1, 1.0, (0, 0, 10, 10)), (1, 1, 2, 0.9, (0, 0, 10, 10)), (2, 1, 3, 0.9, (0, 0, 5, 5)), (3, 2, None, None, None)])
    made = E.cgf1_dataset(E.cgf1_images(rows, ["img"], "img long"))
    c = {(r.name, r.threshold): r.value for r in E.catalogue(made).collect()}
    at = {round(r.thr, 2): r for r in made.collect()}
    assert c["recall", 0.5] == at[0.5].recall and c["precision", None] == pytest.approx(np.mean([r.precision for r in at.values()])) and c["IL_FPR", None] == pytest.approx(at[0.5].il_fpr)


def test_image_counts_over_videos_and_truths(spark):
    """video_f1, demo_f1, oracle_best_gt and pack_fitness by hand."""
    im = spark.createDataFrame([(1, 1, 0.5, 2, 2, 1, 1, 1, 0.5), (1, 2, 0.5, 1, 0, 0, 0, 1, 0.0), (2, 3, 0.5, 0, 0, 0, 0, 0, 0.0), (2, 4, 0.5, 1, 1, 1, 0, 0, 1.0), (2, 5, 0.5, 0, 2, 0, 2, 0, 0.0)], "video_id int, img int, thr double, n_gt int, n_dt int, tp int, fp int, fn int, f1 double")
    got = {r.video_id: r.f1 for r in S.video_f1(im, ["video_id"]).collect()}
    assert got == {1: 2 / 5, 2: 2 / 4}
    assert S.video_f1(im.where("img = 3"), ["video_id"]).first().f1 == 1.0
    d = S.demo_f1(im).first()
    assert d.perfect_positive == pytest.approx(1 / 3) and d.perfect_negative == pytest.approx(1 / 2) and d.macro_f1 == pytest.approx((0.5 + 0 + 1 + 1 + 0) / 5)
    truths = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.4), (1, 1, 0.3), (1, 1, 0.3), (2, 0, 0.1), (2, 1, 0.6)], "img int, truth int, f1 double")
    assert {(r.img, r.truth, round(r.mean, 6)) for r in E.best_of_truths(truths, ["img"], "truth").collect()} == {(1, 0, 0.3), (2, 1, 0.6)}
    bins = spark.createDataFrame([(1, 0.5), (1, 1.0), (2, 0.25)], "case_id int, utilisation double")
    assert {r.case_id: r.fitness for r in metrics.pack_fitness(bins, ["case_id"]).collect()} == {1: (0.25 + 1) / 4, 2: 0.0625}


def cost(q, t, kind):
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])
    l1 = sum(abs(x - y) for x, y in zip(centre(q[1]), centre(t), strict=True))
    iou = plain_iou(q[1], t)
    hull = (max(q[1][2], t[2]) - min(q[1][0], t[0])) * (max(q[1][3], t[3]) - min(q[1][1], t[1]))
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    union = (size(q[1]) + size(t)) / (1 + iou)
    p = q[0]
    c = {"score": -p, "log": -np.log(p), "focal": -0.25 * (1 - p) ** 2 * np.log(p) + 0.75 * p**2 * np.log(1 - p)}[kind]
    return c + l1 - (iou - (hull - union) / hull)


@pytest.mark.parametrize("kind", ["score", "log", "focal"])
@pytest.mark.parametrize("copies", [1, 2])
def test_set_cost_match_is_the_least_of_all(spark, kind, copies):
    r = random.Random(5)
    b = lambda: (x := r.random() / 2, y := r.random() / 2, x + 0.1 + r.random() / 3, y + 0.1 + r.random() / 3)
    q, t = [(r.uniform(0.1, 0.9), b()) for _ in range(5)], [b() for _ in range(2)]
    rows = [(1, 1, i, p, x) for i, (p, x) in enumerate(q)] + [(1, 0, j, 1.0, x) for j, x in enumerate(t)]
    got = S.set_cost_match(sided(spark, rows), ["img"], "img long", kind=kind, copies=copies).collect()
    least = min(sum(cost(q[i], (t * copies)[j], kind) for j, i in enumerate(chosen)) for chosen in itertools.permutations(range(5), 2 * copies))
    assert sum(x.cost for x in got) == pytest.approx(least) and len(got) == 2 * copies
    assert all(x.cost == pytest.approx(cost(q[x.query_id], t[x.target_id], kind)) for x in got)


def test_tree_finds_what_one_split_tells(spark):
    rows = [(i, float(i % 10), 1.0, 2.0, 3.0, int(i % 10 > 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "shape_id int, stroke_width double, stroke_length double, average_value double, value_sd double, label int")
    model = features.fit(df)
    assert sorted(r.shape_id for r in features.issues(model, df).collect()) == [i for i in range(200) if i % 10 > 6]
    q = features.quality(model, df).first()
    assert (q.precision, q.recall, q.fp, q.fn) == (1.0, 1.0, 0, 0)


def test_genetic_draws_follow_fitness():
    g = K.Genetic({i: (10 + i, 12) for i in range(6)}, 60, 60, population=6, generations=4, sus=4)
    people = [[(i, 0)] for i in range(4)]
    counts = np.zeros(4)
    for _ in range(4000):
        counts[g._wheel(people, [0.0, 1.0, 2.0, 1.0])[0][0]] += 1
    assert counts[0] == 0 and np.allclose(counts / 4000, [0, 0.25, 0.5, 0.25], atol=0.04)
    assert [p[0][0] for p in g._spread(people, [0.0, 1.0, 2.0, 1.0])] == [1, 2, 2, 3]
    assert len(g._spread(people, [0.0] * 4)) == 4
    genes = [(i, i % 2) for i in range(6)]
    for _ in range(200):
        assert sorted(i for i, _ in g._changed(list(genes))) == list(range(6))
    for selection in ("roulette", "sus", "tournament"):
        bins, fit, *_ = K.Genetic({i: (10 + i, 12) for i in range(6)}, 60, 60, population=6, generations=4, selection=selection).run()
        assert fit == K.fitness(bins) and sum(len(b.placed) for b in bins) == 6


def test_sessions(spark):
    s = sessions.Sessions()
    s.start("a", 5)
    s.prompt("a", 3, 1)
    s.prompt("a", 2, 2)
    s.remove("a", 1)
    rows = [tuple(r) for r in s.propagate(spark, "a").orderBy(F.desc("pass"), "place").collect()]
    assert rows == [("forward", 0, 2, 2), ("forward", 1, 3, 2), ("forward", 2, 4, 2), ("backward", 0, 1, 2), ("backward", 1, 0, 2)]
    s.reset("a")
    assert s.propagate(spark, "a", "forward").collect() == []
    for bad in (lambda: s.start("a", 5), lambda: s.prompt("a", 5, 1), lambda: s.propagate(spark, "a", "up")):
        with pytest.raises(ValueError):
            bad()
    s.close("a")
    with pytest.raises(KeyError):
        s.reset("a")


def test_duplicates_equal_a_loop_over_frames(spark):
    r = random.Random(3)
    rows = sorted({(1, f, r.randint(0, 3), t) for f in range(25) for t in range(6) if r.random() < 0.7 and f >= t})
    for delay, most in ((6, 3), (20, 4)):
        first, pairs, gone = {}, {}, {}
        for f in range(25):
            dets = {}
            for _, _, d, t in (x for x in rows if x[1] == f):
                first.setdefault(t, f)
                dets.setdefault(d, set()).add(t)
            for ts in dets.values():
                lead = min(ts, key=lambda t: (first[t], t))
                for t in ts - {lead}:
                    pairs[lead, t] = pairs.get((lead, t), 0) + 1
            for (_, t), n in pairs.items():
                if t not in gone and first[t] > f - delay and n >= most:
                    gone[t] = f
        df = spark.createDataFrame(rows, "video_id long, frame long, det_id long, track_id long")
        assert {x.track_id: x.removed_at for x in sessions.duplicates(df, delay=delay, most=most).collect()} == gone


def test_least_loaded_worker_by_turns(spark):
    loads = [3, 0, 1]
    want, now = [], loads[:]
    for _ in range(8):
        w = int(np.argmin(now))
        want.append(w)
        now[w] += 1
    new = spark.createDataFrame([(1, i) for i in range(8)], "video_id long, det_id long")
    got = sessions.assigned(new, spark.createDataFrame([(1, i, n) for i, n in enumerate(loads)], "video_id long, worker long, load long"))
    assert [r.worker for r in got.orderBy("det_id").collect()] == want


def test_video_loading_goes_round(spark):
    q = spark.createDataFrame([(v, v * 10, 0, False) for v in (1, 2, 5, 1500, 2500)], "video_id long, query_id long, query_processing_order int, is_exhaustive boolean")
    o = spark.createDataFrame([(v, 0) for v in (2, 2, 5, 5, 2500, 2500)], "video_id long, image_id int")
    got = {r.asked: r.video_id for r in filters.loaded_videos(q, o, 1).collect()}
    assert got == {1: 1, 2: 1500, 5: 1500, 1500: 1500, 2500: 1}
    assert filters.loaded_videos(q.where("video_id = 2"), o, 1).collect() == []


def test_pixels(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (20, 31, 3), dtype=np.uint8)
    same = np.full((9, 9, 1), 77, np.uint8)
    assert (images.blurred(same) == 77).all() and images.blurred(x).std() < x.std()
    weight = np.exp(-((np.arange(15) - 7) ** 2) / 1800.0)
    weight /= weight.sum()
    mirror = lambda i, n: i if 0 <= i < n else (-i if i < 0 else 2 * n - 2 - i)
    want = sum(weight[a] * weight[b] * float(x[mirror(2 + a - 7, 20), mirror(29 + b - 7, 31), 1]) for a in range(15) for b in range(15))
    assert abs(float(images.blurred(x)[2, 29, 1]) - want) <= 0.5 + 1e-6
    assert (images.darkened(x, 0.05) == (x * 0.05).astype(np.uint8)).all() and images.flattened(x, 0.0).max() == x.min()
    assert images.merged_grey([x, x[..., :1]])[..., 1].tolist() == x[..., 0].tolist()
    rows = [(1, "blur", 20, 31, 3, x.tobytes()), (2, "darken", 20, 31, 3, x.tobytes()), (3, "none", 20, 31, 3, x.tobytes()), (4, "blur", 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "image_id long, kind string, height int, width int, channels int, pixels binary")
    got = {q.image_id: q.pixels for q in images.corrupted(df).collect()}
    again = {q.image_id: q.pixels for q in images.corrupted(df.repartition(4)).collect()}
    assert got == again and got[1] == images.blurred(x).tobytes() and got[3] == x.tobytes() and got[4] is None and max(got[2]) <= 25


def test_points_and_shapes():
    mask = np.zeros((12, 16), bool)
    mask[2:9, 3:12] = True
    p = images.points_in_mask(mask, 50, "k")
    assert mask[p[:, 1], p[:, 0]].all() and (p == images.points_in_mask(mask, 50, "k")).all()
    c = images.points_of_centre(mask, 3)
    assert mask[c[:, 1], c[:, 0]].all() and c[0, 1] == 5 and len({tuple(x) for x in c}) == 3
    b = images.points_in_box(mask, (1.2, 1.0, 14.0, 11.0), 40)
    assert (b[:, 2] == mask[b[:, 1], b[:, 0]]).all() and b[:, 0].min() >= 2 and b[:, 0].max() < 14
    with pytest.raises(ValueError):
        images.points_in_mask(np.zeros((3, 3), bool), 1)
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    x, y, r = images.fitted_circle(np.c_[5 + 3 * np.cos(t), -2 + 3 * np.sin(t)])
    assert (round(x, 6), round(y, 6), round(r, 6)) == (5, -2, 3) and images.fitted_circle([(0, 0), (1, 1), (2, 2)]) is None
    turned = images.corners_of(10, 20, 8, 4, 30)
    assert K.ring_area(images.least_rectangle(np.r_[turned, [[10, 20]]])) == pytest.approx(32)
    assert images.simplified([(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)], 1).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    assert images.shape_of(turned, "rect")[0] == "rectangle" and images.shape_of(turned, "wire")[0] == "polygon" and images.shape_of(turned, "circle", (1, 1))[0] == "circle"
    assert images.rotated_iou((0, 0, 4, 2, 0), (0, 0, 4, 2, 180)) == pytest.approx(1) and images.rotated_iou((0, 0, 4, 2, 0), (0, 0, 4, 2, 90)) == pytest.approx(4 / 12)
    assert images.rotated_iou((0, 0, 2, 2, 45), (10, 0, 2, 2, 0)) == 0
    rng = np.random.default_rng(4)
    u = rng.uniform(-4, 4, (400_000, 2))
    inside = lambda q: (np.abs((u - q[:2]) @ np.array([[np.cos(np.deg2rad(q[4])), -np.sin(np.deg2rad(q[4]))], [np.sin(np.deg2rad(q[4])), np.cos(np.deg2rad(q[4]))]])) <= np.array(q[2:4]) / 2).all(1)
    a, b = (0.3, -0.2, 4, 2, 25), (0, 0.4, 3, 2.5, -40)
    assert images.rotated_iou(a, b) == pytest.approx((inside(a) & inside(b)).sum() / (inside(a) | inside(b)).sum(), abs=0.01)


def test_loaders_and_writers(spark, tmp_path):
    imgs = spark.createDataFrame([("d", 1)], "dataset string, id long")
    res = spark.createDataFrame([("d", 1, [0.0, 0.0, 2.0, 3.0], None, 0.5)], "dataset string, image_id long, bbox array<double>, area double, score double")
    assert coco.load_results(res, imgs).first().area == 6.0
    with pytest.raises(Exception, match="unknown image"):
        coco.load_results(res.withColumn("image_id", F.lit(9).cast("long")), imgs).collect()
    videos = spark.createDataFrame([("d", 1, ["a"], 4, 4)], "dataset string, id long, file_names array<string>, width long, height long")
    tracks = spark.createDataFrame([("d", 1, 1, 1, 0, 1.0, [[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0]], [1.0, 1.0])], "dataset string, id long, video_id long, category_id long, iscrowd long, score double, bboxes array<array<double>>, areas array<double>")
    with pytest.raises(Exception, match="no frame"):
        coco.track_annotations(tracks, coco.video_frames(videos)).collect()
    details = spark.createDataFrame([("b", 0.5, 1.0), ("a", 0.25, 2.0)], "seq string, HOTA double, IDs double")
    records.write_details(details, details.agg(F.avg("HOTA").alias("HOTA"), F.sum("IDs").alias("IDs")), str(tmp_path / "d"))
    back = [tuple(r) for r in records.read_details(spark, str(tmp_path / "d")).collect()]
    assert back == [("a", 0.25, 2.0), ("b", 0.5, 1.0), ("COMBINED_SEQ", 0.375, 3.0)]
    records.write_summary(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, IDs double, HOTA double"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value == "HOTA IDs x"
    for name, doc in (("e1", {"image_embedding": [1, 2], "roi": [0, 0, 5, 5]}), ("e2", {"roi": [1], "wire width": 2.5})):
        (tmp_path / "ex" / name).mkdir(parents=True)
        (tmp_path / "ex" / name / "exemplar_info.json").write_text(json.dumps(doc))
    (tmp_path / "ex" / "c1").mkdir()
    (tmp_path / "ex" / "c1" / "label_clean.json").write_text(json.dumps({"globalAttributes": {"exemplar_name": "e1", "image_embedding": [3]}}))
    assert sorted(tuple(r) for r in records.exemplars(spark, str(tmp_path / "ex")).collect()) == [("e1", [1.0, 2.0], [0.0, 0.0, 5.0, 5.0], 0.0), ("e2", [], [1.0], 2.5)]
    assert [tuple(r) for r in records.log_cases(spark, str(tmp_path / "ex")).collect()] == [("c1", "e1", [3.0])]
    (tmp_path / "x.txt").write_text("1;2;3,5\n\n4;5;6,7\n")
    assert coco.dialect(spark, str(tmp_path / "x.txt")) == ";"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/1.txt", "p\nq")
        z.writestr("a/2.bin", "no")
    assert [(r.name, r.value) for r in coco.unzipped(spark, str(tmp_path / "z.zip")).collect()] == [("a/1.txt", "p"), ("a/1.txt", "q")]


def test_update_plan_numbers_once_where_a_detection_comes_twice(spark):
    """Id and worker of an addition come from one numbering, also where rows have one det_id."""
    r = random.Random(4)
    dets = [(v, r.choice([5, 7, 9]), r.randint(0, 99), True) for v in range(60) for _ in range(8)]
    loads = [(v, w, 0) for v in range(60) for w in range(3)]
    known = [(v, 2, 0) for v in range(60)]
    d = spark.createDataFrame(dets, "video_id long, det_id long, score long, is_new boolean").repartition(7)
    k = spark.createDataFrame(known, "video_id long, object_id long, worker long")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:  # as with large tables, rows meet by shuffles, after which equal ones come in any order
        for c, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(c, v)
        got = sessions.update_plan(d, k, spark.createDataFrame(loads, "video_id long, worker long, load long"), k.limit(0).drop("worker"), most=9).where("action = 'add'").collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    want = {(v, 3 + i, x[1], i % 3) for v in range(60) for i, x in enumerate(sorted((x for x in dets if x[0] == v), key=lambda x: x[1]))}
    assert len(got) == 480 and {(x.video_id, x.object_id, x.det_id, x.worker) for x in got} == want
