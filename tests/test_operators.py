"""Operators on small frames: streams, evaluators, packing of conflicts, filters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolyte.functions import box as B
from annolyte.functions import poly as P
from annolyte.operators import evaluate as E
from annolyte.operators import filters as Q
from annolyte.operators import match, metrics, rules
from annolyte.operators import tracking as T
from annolyte.streaming import tracker as TS

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, f, (f * 7 + t * 3) % 5 > 1) for t in range(6) for f in range(30)]
    df = spark.createDataFrame(rows, "track_id long, frame long, hit boolean")
    for k in range(3):
        df.where((F.col("frame") >= 10 * k) & (F.col("frame") < 10 * k + 10)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = TS.tracker_stream(stream).writeStream.format("memory").queryName("tracker").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.track_id, r.frame): (r.streak, r.alive, r.is_confirmed) for r in spark.table("tracker").collect()}
    batch = {(r.track_id, r.frame): (r.streak, r.is_confirmed) for r in T.confirmed(df).collect()}
    assert {k: (v[0], v[2]) for k, v in got.items()} == batch
    q = TS.accumulate(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert TS.synced(spark, str(tmp_path / "out")).count() == len(rows)
    last = {r.track_id: r.alive for r in T.keep_alive(df).collect()}
    assert {t: got[t, 29][1] for t in range(6)} == last


def _rows(spark, gt, dt):
    b = lambda x: dict(zip(("x0", "y0", "x1", "y1"), map(float, x)))
    g = spark.createDataFrame([(k, f, i, b(x)) for k, f, i, x in gt], f"seq long, frame long, id long, box {BOX}")
    d = spark.createDataFrame([(k, f, i, b(x)) for k, f, i, x in dt], f"seq long, frame long, id long, box {BOX}")
    return g.withColumn("side", F.lit(0)).unionByName(d.withColumn("side", F.lit(1)))


def test_hota_of_a_perfect_and_a_swapped_tracker(spark):
    gt = [(s, f, i, (i * 20, 0, i * 20 + 10, 10)) for s in (1, 2) for f in range(4) for i in (0, 1)]
    dt = [(1, f, i + 5, x) for s, f, i, x in gt if s == 1] + [(2, f, (i + (f >= 2)) % 2, x) for s, f, i, x in gt if s == 2]
    h = E.with_final(E.hota_sequences(_rows(spark, gt, dt), ["seq"], "seq long")).where("alpha = 0.5").collect()
    by = {r.seq: r for r in h}
    assert by[1].hota == pytest.approx(1) and by[1].loca == pytest.approx(1)
    assert by[2].deta == pytest.approx(1) and by[2].assa == pytest.approx(1 / 3) and by[2].hota == pytest.approx(math.sqrt(1 / 3))
    t = E.teta_combined(E.teta_sequences(_rows(spark, gt, dt).withColumn("cls", F.lit(0)), ["seq"], "seq long"), ["seq"]).where("alpha = 0.5").collect()
    assert {r.seq: round(r.assoca, 6) for r in t} == {1: 1.0, 2: round(1 / 3, 6)}
    empty = E.hota_sequences(_rows(spark, gt, []), ["seq"], "seq long").first()
    assert empty.loca == 1.0 and empty.fn == 8 and empty.tp == 0


def test_cgf1_counts_and_gate(spark):
    b = lambda x: dict(zip(("x0", "y0", "x1", "y1"), map(float, x)))
    gt = spark.createDataFrame([(1, 1, b((0, 0, 10, 10))), (1, 2, b((20, 0, 30, 10))), (2, 1, b((0, 0, 10, 10)))], f"img long, id long, box {BOX}")
    dt = spark.createDataFrame([(1, 1, 0.9, b((0, 0, 10, 10))), (1, 2, 0.4, b((20, 0, 30, 10))), (3, 1, 0.9, b((0, 0, 9, 9)))], f"img long, id long, score double, box {BOX}")
    spine = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "img long")
    images = E.cgf1_images(E.sided(gt, dt, ["img"], spine), ["img"], "img long")
    at = {r.img: (r.n_gt, r.n_dt, r.tp, r.fp, r.fn) for r in images.where("thr = 0.5").collect()}
    assert at == {1: (2, 1, 1, 0, 1), 2: (1, 0, 0, 0, 1), 3: (0, 1, 0, 1, 0), 4: (0, 0, 0, 0, 0)}
    d = E.cgf1_dataset(images).where("thr = 0.5").first()
    assert (d.il_tp, d.il_fp, d.il_fn, d.il_tn) == (1, 1, 1, 1) and d.il_mcc == pytest.approx(0, abs=1e-6)
    assert d.positive_precision == pytest.approx(1 / (1 + 1e-4)) and d.recall == pytest.approx(1 / (3 + 1e-4))


def test_average_precision_by_hand(spark):
    rows = [(1, 0.5, i, s, h) for i, (s, h) in enumerate([(0.9, True), (0.8, False), (0.7, True)])]
    m = spark.createDataFrame(rows, "cat long, thr double, id long, score double, hit boolean")
    n = spark.createDataFrame([(1, 4)], "cat long, n_gt long")
    ap = E.average_precision(m, n, ["cat"], ["id"]).first().ap
    recall, precision = np.array([0.25, 0.25, 0.5]), np.array([1, 0.5, 2 / 3])
    want = np.mean([max([p for p, r in zip(precision, recall) if r >= t - 1e-12], default=0) for t in np.linspace(0, 1, 101)])
    assert ap == pytest.approx(want)


def test_boxes(spark):
    one = spark.range(1)
    a, b = B.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), B.box(F.lit(5), F.lit(5), F.lit(15), F.lit(15))
    r = one.select(B.iou(a, b).alias("iou"), B.iou(b, a).alias("uoi"), B.giou(a, b).alias("g"), B.iou(B.box(F.lit(1), F.lit(1), F.lit(1), F.lit(1)), B.box(F.lit(1), F.lit(1), F.lit(1), F.lit(1))).alias("none"),
                   B.is_zero(F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("z"), B.angle_normalised(F.lit(190.0)).alias("ang"), B.rotated_hull(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(90.0)).alias("hull"),
                   B.scale_factor(F.lit(0.0), 100).alias("s0"), B.letterbox(F.lit(2000.0), F.lit(1000.0)).alias("lb")).first()
    assert r.iou == r.uoi == pytest.approx(25 / 175) and r.g == pytest.approx(25 / 175 - 50 / 225) and r.none == 0 and r.z is False and r.ang == -170
    assert (round(r.hull.x0, 9), round(r.hull.y0, 9)) == (-1, -2) and r.s0 == 1 and (r.lb.w, r.lb.h, r.lb.dy) == (1008, 504, 252)


def test_polygons(spark):
    ring = P.ring(F.lit(5.0), F.lit(5.0), F.lit(2.0), F.lit(3.0))
    tri = F.array(P.point(F.lit(0), F.lit(0)), P.point(F.lit(4), F.lit(0)), P.point(F.lit(0), F.lit(4)))
    r = spark.range(1).select(F.size(ring).alias("n"), P.area(tri).alias("a"), P.covers(tri, F.lit(1.0), F.lit(1.0)).alias("in"), P.covers(tri, F.lit(3.0), F.lit(3.0)).alias("out"),
                              P.hausdorff(tri, P.translated(tri, 3, 4)).alias("h"), P.pairs(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p"), P.area(P.largest(F.array(tri, P.scaled(tri, 2)))).alias("big")).first()
    assert r.n == 37 and r.a == 8 and r["in"] and not r.out and r.h <= 5 and len(r.p) == 1 and r.big == 32


def test_nms_properties(spark):
    rows = [(1, i, float((i * 37) % 50), float((i * 17) % 30), float((i * 13) % 97)) for i in range(60)]
    d = spark.createDataFrame(rows, "g long, id long, x double, y double, score double").select("g", "score", "id", B.box(F.col("x"), F.col("y"), F.col("x") + 12, F.col("y") + 9).alias("box"))
    once = match.greedy_nms(d, ["g"], ["-score", "id"], 0.4)
    twice = match.greedy_nms(once.select("g", "score", "id", "box"), ["g"], ["-score", "id"], 0.4)
    assert sorted(r.id for r in once.collect()) == sorted(r.id for r in twice.collect())


def test_hybrid_clamps_and_keeps_nameless(spark):
    f = spark.createDataFrame([(1, "a", "fp", None), (1, "b", "fp", None), (1, "a", "fp", 3), (1, "b", "fp", 3), (1, "a", "fn", 4), (1, "b", "fn", 4), (1, "a", "fn", 5)], "c long, validator string, kind string, id long")
    n = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "c long, positives long, negatives long")
    got = {r.c: (r.tp, r.tn, r.fp, r.fn) for r in metrics.hybrid(f, n, ["c"], 2).collect()}
    assert got == {1: (1, 0, 3, 1), 2: (1, 1, 0, 0)}


def test_rules_find_what_is_wrong(spark):
    files = [
        (1, '{"Labels": [{"Label": "wire", "Shapes": [{"Type": "polygon", "points": [[1, 2]], "proposed_points": [[9999, 1]], "Attributes": {"category_id": 1}}]}]}'),
        (2, '{"Labels": [{"Label": "wires", "Shapes": [{"Type": "polygon", "points": [[1, "2"]], "Attributes": {"category_id": 7}}, {"Type": "blob"}]}]}'),
        (3, '{"Labels": [{"Label": "wire", "Shapes": []}, {"Label": 5, "Shapes": [{"Type": "polygon", "points": [[1, 5121]], "Attributes": {}}]}]}'),
        (4, "no json"), (5, None), (6, '{"Labels": [{"Label": "wire", "Shapes": [{"Type": "polygon", "points": [[1, 2, 3]], "Attributes": {"category_id": "x"}}]}]}'),
    ]
    got = sorted((r.case_id, r["pass"], r.id, r.reason) for r in rules.issues(spark.createDataFrame(files, "case_id long, json string")).collect())
    assert got == [
        (2, "label", "7", "'Label' is not allowed"), (2, "label", "NA", "'Label' is not allowed"), (2, "shape", "7", "a coordinate is no number"), (2, "shape", "NA", "'points' is required"),
        (3, "label", "NA", "'Label' is no string"), (3, "shape", "NA", "a coordinate is out of range"), (6, "shape", "x", "a point is no pair"),
    ]


def test_query_draws_repeat(spark):
    q = spark.createDataFrame([(i, i % 3, i % 5 == 0) for i in range(60)], "query_id long, g long, pos boolean")
    a = sorted(r.query_id for r in Q.keep_most(q, ["g"], 6, "pos").collect())
    b = sorted(r.query_id for r in Q.keep_most(q.repartition(9), ["g"], 6, "pos").collect())
    assert a == b and len(a) == 18 and {i for i in range(60) if i % 5 == 0} & set(a)


def test_nearest_conditioning_frames(spark):
    t = spark.createDataFrame([(1, 10), (1, 0)], "v long, frame long")
    c = spark.createDataFrame([(1, i) for i in (1, 5, 8, 9, 20, 30)], "v long, cond long")
    pick = lambda **kw: {f: sorted(r.cond for r in match.nearest_frames(t, c, ["v"], 3, **kw).collect() if r.frame == f) for f in (0, 10)}
    assert pick() == {10: [8, 9, 20], 0: [1, 5, 8]}
    assert pick(keep_first=True) == {10: [1, 9, 20], 0: [1, 5, 30]}


def test_hausdorff_of_boxes_is_that_of_their_outlines(spark):
    """The closed form equals the one by segments, and its plan has no lambda, which Spark would interpret row by row."""
    r = np.random.default_rng(2)
    corners = lambda: [int(v) for k in range(2) for v in [r.integers(0, 30)]]
    rows = []
    for _ in range(600):
        (ax, ay), (bx, by) = corners(), corners()
        rows.append(((ax, ay, ax + int(r.integers(0, 30)), ay + int(r.integers(0, 30))), (bx, by, bx + int(r.integers(0, 30)), by + int(r.integers(0, 30)))))
    rows.append(((0, 0, None, 1), (0, 0, 1, 1)))
    kind = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    made = df.select(P.hausdorff_boxes(a, b).alias("d"), P.hausdorff(P.of_box(a), P.of_box(b)).alias("e"), a["x1"].isNull().alias("none"))
    got = made.collect()
    assert sum(x.none for x in got) == 1 and all(x.d is None if x.none else abs(x.d - x.e) < 1e-9 for x in got)
    from annolyte.plans import registry

    registry.load()
    path = "/root/testdata/sf0.001"
    plan = registry.QUERIES["hausdorff_rect"](spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_matches_in_bits_are_those_of_each_threshold():
    r = np.random.default_rng(6)
    for _ in range(300):
        n, m = int(r.integers(0, 6)), int(r.integers(0, 6))
        near = [[float(v) for v in r.choice([0.0, 0.3, 0.5, 0.55, 0.7, 0.7, 0.95, 1.0], m)] for _ in range(n)]
        sizes = lambda k: [float(v) for v in r.choice([100.0, 1024.0, 5000.0, 9216.0, 20000.0, 2e10], k)]
        args = ([(int(i), -float(r.integers(0, 4))) for i in range(n)], near, sizes(n), sizes(m), [bool(v) for v in r.random(m) < 0.2], E.AREAS)
        got = [(7, a, t, i, k, p, bool(hits >> b & 1)) for a, i, k, p, counts, hits in E.judged_bits(*args) for b, t in enumerate(E.IOU_THRESHOLDS) if counts >> b & 1]
        want = E.judged((7,), *args)
        assert sorted(got) == sorted(want)
        assert len(E.judged_bits(*args)) <= len(E.AREAS) * n  # a row for all thresholds
