"""Record loaders, video chains and larger operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from annolyte.functions import box as B
from annolyte.functions import shapes as S
from annolyte.operators import assemble as A
from annolyte.operators import video as Y
from annolyte.sources import coco as C
from annolyte.sources import records as R

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def b(*v):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))


def test_phrases_and_frames(spark):
    images = spark.createDataFrame([("d", 5, "cat"), ("d", 2, "dog")], "dataset string, id long, text_input string")
    assert [(r.image_id, r.query_id, r.text) for r in R.phrase_queries(images).orderBy("query_id").collect()] == [(2, 0, "dog"), (5, 1, "cat")]
    videos = spark.createDataFrame([("d", 1, ["a", "b"])], "dataset string, id long, file_names array<string>")
    cats = spark.createDataFrame([("d", 7, "cat")], "dataset string, id long, name string")
    good = spark.createDataFrame([("d", 1, 7, "cat")], "dataset string, video_id long, category_id long, name string")
    assert R.video_phrase_queries(videos, good, cats).count() == 2
    with pytest.raises(Exception, match="unlike names"):
        R.video_phrase_queries(videos, good.withColumn("name", F.lit("dog")), cats).collect()


def test_running_ids_follow_groups(spark):
    rows = spark.createDataFrame([("x", g, i) for g in (3, 1, 2) for i in range(g)], "d string, g long, i long").repartition(5)
    got = {(r.g, r.i): r.n for r in C.running_ids(rows, ["d"], "g", ["i"], "n").collect()}
    assert got == {k: n for n, k in enumerate(sorted(got))}
    assert C.running_ids(rows.limit(0), ["d"], "g", ["i"], "n").collect() == []


def test_masklets_and_results(spark):
    a = spark.createDataFrame([(1, 9, [64.0, 48.0, 32.0, 24.0], 0.5, 640, 480), (1, 3, [0.1, 0.1, 0.2, 0.2], None, 640, 480)], "image_id long, id long, bbox array<double>, score double, width long, height long")
    got = R.masklets(a, True).orderBy("obj_id").collect()
    assert got[0].box == [0.1, 0.1, 0.2, 0.2] and got[0].prob is None and got[1].box == pytest.approx([0.1, 0.1, 0.05, 0.05]) and got[1].prob == 0.5
    issues = spark.createDataFrame([(1, "NA", None, "r"), (1, "3", "i.jpg", "s")], "case_id long, id string, image string, reason string")
    metrics = spark.createDataFrame([(1, 1, 2, 3, 4, 0.25, 0.2), (2, 0, 0, 0, 0, 0.0, 0.0)], "case_id long, tp long, tn long, fp long, fn long, precision double, recall double")
    docs = {r.case_id: json.loads(r.json) for r in R.result_documents(issues, metrics, ["case_id"]).collect()}
    assert len(docs[1]["Labels with Issue"]) == 2 and docs[1]["False Positives Num"] == 3 and docs[2]["Labels with Issue"] == []


def test_feature_table_round_trip(spark, tmp_path):
    row = spark.createDataFrame([("c", "1", 2.0, 30.0, 1.0, 0.1, 1.0, 0.1, None, 0.2, True)], R.FEATURES)
    R.write_features(row, str(tmp_path / "f"))
    assert R.read_features(spark, str(tmp_path / "f")).collect() == row.collect()


def test_shapes(spark):
    c = S.circle(F.lit(5.0), F.lit(5.0), F.lit(2.0))
    box = B.box(F.lit(1.0), F.lit(2.0), F.lit(11.0), F.lit(12.0))
    half = tuple(F.lit(0.5) for _ in range(4))
    r = spark.range(1).select(S.radius(c).alias("r"), S.region(F.lit("circle"), c).alias("g"), S.whole_region(box).alias("w"), S.noisy(box, half, 0.2, 10, 100, 100).alias("same"),
                              S.noisy(box, (F.lit(0.999), F.lit(0.999), F.lit(0.0), F.lit(0.0)), 0.9, 10, 100, 100).alias("kept"), S.shape_area(F.lit("line"), c).alias("none")).first()
    assert r.r == 2 and tuple(r.g) == (3, 3, 7, 7) and tuple(r.w) == (2, 3, 12, 13) and tuple(r.same) == tuple(r.kept) == (1, 2, 11, 12) and r.none == 0


def test_tracks_and_chains(spark):
    gt = spark.createDataFrame([(1, i, f, b(20 * i, 0, 20 * i + 10, 10)) for i in (0, 1) for f in range(3)], f"v long, id long, frame long, box {BOX}")
    dt = gt.withColumn("score", F.when(F.col("id") == 0, 0.9).otherwise(0.5))
    hits = {(r.thr, r.id): r.hit for r in Y.track_ap(gt, dt, ["v"], "v long").where("area = 'all'").collect()}
    assert all(hits.values()) and len(hits) == 20
    h = Y.phrase_hota(gt, dt, ["v"], "v long", 0.5).where("alpha = 0.5").first()
    assert (h.tp, h.fn) == (3, 3)  # HOTA's gate is strict, TETA's is not (Q38)
    t = Y.video_teta(gt.withColumn("cls", F.lit(1)), dt.withColumn("cls", F.lit(1)), ["v"], "v long", 0.5, nms=0.5).where("alpha = 0.5").first()
    assert t.loc_tp == 6 and t.teta == pytest.approx(1)


def test_curation_and_back_mapping(spark):
    gt = spark.createDataFrame([(1, 1, b(0, 0, 10, 10)), (1, 2, b(50, 50, 60, 60))], f"c long, id long, box {BOX}")
    dt = spark.createDataFrame([(1, 1, b(0, 0, 10, 9)), (1, 2, b(0, 0, 9, 10)), (1, 3, b(80, 80, 90, 90))], f"c long, id long, box {BOX}")
    got = A.curated(gt, dt, ["c"]).orderBy("category_id").collect()
    assert [(r.source, r.gt_id, r.dt_id) for r in got] == [("gt", 1, 1), ("gt", 1, 2), ("model", None, 3)]
    placed = spark.createDataFrame([(1, 0, 5, 10, 20, 30, 50, False, 100.0, 200.0), (1, 0, 6, 100, 0, 50, 30, True, 7.0, 9.0)], "c long, bin_id long, partition_id long, x long, y long, w long, h long, turned boolean, dx double, dy double")
    marks = spark.createDataFrame([(1, 0, 1, b(15, 25, 20, 30)), (1, 0, 2, b(105, 5, 110, 8))], f"c long, bin_id long, id long, box {BOX}")
    back = {r.id: tuple(r.box) for r in A.back_mapped(marks, placed, ["c"]).collect()}
    assert back[1] == (100, 200, 105, 205) and back[2] == (7, 9, 10, 14)
