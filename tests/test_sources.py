"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolyte.functions import text as X
from annolyte.functions import vec as V
from annolyte.functions.tokenizer import Merges, contexts, encoded
from annolyte.operators import raster as R
from annolyte.sources import annotations as A
from annolyte.sources import coco as C


def test_annotation_files(spark, tmp_path):
    doc = {"flags": {}, "Labels": [{"Label": "Wires", "Shapes": [
        {"Type": "polygon", "points": [[1, 2], [3, 4]], "thickness": [2, 4], "Attributes": {"category_id": 1}}, {"Type": "circle", "points": [[0, 0], [2, 0]], "thickness": [0, 1]}, {"Type": "line", "points": [[0, 0]], "thickness": [1, 2]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("broken {")
    files = A.read_files(spark, str(tmp_path))
    assert files.count() == 2
    rows = A.shapes_of(files, ["WIRE", "wires", "x"], 2.0).collect()
    assert len(rows) == 9 and sum(r.selected for r in rows) == 6  # once for each name (Q1)
    first = {r.shape_index: r for r in rows if r.name == "WIRE"}
    assert first[0].points == [[2, 4], [6, 8]] and first[0].thickness == [4, 8] and first[1].thickness is None and first[2].thickness is None
    assert A.shapes_of(files, None).count() == 3
    again = json.loads(A.to_json(A.shapes_of(files)).first().json)
    shape = again["Labels"][0]["Shapes"][1]
    assert "thickness" not in shape and "score" not in shape and shape["points"] == [[0, 0], [2, 0]]
    A.write(A.to_json(A.shapes_of(files)).withColumn("case_id", F.lit("c1")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert json.loads(A.header_only(files).where("json LIKE '%flags%'").first().json) == {"flags": {}}


def test_lists_frames_and_settings(spark, tmp_path):
    (tmp_path / "cases.txt").write_text("d1/a\n\n  d2/sub/b \n")
    assert sorted(map(tuple, A.case_list(spark, str(tmp_path / "cases.txt")).collect())) == [("d1", "a"), ("d2/sub", "b")]
    (tmp_path / "pool.txt").write_text("x, y,\nz")
    assert [r.name for r in A.name_pool(spark, str(tmp_path / "pool.txt")).orderBy("place").collect()] == ["x", "y", "z"]
    (tmp_path / "v").mkdir()
    for n in ("10.jpg", "9.jpg", "2.jpg"):
        (tmp_path / "v" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in A.frames(spark, str(tmp_path / "v")).orderBy("frame").collect()] == ["2.jpg", "9.jpg", "10.jpg"]
    (tmp_path / "c.yaml").write_text("labels: [wire]\n")
    assert A.config(str(tmp_path / "c.yaml")) == A.config({"labels": ["wire"]})


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 0, "file_name": "a"}, {"id": 1, "file_name": "b"}], "categories": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}],
           "annotations": [{"id": 5, "image_id": 0, "category_id": 1, "bbox": [0, 0, 2, 3], "area": 6, "iscrowd": 0}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    i, a, c = C.tables(C.read(spark, str(tmp_path / "a.json")))
    assert [len(r.annotations) for r in C.by_image(i, a).collect()] == [1, 0]
    assert C.datapoints(i, a, c, 1).count() == 4 and C.datapoints(i, a, c, 1, negatives=False).count() == 1
    i2, a2, c2 = C.one_based(i, a, c)
    assert sorted(r.id for r in i2.collect()) == [1, 2] and a2.first().image_id == 1 and a2.first().id == 5 and sorted(r.id for r in c2.collect()) == [1, 2]
    res = spark.createDataFrame([("d", 0, 0.5, [0.0, 0.0, 2.0, 4.0], None), ("d", 9, 0.1, [0.0] * 4, 1.0)], "dataset string, image_id long, score double, bbox array<double>, area double")
    done = C.completed(res).orderBy("image_id").collect()
    assert done[0].area == 8 and C.unknown_images(res, i.withColumn("dataset", F.lit("d"))).count() == 1


def test_video_predictions_skip_empty_frames(spark):
    v = spark.createDataFrame([("d", 7, ["a", "b", "c"], 10, 10)], "dataset string, id long, file_names array<string>, width long, height long")
    t = spark.createDataFrame([("d", 1, 7, 3, 0, 0.9, [None, [0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 2.0, 3.0]], [None, 0.0, 0.0])], "dataset string, id long, video_id long, category_id long, iscrowd long, score double, bboxes array<array<double>>, areas array<double>")
    images = C.video_frames(v)
    assert [r.area for r in C.track_annotations(t, images, pred=True).collect()] == [6.0] and C.track_annotations(t, images).count() == 2


def test_detections(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1, 4, 0.5, 1\n2,5,x,0\n\n1,6,0.1,2\n")
    rows = {(r.timestep, r.id): r for r in C.detections(spark, str(tmp_path / "d.txt"), crowd_cols={3: [2.0]}).collect()}
    assert rows[1, 6].is_crowd and not rows[1, 4].is_crowd and rows[2, 5]["values"][2] is None
    assert C.detections(spark, str(tmp_path / "d.txt"), keep={3: [1.0, 0.0]}).count() == 2


def test_text_functions(spark):
    r = spark.range(1).select(
        X.canonical(F.lit("A_b, {c}!  D"), keep="{c}").alias("c"), X.cleaned(F.lit(" &amp;lt;x ")).alias("e"), X.tokens(F.lit("It's 42 ok!!")).alias("t"), X.context(F.array(*[F.lit(i) for i in range(9)]), 100, 101, 5).alias("cut"),
        X.context(F.array(F.lit(7)), 100, 101, 5).alias("pad"), X.html_escaped(F.lit("<a&'>")).alias("h"), V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"),
    ).first()
    assert (r.c, r.e, r.t, r.cut, r.pad, r.h) == ("a b {c} d", "<x", ["it", "'s", "4", "2", "ok", "!!"], [100, 0, 1, 2, 101], [100, 7, 101, 0, 0], "&lt;a&amp;&#x27;&gt;")
    assert r.cos == pytest.approx(2**-0.5)


def test_byte_pairs(spark):
    m = Merges({("l", "o"): 0, ("lo", "w</w>"): 1}, {"l": 1, "o": 2, "w</w>": 3, "lo": 4, "low</w>": 5, "w": 6})
    df = spark.createDataFrame([(1, "Low"), (2, None), (3, "lol low")], "k long, t string")
    got = {r.k: r.ids for r in encoded(df, "k", "t", m).collect()}
    assert got == {1: [5], 2: [], 3: [4, 5]} and m.decode([5, 5]) == "low low"
    assert contexts(encoded(df, "k", "t", m), 8, 9, 4).where("k = 1").first().ids == [8, 5, 9, 0]


def test_masks():
    m = R.filled([(2, 2), (12, 2), (12, 5), (2, 5)], 20, 20)
    assert m.sum() == 44 and R.outline(m).sum() == 26
    width, ends, boxes = R.stroke([[(2, 8), (60, 8), (60, 14), (2, 14)]], 30, 80)
    assert 4 <= width <= 8 and len(ends) == 2 and boxes == [(2, 8, 61, 15)]
    assert R.stroke([], 5, 5) == (None, [], []) and R.features(np.zeros((5, 5, 3)), [])["stroke_width"] is None
    f = R.features(np.full((20, 20, 3), 7.0), [(2, 2), (12, 2), (12, 5), (2, 5)])
    assert f["average_value"] == 7 and f["value_sd"] == 0 and f["stroke_length"] > 3
    assert R.boundary_f(m, m) == 1 and R.boundary_f(m, np.zeros_like(m)) == 0 and R.boundary_f(m & False, m & False) == 1
    ious = R.mask_ious(np.stack([m, m, ~m]))
    assert R.nms(ious, np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]
    frame = np.zeros((30, 30))
    R.transposed_into(frame, np.ones((4, 6)), 3, 2, 14, 16, True)
    assert frame.sum() == 24 and frame[7, 8] == 1
    t = R.track_ious([{0: (0, 0, 2, 2), 1: (0, 0, 2, 2)}], [{0: (0, 0, 2, 2)}, {5: (0, 0, 1, 1)}])
    assert t.tolist() == [[1.0, 0.0]]


def test_thick_lines():
    p = R.thick_line([(0, 0), (10, 0)], [2, 2])
    assert sorted(map(tuple, p.tolist())) == [(0, -1), (0, 1), (10, -1), (10, 1)]
    corner = R.thick_line([(0, 0), (10, 0), (10, 10)], [2, 2, 2])
    assert corner[1].tolist() == pytest.approx([9, 1])


def test_a_coco_data_set_in_several_documents(spark, tmp_path):
    """Categories that several documents of a data set list count once; the queries' documents stay small however many images there are."""
    doc = lambda i: json.dumps({"images": [{"id": i, "file_name": "f"}], "annotations": [{"id": i, "image_id": i, "category_id": 0, "bbox": [0, 0, 1, 1], "area": 1}], "categories": [{"id": 0, "name": "c"}, {"id": 1, "name": "d"}]})
    docs = spark.createDataFrame([("x", doc(0)), ("x", doc(5))], "dataset string, j string").select("dataset", F.try_parse_json("j").alias("v"))
    i, a, c = C.tables(docs)
    assert sorted(r.id for r in i.collect()) == [0, 5] and sorted(r.id for r in c.collect()) == [0, 1]
    assert sorted((r.image_id, r.chunk, len(r.queries)) for r in C.datapoints(i, a, c, 1).collect()) == [(0, 0, 1), (0, 1, 1), (5, 0, 1), (5, 1, 1)]
    assert sorted((r.image_id, r.category_id) for r in C.one_based(i, a, c)[1].collect()) == [(1, 1), (6, 1)]
    from annolyte.plans import io_queries

    rows = [(32 * k + j, 7 * k + j, k + j, j + 1, 5.0, 1.0, 0.0, 0.0, "R", "F") for k in range(500) for j in range(3)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = io_queries._coco(spark, str(tmp_path)).select("dataset", F.size(F.try_variant_get("v", "$.images", C.IMAGES)).alias("n")).collect()
    assert {r.dataset for r in made} == {"d0", "d1", "d2"} and max(r.n for r in made) <= 64 and sum(r.n for r in made) >= 500
