"""Queries answer for all rows of their tables, against brute force over a small fixture."""

import datetime
import random

import pytest
from annolyte.operators import kernels as K
from annolyte.plans import evaluation, registry, video_queries
from annolyte.plans.virtual import preds, shapes

registry.load()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Cases of one video, of seven lines each."""
    r, folder = random.Random(7), tmp_path_factory.mktemp("small")
    rows = [(case, r.randint(1, 2000), r.randint(1, 100), n, float(r.randint(1, 50)), 100.0 + n, 0.01, 0.02, r.choice("RAN"), r.choice("OF"), datetime.datetime(1995, 1, 1)) for case in (1, 2, 33, 34, 65) for n in range(1, 8)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def tracks_of(rows, key):
    return {(r.case_id // 320, r.case_id // 32 % 10, r[key]) for r in rows.collect()}


def test_tracks_have_every_line_and_prediction(spark, small):
    g, d = tracks_of(shapes(spark, small), "line"), tracks_of(preds(spark, small), "pred_id")
    assert max(x[2] for x in g) == 7 and max(x[2] for x in d) > 4
    got = {(r.side, r.video_id, r.frame, r.id) for r in evaluation._tracks(spark, small).collect()}
    assert got == {(0, *x) for x in g} | {(1, *x) for x in d}
    for df, key, all_of in ((shapes(spark, small), "line", g), (preds(spark, small), "pred_id", d)):
        assert {(r.video_id, r.frame, r.id) for r in video_queries._side(df, key).collect()} == all_of


def test_hota_counts_every_track(spark, small):
    n = len(tracks_of(shapes(spark, small), "line"))
    assert {r.tp + r.fn for r in registry.QUERIES["hota_combined"](spark, small).collect()} == {n}


def test_track_nms_judges_every_track(spark, small):
    boxes, score = {}, {}
    for r in preds(spark, small).collect():
        b = boxes.setdefault(r.pred_id, {}).setdefault(r.case_id // 32 % 10, [r.x0, r.y0, r.x1, r.y1])
        b[:] = [min(b[0], r.x0), min(b[1], r.y0), max(b[2], r.x1), max(b[3], r.y1)]
        score[r.pred_id] = max(score.get(r.pred_id, r.score), r.score)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def iou(p, q):
        inter = union = 0
        for f in p.keys() & q.keys():
            (a, b), both = (p[f], q[f]), 0
            both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
            inter, union = inter + both, union + area(a) + area(b) - both
        return inter / union if union else 0.0

    kept = []
    for i in sorted(boxes, key=lambda i: (-score[i], i)):
        if all(iou(boxes[i], boxes[k]) <= 0.5 for k in kept):
            kept.append(i)
    assert sorted(r.pred_id for r in registry.QUERIES["track_nms"](spark, small).collect()) == sorted(kept) and max(kept) > 4


def test_genetic_packing_has_its_full_budget(spark, small, monkeypatch):
    """The query asks for no smaller search than the kernel's own: 50 x 20."""
    asked = {}
    monkeypatch.setattr(evaluation, "packed", lambda parts, genetic, size=1008, **kw: asked.update(kw, genetic=genetic))
    registry.QUERIES["ga_binpack"](spark, small)
    made = K.Genetic({0: (10, 10)}, 1008, 1008, **{k: v for k, v in asked.items() if k != "genetic"})
    assert asked["genetic"] and (made.population, made.generations) == (50, 20)


def test_genetic_packing_is_the_kernels_search(spark, small):
    want = {}
    for r in evaluation.partitions(evaluation._regions(spark, small)).orderBy("partition_id").collect():
        want.setdefault(r.case_id, {})[r.partition_id] = (r.x1 - r.x0, r.y1 - r.y0)
    want = {c: K.Genetic(sizes, 1008, 1008).run()[1] for c, sizes in want.items()}
    assert {r.case_id: r.fitness for r in registry.QUERIES["ga_binpack"](spark, small).collect()} == want
