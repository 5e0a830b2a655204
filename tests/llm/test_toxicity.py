"""Toxicity: held-out accuracy, counterfactual pairs, and odd inputs."""

import numpy as np
import random
import zlib

from pyspark.sql import functions as F

from annolyte.llm.toxicity import SWAP, Model, fit, held_out, keep_nontoxic, score_texts, train, words

BAD = ["stupid", "trash", "loweiig", "loweien"]


def corpus(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(r.choice(["tha", "er", "on", "ing", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = train(docs, labels.where(~held_out()))
    got = {r.doc_id: r.score for r in score_texts(docs, model).collect()}
    test = [(got[i] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p and y for p, y in test) >= 0.95 * sum(y for _, y in test) and sum(p and not y for p, y in test) <= 0.01 * len(test)
    kept = keep_nontoxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_identity_terms_alone_do_not_count():
    r = random.Random(3)
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        w = {f"w{r.randint(0, 60)}" for _ in range(10)} | ({r.choice(BAD), "women"} if toxic else set())
        rows.append((w, int(toxic)))
    plain, fair = fit(rows, penalty=0.0), fit(rows, penalty=30.0)
    neutral = "the women of the town w1 w2"
    assert fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5
    swapped = neutral.replace("women", SWAP["women"])
    assert abs(fair.score(neutral) - fair.score(swapped)) < abs(plain.score(neutral) - plain.score(swapped))
    assert fair.score("stupid trash w1") > 0.7


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "stupid"), (3, "x " * 100_000), (3, "x " * 100_000)], "doc_id long, text string")
    m = Model(-3.0, {"stupid": 5.0})
    got = sorted([(r.doc_id, round(r.score, 6)) for r in score_texts(docs, m).collect()], key=repr)
    base = round(Model(-3.0, {}).score(""), 6)
    assert got == sorted([(1, base), (2, base), (3, base), (3, base), (None, round(m.score("stupid"), 6))], key=repr)
    assert score_texts(docs.limit(0), m).collect() == []
    empty = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= empty.score("anything") <= 1
    one = fit([({"a"}, 0)] * 5)
    assert one.score("a") < 0.5 and words("ÄB c1") == {"äb", "c"}


def test_split_is_by_crc(spark):
    ids = [r.id for r in spark.range(200).where(held_out("id")).collect()]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).where(held_out("id")).count() == 0


def test_gradient_equals_differences_of_the_loss():
    from annolyte.llm.toxicity import _Rows, loss

    r = np.random.default_rng(2)
    size = 12
    rows = lambda n: _Rows([np.sort(r.choice(size, r.integers(0, 6), replace=False)) for _ in range(n)], r.random(size) + 0.5)
    base, left, right = rows(20), rows(7), rows(7)
    y = (r.random(20) < 0.4).astype(float)
    weight, w, b = r.random(20), r.normal(size=size), 0.3
    dense = np.zeros((20, size))
    np.add.at(dense, (base.row, base.flat), base.x)
    p = 1 / (1 + np.exp(-(dense @ w + b)))
    plain = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.05 * (w**2).sum() / 2 / 20**0.5
    value, _, _ = loss(base, y, weight, left, right, w, b, 0.0, 0.05)
    assert abs(value - plain) < 1e-9
    value, grad, gb = loss(base, y, weight, left, right, w, b, 0.7, 0.05)
    at = lambda w, b: loss(base, y, weight, left, right, w, b, 0.7, 0.05)[0]
    h = 1e-6
    for i in range(size):
        e = np.zeros(size)
        e[i] = h
        assert abs((at(w + e, b) - at(w - e, b)) / (2 * h) - grad[i]) < 1e-6
    assert abs((at(w, b + h) - at(w, b - h)) / (2 * h) - gb) < 1e-6
