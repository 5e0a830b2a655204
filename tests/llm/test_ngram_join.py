"""N-gram Jaccard join: components equal those of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolyte.llm import ngram_join as J
from annolyte.llm.near_dedup import keep_one_of_each
from annolyte.llm.ngram_join import jaccard_components
from annolyte.llm.signature_tree import Tree, bitmaps, dual, levels_for, link


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(sets):
    up = {k: k for k in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "He", "Ä"]) for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.5:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
            t = t.upper() if r.random() < 0.1 and t.isascii() else t
        else:
            t = " ".join(word() for _ in range(r.choice([1, 3, 5, 20, 60, 120])))
            if r.random() < 0.4:
                t += "\n" + r.choice(passages)
        texts.append(t)
    return texts


@pytest.mark.parametrize(("seed", "block", "stand", "crowd"), [(1, 2048, 8192, 64), (2, 3, 8192, 2), (3, 4, 2, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, block, stand, crowd):
    monkeypatch.setattr(J, "STAND", stand)
    monkeypatch.setattr(J, "CROWD", crowd)
    texts = corpus(seed)
    rows = [(i * 7 % 1009, t, "c") for i, t in enumerate(texts)] + [(2000, None, "c"), (2001, "", "c"), (2002, " \t\n", "c"), (2003, "one word", "c"), (2004, "ONE  word", "c"), (2005, "x y " * 20_000, "c"), (2006, "x y " * 19_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, block=block).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_repeats_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted([tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)], key=repr)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _id string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=repr) == [1, None]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_ids_with_several_texts(spark, parts):
    """The least text counts, however rows are dealt; each row gets its row back."""
    rows = [(3, "z y x w v"), (3, "a b c d e f"), (3, None), (1, "z y x w v"), (2, "a b c d e f"), (None, "z y x w v"), (None, None), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted([tuple(r) for r in jaccard_components(docs).collect()], key=repr)
    assert got == sorted([(3, 2, 2)] * 3 + [(1, 1, 1), (2, 2, 2), (None, 1, None), (None, 0, None)] + [(4, 0, 4)] * 2, key=repr)
    kept = sorted([tuple(r) for r in keep_one_of_each(docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).select("doc_id", "text").collect()], key=repr)
    assert kept == sorted([(1, "z y x w v"), (2, "a b c d e f"), (4, None), (None, "z y x w v"), (None, None)], key=repr)


def test_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError, match="ids of type string"):
        jaccard_components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_tree_loses_no_pair():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 60, r.integers(1, 200), dtype=np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.r_[s[: max(1, len(s) * 4 // 5)], r.integers(0, 1 << 60, len(s) // 8, dtype=np.uint64)]) for s in base for _ in range(3)]
    sizes = np.array([len(s) for s in sets])
    t = Tree(bitmaps(sets, 256), sizes, np.arange(len(sets)), levels_for(len(sets)))
    left = {(int(a), int(b)) for i, j in dual(t, t, True) for a, b in zip(i, j)}
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jac(sets[i], sets[j]) >= 0.75}
    assert want and want <= left and len(left) < len(sets) * (len(sets) - 1) // 4
    g = link(sets).array()
    for i, j in want:
        assert g[i] == g[j]


def test_like_sets_share_a_head_and_chance_does_not():
    """Any two sets at 0.75 share a head, with common tokens too; sets that share single tokens by chance share none, so no bitmap is sent for these."""
    r = np.random.default_rng(11)
    pool = np.unique(r.integers(0, 1 << 63, 30, dtype=np.uint64))
    for n in [*range(1, 60), 200, 601]:
        for common in (pool[:0], pool):
            a = np.unique(np.r_[r.integers(0, 1 << 63, n, dtype=np.uint64), r.choice(pool, min(n, 20), replace=False)])[:n] if n > 2 else r.integers(0, 1 << 63, n, dtype=np.uint64)
            n = len(a)
            for gone in range(n // 4 + 1):
                more = int((n - gone) / 0.75 + 1e-9) - n
                b = np.unique(np.r_[r.permutation(a)[: n - gone], r.integers(0, 1 << 63, max(more, 0), dtype=np.uint64)])
                if n > 2 and len(b) > 2:
                    assert len(np.intersect1d(J.heads(a, common), J.heads(b, common))), (n, gone, more)
    shared = np.sort(r.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.r_[r.integers(0, 1 << 63, 400, dtype=np.uint64), s]) for s in shared for _ in range(4)]
    rows = [x for i in range(0, 240, 60) for x in J._sent(list(range(i, i + 60)), [sets[4 * (k % 60) + i // 60] for k in range(60)], pool[:0], 1, 0)]
    met = J._Bucket()
    late = [x for _, kind, raw in rows if kind == J.TOKEN for x in met.add(raw)]
    assert not late and sum(len(x[1]) for x in met.close()) == 0


@pytest.mark.parametrize(("seed", "crowd", "held"), [(5, 2, 10), (6, 3, 40), (7, 1, 200)])
def test_crowded_buckets_in_parts(spark, monkeypatch, seed, crowd, held):
    """Tokens that many tasks send are tied in parts of a bucket: no link goes."""
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "HELD", held)
    monkeypatch.setattr(J, "GATHER", 7)
    monkeypatch.setattr(J, "BUCKETS", 1)
    monkeypatch.setattr(J, "SHINGLES", 30)
    monkeypatch.setattr(J, "STAND_BYTES", 2000)
    texts = corpus(seed, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = {r.doc_id: r.component_id for r in jaccard_components(df, block=8).collect()}
    assert got == components({i: shingles(t) for i, t in enumerate(texts)})


def test_bucket_in_parts_ties_what_a_whole_one_does():
    r = np.random.default_rng(3)
    rows = np.stack((r.integers(0, 40, 4000) * 64 + r.integers(3, 6, 4000), r.integers(0, 300, 4000)), 1).astype(np.int64)

    def groups(most):
        J_held, J.HELD = J.HELD, most
        try:
            b = J._Bucket()
            made = [x for i in range(0, len(rows), 100) for x in b.add(rows[i : i + 100].tobytes())] + list(b.close())
        finally:
            J.HELD = J_held
        tied = {(k, int(x), int(y)) for k, xs, ys in made for x, y in zip(xs, ys, strict=True)}
        edges = {(x, y) for k, x, y in tied if k == J.EDGE} | {(x, x) for x in range(300)}
        late = {(x, y) for k, x, y in tied if k == J.LATE}
        stands = edges | {(x, h) for x, y in late for v, h in edges if v == y}
        return {h: {x for x, k in stands if k == h} for _, h in stands}, late

    whole, none = groups(10_000)
    parted, late = groups(500)
    assert not none and late
    assert all(any(members <= m for m in parted.values()) for members in whole.values())
