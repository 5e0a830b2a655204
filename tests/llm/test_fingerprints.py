"""Fingerprints: likeness estimates generalised Jaccard; edits and neighbours as defined."""

import hashlib
import random

import numpy as np

from annolyte.llm.fingerprints import Sampler, fingerprints, fingerprints_of_edits, likeness, terms


def jaccard(a, b):
    keys = {*a, *b}
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collisions_estimate_generalised_jaccard():
    r = random.Random(1)
    errors = []
    for _ in range(40):
        a = terms(" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(300)))
        b = a.copy()
        for k in r.sample(sorted(b), len(b) // 2):
            b[k] = r.choice([0, 1, b[k] + 1, 3 * b[k]])
        b = +b
        s = Sampler(1024).sign([a, b])
        errors.append(likeness(s[:1], s[1:])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.025


def test_edits(spark):
    r = random.Random(2)
    rows = [(i * 3, " ".join(r.choice(["tha", "ern", "ding", "ha", "the", "of"]) + str(r.randint(0, 40)) for _ in range(r.randint(0, 80))), "x") for i in range(120)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "short", "x"), (1004, "é" * 70_000, "x")]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string, fingerprint string").repartition(7)
    got = {x.doc_id: x for x in fingerprints_of_edits(df).collect()}
    assert len(got) == len(rows)
    plain = {x.doc_id: x.fingerprint for x in fingerprints(df).collect()}
    texts = [(i, t or "") for i, t, _ in rows]
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        n = len(t) // 4
        edit = t[: len(t) - n] + nxt[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert got[i].fingerprint == plain[i]
        s = Sampler().sign([terms(t), terms(edit), terms(nxt)])
        assert got[i].near_edited == likeness(s[:1], s[1:2])[0] and got[i].near_next == likeness(s[:1], s[2:])[0]
    assert got[1000].fingerprint == got[1001].fingerprint == got[1002].fingerprint


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")
    got = fingerprints_of_edits(df).collect()
    assert len(got) == 1 and got[0].near_next == 1.0
    assert fingerprints_of_edits(df.limit(0)).collect() == []


def plain_icws(a, samples):
    """Consistent weighted sampling as published, in doubles, one term at a time: (term, t) of the least ln a in each sample."""
    out = []
    for k in range(samples):
        best = None
        for term, w in a.items():
            r = random.Random(f"{k} {term}")
            rr, c = r.gammavariate(2, 1), r.gammavariate(2, 1)
            b = r.random()
            t = np.floor(np.log(w) / rr + b)
            ln_a = np.log(c) - rr * (t - b + 1)
            if best is None or ln_a < best[0]:
                best = ln_a, term, t
        out.append(best[1:])
    return out


def test_estimates_match_plain_sampling():
    """Two independent draws of the same method estimate the same likeness."""
    r = random.Random(8)
    for _ in range(4):
        a = terms(" ".join(f"w{int(r.paretovariate(0.8))}" for _ in range(80)))
        b = a.copy()
        for k in r.sample(sorted(b), len(b) // 3):
            b[k] += r.choice([1, 2, 5])
        true = jaccard(a, b)
        x, y = plain_icws(a, 600), plain_icws(b, 600)
        plain = np.mean([p == q for p, q in zip(x, y, strict=True)])
        s = Sampler(600).sign([a, b])
        assert abs(plain - true) < 0.07 and abs(likeness(s[:1], s[1:])[0] - plain) < 0.09


def test_repeated_rows_null_ids_and_many_partitions(spark):
    r = random.Random(4)
    rows = [(r.choice([None, None, 7, 7, i]), f"text number {i % 9} of some words " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        got = fingerprints_of_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_chars) for x in got) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    # Distinct ids behind the repeated ones have the plain order's next text.
    ids = sorted({i for i, _ in rows if i is not None and i > 7})
    texts = {i: t for i, t in rows if i in ids}
    by = {x.doc_id: x for x in got}
    for i, j in zip(ids, ids[1:]):
        n = len(texts[i]) // 4
        assert by[i].edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - n] + texts[j][:n]).encode()).hexdigest()


def test_text_ids_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        fingerprints_of_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
