"""Best-fit packing under conflicts, and line deduplication, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest

from annolyte.llm import line_dedup as L
from annolyte.llm.packing import best_fit, pack


def plain_best_fit(sizes, sources, clusters, capacity):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, out = [], [0] * len(sizes)
    for i in order:
        ok = [(b[0], k) for k, b in enumerate(bins) if b[0] >= max(sizes[i], 1) * 1 - (sizes[i] == 0) and b[0] > 0 and sources[i] not in b[1] and clusters[i] not in b[2]]
        ok = [(left, k) for left, k in ok if left >= sizes[i]]
        if ok:
            _, k = min(ok)
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= sizes[i]
        bins[k][1].add(sources[i]) if sources[i] >= 0 else None
        bins[k][2].add(clusters[i]) if clusters[i] >= 0 else None
        out[i] = k
    return out


def test_tightest_compatible_bin():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(0, 60)
        sizes = [r.randint(0, 100) for _ in range(n)]
        sources = [r.choice([-1, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [r.choice([-1, -1, 5, 6, 7, 8]) for _ in range(n)]
        assert best_fit(sizes, sources, clusters, 100) == plain_best_fit(sizes, sources, clusters, 100)


def test_pieces_and_conflicts(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 3, 50, 90, 250, None]), r.choice(["hot", "hot", "a", "b", None]), r.choice([None, i % 9, i])) for i in range(300)] + [(None, 10, "a", 1), (5, 7, "a", 2), (5, 7, "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, words int, source string, cluster long").withColumnRenamed("cluster", "bin")
    got = pack(df, "doc_id", "words", "source", "bin", capacity=100, shard=80).collect()
    want = Counter()
    for i, n, *_ in rows:
        want[i] += n or 0
    total = Counter()
    for x in got:
        total[x.doc_id] += x.length
        assert x.start == 100 * x.piece and x.length <= 100
    assert total == want and len(got) == sum(max(1, -(-(n or 0) // 100)) for _, n, *_ in rows)
    bins = defaultdict(list)
    for x in got:
        bins[x.shard, x.bin].append(x)
    known = {i: (s, c) for i, n, s, c in rows if i not in (None, 5)}
    for b in bins.values():
        assert sum(x.length for x in b) == b[0].fill <= 100
        own = [known[x.doc_id] for x in b if x.doc_id in known]
        for k in (0, 1):
            values = [o[k] for o in own if o[k] is not None]
            assert len(values) == len(set(values))
    assert pack(df.limit(0), "doc_id", "words", "source", "bin").collect() == []


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_lines(spark, broadcast):
    r = random.Random(3)
    common = ["All rights reserved.", "  Share this \t", "x"]
    rows = []
    for i in range(200):
        host = r.choice(["hot", "hot", "b", None])
        lines = [f"own line {i} {k}" for k in range(r.randint(0, 4))] + [c for c in common if r.random() < 0.2] + r.choice([[], [""], ["", ""]])
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), host, "keep"))
    rows += [(900, None, "hot", "keep"), (901, "", "hot", "keep"), (902, "All rights reserved.\n" * 5000, "hot", "keep")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _host string")
    got = {x.doc_id: x for x in L.drop_boilerplate(df, ratio=0.1, min_pages=3, broadcast=broadcast).collect()}
    host = lambda h: h or ""
    totals, pages = Counter(host(h) for _, _, h, _ in rows), Counter()
    bare = lambda s: s.strip(" \t\x0b\x0c\r")
    for _, t, h, _ in rows:
        pages.update({(host(h), bare(x)) for x in (t or "").split("\n") if bare(x)})
    assert len(got) == len(rows)
    for i, t, h, k in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (bare(x) and pages[host(h), bare(x)] >= 3 and pages[host(h), bare(x)] > 0.1 * totals[host(h)])]
        assert got[i]._text == (None if t is None else "\n".join(kept)) and got[i]._host == k
        assert (got[i]._lines, got[i]._dropped) == ((0, 0) if not t else (len(lines), len(lines) - len(kept)))
    assert L.drop_boilerplate(df.limit(0), broadcast=broadcast).collect() == []
