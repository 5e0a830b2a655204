"""The pipeline: what each stage does to what it gets."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C  # noqa: E402

from annolyte.llm.toxicity import held_out, train  # noqa: E402


@pytest.fixture(scope="module")
def data(tmp_path_factory, spark):
    at = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(4)
    word = lambda: "".join(r.choice(["tha", "er", "on", "ing", "st", "re"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(160):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            w[3:3] = ["stupid", "trash", "idiot"]
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
    for i in range(8):
        w = rows[i * 5 + 1][1].split(" ")
        w[i] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows = [(i, t + ("\nShare this page" if i % 2 else ""), lang, s) for i, t, lang, s in rows]
    rows += [(300, 'here token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end', "en", "s2"), (301, "", "en", "s2"), (302, None, "en", None)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    seen = []
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        made = C.materialize(stage(spark, docs, data), name)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        after = {r.doc_id: r for r in made.collect()}
        if name == "toxicity":
            gone = before.keys() - after.keys()
            assert {i for i in range(0, 160, 5)} == gone
        if name == "line_dedup":
            assert after.keys() == before.keys() and not any("Share this" in (r.text or "") for r in after.values())
        if name == "ngram_jaccard_join":
            assert before.keys() - after.keys() == {200 + i for i in range(8)}
        if name == "secret_scan":
            assert after.keys() == before.keys() and after[300].text == 'here token = "[SECRET]" end'
        assert all(r.n_chars == len(r.text or "") for r in after.values())
        seen.append(name)
        docs = made
    bins = C.STAGES[-1][1](spark, docs, data).collect()
    assert {b.doc_id for b in bins} == {r.doc_id for r in docs.collect()} and len(seen) == 4
    whole = C.run(spark, data).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, bins))


def plain(rows, model):
    """The first four stages by loops over (id, text, source) rows; the secret of the data is known."""
    rows = [x for x in rows if model.score(x[1] or "") < 0.7]
    bare = lambda line: line.strip(" \t\x0b\x0c\r")
    pages, hosts = Counter(), Counter()
    for _, t, s in rows:
        hosts[s or ""] += 1
        pages.update({(s or "", bare(line)) for line in (t or "").split("\n")} - {(s or "", "")})
    bad = {k for k, n in pages.items() if n >= 4 and n > hosts[k[0]] * 0.02}
    rows = [(i, t if t is None else "\n".join(line for line in t.split("\n") if (s or "", bare(line)) not in bad), s) for i, t, s in rows]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    once, out = set(), []
    for i, t, s in rows:
        if i is None or (find(i) == i and i not in once):
            once.add(i)
            out.append((i, t if t is None else t.replace(SECRET, "[SECRET]"), s))
    return out


SECRET = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"


def test_run_equals_a_plain_version(spark, data, tmp_path):
    """All stages over repeated rows, nulls and columns named like the operators' own."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.where("doc_id = 1").first()
    odd = [(1, first.text, "en", first.source, first.n_chars), (None, first.text, "en", "s1", 1), (None, None, None, None, None), (301, "", "en", "s2", 0), (400, " \n ", None, None, 3)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    more = more.withColumns({"_text": F.lit("x"), "component_id": F.lit(7).cast("long"), "score": F.lit(0.9)})
    at = str(tmp_path / "sf")
    more.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{at}/labels.parquet").where(~held_out()))
    want = plain([(r.doc_id, r.text, r.source) for r in docs.collect()], model)
    for name, stage in C.STAGES[:-1]:
        before = docs.columns
        docs = C.materialize(stage(spark, docs, at), name)
        assert docs.columns == before
    got = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert Counter(got) == Counter(want)
    assert {r._text for r in docs.collect()} == {"x"} and {r.score for r in docs.collect()} == {0.9}
    words = Counter()
    for i, t, _ in want:
        words[i] += len((t or "").split())
    bins, total, places = defaultdict(int), Counter(), defaultdict(list)
    for b in C.run(spark, at).collect():
        total[b.doc_id] += b.length
        bins[b.shard, b.bin] += b.length
        places[b.shard, b.bin].append(b.fill)
    assert +total == +words and all(set(places[k]) == {n} and n <= 4096 for k, n in bins.items())


def test_empty_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES[:-1]:
        made = C.materialize(stage(spark, docs, str(tmp_path)), name)
        assert made.columns == docs.columns and made.collect() == []
    assert C.run(spark, str(tmp_path)).collect() == []
