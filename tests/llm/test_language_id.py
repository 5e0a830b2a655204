"""Language identification: each kind of evidence, priors, and odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from annolyte.llm.language_id import CELLS, DOMAIN, STRENGTH, TrigramModel, cells, fuse, identify, visible

SYL = {"en": ["the", "ing", "th", "er"], "de": ["sch", "ein", "ung", "ich"], "fr": ["eau", "que", "ment", "ou"]}


def text(lang, n, r):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def tables(spark, seed=1):
    r = random.Random(seed)
    docs, pages, truth = [], [], {}
    for i in range(150):
        lang = r.choice(sorted(SYL))
        docs.append((i, text(lang, r.randint(20, 60), r), lang, f"s{i % 3}", 0, "x"))
        truth["document", i] = lang
    for i in range(90):
        lang = sorted(SYL)[i % 3]
        # Half of the pages say nothing but for their markup, address or host.
        body = text(lang, 40, r) if i % 2 else "### 123"
        declared = f' lang="{lang}"' if i % 4 != 2 else ""
        pages.append((i, f"https://{lang}.host{i % 3}.example/{lang}/{i}?a", f"<html{declared}><script>var x='{text('fr', 50, r)}'</script><p>{body}&amp;</p><!-- {text('en', 50, r)} -->"))
        truth["page", i] = lang
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, host string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    return d, p, truth


def test_all_evidence_together(spark):
    d, p, truth = tables(spark)
    rows = identify(d, p).collect()
    assert len(rows) == len(truth)
    right = sum(r.lang == truth[r.kind, r.id] for r in rows)
    assert right >= 0.98 * len(rows)
    assert all(0 < r.prob <= 1 for r in rows)
    # A page without words takes what its markup, address and host tell.
    assert all(r.lang == truth["page", r.id] for r in rows if r.kind == "page" and r.id % 2 == 0)


def test_odd_inputs(spark):
    d, p, _ = tables(spark)
    odd_d = spark.createDataFrame([(900, None, "en", None, 0, "x"), (901, "", None, "s0", 0, "x"), (902, "123 ###", None, "s0", 0, "x"), (None, "the thing", None, None, 0, None), (903, "theing er " * 30_000, None, "s1", 0, "x")], d.schema)
    odd_p = spark.createDataFrame([(900, None, None), (901, "no url", "<html lang=DE><p>x"), (None, "http://a.de/", "")], p.schema)
    rows = identify(d.union(odd_d).union(odd_d), p.union(odd_p)).collect()
    assert len(rows) == d.count() + p.count() + 13
    long = [r for r in rows if r.id == 903]
    assert len(long) == 2 and all(r.lang == "en" for r in long) and all(r.lang is not None for r in rows)
    assert identify(d.limit(0), p.limit(0)).collect() == []
    assert all(r.lang is None for r in identify(d.limit(0), p).collect())


def test_markup_and_cells():
    assert visible("<p>a<script>b</script>&lt;c</p>").split() == ["a", "<c"]
    assert len(cells("")) == len(cells("ab")) == len(cells("12 34")) == 0
    m = TrigramModel({x: np.bincount(cells(t), minlength=CELLS) for x, t in (("en", "the thing there"), ("de", "schein ung ich"))})
    assert m.loglik("the ther").argmax() == 1 and m.langs == ["de", "en"]


def test_fusion_equals_plain_sums(spark):
    """Posteriors by loops over rows, as the method is described."""
    r = random.Random(7)
    langs = ["aa", "bb", "cc"]
    rows = []
    for i in range(80):
        host = r.choice(["x.a.org", "y.a.org", "b.net", ""])
        rows.append(("k", i, host, {"x.a.org": "a.org", "y.a.org": "a.org"}.get(host, host), r.choice([None, "aa", "fil"]), r.choice([None, "bb"]), [r.gauss(0, 2) for _ in langs]))
    df = spark.createDataFrame(rows, "kind string, id long, host string, domain string, declared string, suffix string, ll array<double>")
    got = {x.id: x for x in fuse(df, langs).collect()}

    def softmax(v):
        e = np.exp(np.array(v) - max(v))
        return e / e.sum()

    p = {x[1]: softmax(x[6]) for x in rows}
    total = sum(p.values())
    world = (total + 1) / (len(rows) + 3)
    for _, i, host, domain, declared, suffix, ll in rows:
        mine = [x for x in rows if x[3] == domain]
        prior = (sum(p[x[1]] for x in mine) + STRENGTH * world) / (len(mine) + STRENGTH)
        mine = [x for x in rows if x[2] == host]
        log = np.log((np.maximum(sum(p[x[1]] for x in mine) - p[i], 0) + STRENGTH * prior) / (len(mine) - 1 + STRENGTH)) + np.array(ll)
        for at, value in ((4, declared), (5, suffix)):
            if value is not None:
                seen = sum(p[x[1]] for x in rows if x[at] == value)
                every = sum(p[x[1]] for x in rows if x[at] is not None)
                log = log + np.log((seen + 0.5) / (every + 0.5 * 676))
        post = softmax(log)
        assert got[i].lang == langs[int(post.argmax())] and abs(got[i].prob - post.max()) < 1e-9
        assert got[i].text_lang == langs[int(p[i].argmax())]


def test_declared_codes_and_domains(spark):
    d, p, _ = tables(spark)
    odd = spark.createDataFrame([(500, "https://a.b.co.uk/x", '<html lang="spa"><p>x'), (501, "https://b.co.uk/x", '<html lang="fil"><p>x'), (502, "http://w.x.example/", '<html lang="en-GB"><p>x')], p.schema)
    rows = {r.id: r for r in identify(d, p.union(odd)).collect() if r.kind == "page"}
    assert [rows[i].declared for i in (500, 501, 502)] == ["es", "fil", "en"]
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.org", "y.org", "localhost"]
    made = spark.createDataFrame([(h,) for h in hosts], "h string").select(F.regexp_extract("h", DOMAIN, 1)).collect()
    assert [r[0] for r in made] == ["b.co.uk", "b.co.uk", "co.uk", "y.org", "y.org", "localhost"]
