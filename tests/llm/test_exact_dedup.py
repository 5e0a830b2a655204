"""Exact dedup: groups, what stays, and odd inputs, against a plain version."""

import hashlib
import re
from collections import defaultdict

from annolyte.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i or 0, n, i))
    out = []
    for h, g in groups.items():
        best = min(g)
        out += [(i, best[4], len(g), n == best[3], h) for _, _, _, n, i in g]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = exact_dedup(df, **kw).collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=repr)


ROWS = [
    (1, "a b", "x"), (2, "ab", "x"), (3, "a  b", None), (4, "a\tb\n", "x"), (5, None, "x"), (6, "", "x"), (7, " \n", "x"), (8, "é ", "x"), (9, "é", "x"),
    (None, "ab c", "x"), (10, "abc", "x"), (11, "q" * 200_000, "x"), (12, "q" * 100_000 + " " + "q" * 100_000, "x"), (2, "ab", "x"), (2, "ab", "x"),
]


def test_groups_and_what_stays(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_many_copies_go_through_the_frequent_path(spark):
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i % 50}", "x") for i in range(600)]
    assert run(spark, rows, heavy=2, counters=64) == brute(rows)
    one_a_group = [r for r in run(spark, rows, heavy=2, counters=64) if r[3]]
    assert len(one_a_group) == len({r[4] for r in brute(rows)})


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = exact_dedup(spark.createDataFrame(ROWS, SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))
