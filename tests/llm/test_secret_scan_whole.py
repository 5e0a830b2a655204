"""Secret scans cover whole values, however long they are."""

import random

from annolyte.llm.secret_scan import scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def found(spark, texts):
    rows = scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_long_values_are_covered(spark):
    r = random.Random(3)
    mixed = lambda k: "".join(r.choice(LETTERS) for _ in range(k))
    jwt = lambda *k: "eyJ" + ".".join(mixed(n) for n in k)
    values = [("password=", mixed(300), " x"), ('token = "', mixed(600), '" y'), ("see ", jwt(37, 700, 342), " z"), ("see ", jwt(97, 300, 342), " z"), ("key ", "ghp_" + mixed(400), " e")]
    got = found(spark, ["".join(x) for x in values])
    for i, (before, value, after) in enumerate(values):
        assert [(f.start, f.length, f.value) for f in got[i]._findings] == [(len(before), len(value), value)]
        assert got[i]._redacted == f"{before}[SECRET]{after}"


def test_very_long_runs_are_read(spark):
    """Time and stack stay small: numbers with many points, and runs of a telling name."""
    texts = ["x " + "1." * 100000 + "1 y", "secret: " + "token" * 20000 + " y"]
    got = found(spark, texts)
    assert got[0]._redacted == texts[0] and got[1]._candidates <= 1


def test_assigned_values_of_any_telling_name(spark):
    values = [
        ('password="', "Tr0ub4dor&3", '" x'), ("password: ", "Tr0ub4dor&3", ""), ("password = ", "hunter2xyz", " x"), ("passphrase=", "hunter2xyz", " x"), ("api_key=", "9f8e7d6c5b4a", ""),
        ('client_secret="', "abcDEFghiJKL", '"'), ('api_key="', "abcdefghijklmnopqrstuvwxyzABCDEF", '"'), ("Authorization: Bearer ", "1beb58b8af68854f0e01b4ad40cdbb6a", " x"),
        ("token" + " " * 40 + "=" + " " * 40, "9f8e7d6c5b4a", " x"), ('{"password": "', "Tr0ub4dor&3", '"}'), ('see my_app2_production_token="', "9f8e7d6c5b4a", '"'),
    ]
    got = found(spark, ["".join(x) for x in values])
    for i, (before, value, after) in enumerate(values):
        assert [(f.start, f.value) for f in got[i]._findings] == [(len(before), value)], (before, got[i])
        assert got[i]._redacted == f"{before}[SECRET]{after}"


def test_words_after_a_telling_name_stay(spark):
    texts = ["token: station is here", "the secret: another thing", "bearer a" + " " * 200000 + "b", "password = testing"]
    got = found(spark, texts)
    assert [got[i]._redacted for i in range(len(texts))] == texts
