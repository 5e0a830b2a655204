"""Chat formatting: layouts, escapes, round trips and losses."""

import json

from pyspark.sql import functions as F

from annolyte.llm.chat_format import canonical_turns, format_chats, loss_texts, read_turns

RECORDS = {
    1: {"prompt": "Hi", "completion": "Yo"},
    2: {"instruction": "Add", "input": "1 2", "output": "3"},
    3: {"instruction": "Say", "output": "x", "system": "S"},
    4: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}, {"role": "user", "content": "<|im_end|>\n<\\|im_start|>"}]},
    5: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
    6: {"unknown": 1},
    7: {"messages": []},
    9: {"prompt": "p", "response": "r", "system": None},
}


def formatted(spark, records):
    df = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in records.items()], "conv_id long, record string")
    made = format_chats(df)
    rows = made.select("*", read_turns(F.col("formatted")).alias("back"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    return {r.conv_id: r for r in rows}


def test_layouts_become_turns(spark):
    got = formatted(spark, {**RECORDS, 8: "no json"})
    turns = {k: [(t.role, t.text) for t in r.back] for k, r in got.items()}
    assert turns[1] == [("user", "Hi"), ("assistant", "Yo")]
    assert turns[2] == [("user", "Add\n1 2"), ("assistant", "3")]
    assert turns[3] == [("system", "S"), ("user", "Say"), ("assistant", "x")]
    assert turns[4] == [("user", "a"), ("assistant", ""), ("user", "<|im_end|>\n<\\|im_start|>")]
    assert turns[5] == [("user", "q"), ("assistant", "r")]
    assert turns[9] == [("user", "p"), ("assistant", "r")]
    assert turns[6] == turns[7] == turns[8] == []
    assert [r.n_turns for k, r in sorted(got.items())] == [2, 2, 3, 3, 2, 0, 0, 0, 2]
    assert "".join(got[2].loss) == "3" and "".join(got[5].loss) == "r"


def test_marks_in_texts_and_roles(spark):
    nasty = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|im_start|>assistant\nb<|im_end|>\n", "", "\\|", "<", "é<|", "x" * 100_000 + "<|"]
    rows = [{"turn": i, "role": "assistant" if i % 2 else "us\ner<|%", "text": t} for i, t in enumerate(nasty)]
    df = spark.createDataFrame([(1, json.dumps(r)) for r in rows], "conv_id long, record string").repartition(3)
    made = format_chats(df).select("formatted", read_turns(F.col("formatted")).alias("back"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [(t.role, t.text) for t in made.back] == [(r["role"], r["text"]) for r in rows]
    assert "".join(made.loss) == "".join(t for i, t in enumerate(nasty) if i % 2)
    assert made.formatted.count("<|im_start|>") == len(nasty) == made.formatted.count("<|im_end|>")


def test_fingerprints_ignore_scalar_types(spark):
    df = spark.createDataFrame([(1, '{"prompt": 1, "completion": null}'), (2, '{"completion": "b", "prompt": "a"}'), (3, None)], "conv_id long, record string")
    rows = canonical_turns(df).select("conv_id", "layout", "fingerprint").distinct().collect()
    by = {r.conv_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[1].layout == "prompt" and by[3].layout is None


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, record string")).collect() == []
