"""SentencePiece: encodings and decodings equal the library's."""

import random

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from annolyte.llm.sentencepiece_bpe import BpeModel, encode_texts, encoding_digests  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return BpeModel(PATH), spm.SentencePieceProcessor(model_file=PATH)


def test_texts(both):
    mine, lib = both
    r = random.Random(3)
    parts = [*" \n\tabcdethingerst.,#$%0123456789éèüßñ▁中文😀́\x00<>|s/", "  ", "     ", "the", "ing", "<s>", "<0x41>", "▁▁", "Ġ"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        ids = lib.encode(t)
        assert mine.encode(t) == ids
        assert mine.decode(ids) == lib.decode(ids)
        assert mine.round_trip(t) == (",".join(map(str, ids)), len(ids), lib.decode(ids))


def test_columns_equal_single_texts(both):
    mine, lib = both
    r = random.Random(6)
    parts = ["the ", "ing ", "of", " ", "  ", "▁", "\n", "é", "中", "\x00", "word ", "<s> "]
    texts = ["", " ", "a", "a ", " a", "x" * 300, *["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)]]
    for some in (texts, texts[:1], texts[2:3], []):
        ids, counts, back = mine.round_trips(pa.array(some, pa.string()))
        assert ids == [",".join(map(str, lib.encode(t))) for t in some]
        assert counts.tolist() == [len(lib.encode(t)) for t in some] and back == [lib.decode(lib.encode(t)) for t in some]


def test_any_ids_decode(both):
    mine, lib = both
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 0, 1, 2, lib.piece_to_id("▁")]) for _ in range(r.randint(0, 9))]
        assert mine.decode(ids) == lib.decode(ids)


def test_long_units(both):
    mine, lib = both
    for t in ("a" * 5000, " " * 3000 + "x", "ab" * 2000 + "▁" * 50, "thaterndingha" * 300):
        assert mine.encode(t) == lib.encode(t)


def test_words_after_runs(both):
    """Backtracking behind runs of spaces, and text that runs on behind them."""
    mine, lib = both
    r = random.Random(9)
    pieces = [lib.id_to_piece(i) for i in range(300, 32000, 7)]
    for _ in range(4000):
        t = "".join(r.choice([" " * r.randint(1, 40), "▁" * r.randint(1, 20), "", ""]) + r.choice(["", r.choice(pieces), "é", "中", "\n", "0"]) + r.choice(pieces).replace("▁", "") for _ in range(r.randint(1, 6)))
        ids = lib.encode(t)
        assert mine.encode(t) == ids
        assert mine.round_trip(t) == (",".join(map(str, ids)), len(ids), lib.decode(ids))


def test_frames(spark, both):
    _, lib = both
    rows = [(1, "Hello  world", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "Hello  world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted([(r.doc_id, r.ids) for r in encode_texts(df, PATH).collect()], key=repr)
    assert got == sorted([(i, lib.encode(t or "")) for i, t, _ in rows], key=repr)
    assert encoding_digests(df.limit(0), PATH).collect() == []
    assert sorted(r.n_tokens for r in encoding_digests(df, PATH).collect()) == sorted(len(lib.encode(t or "")) for _, t, _ in rows)
