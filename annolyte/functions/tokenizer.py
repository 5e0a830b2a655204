"""A byte-pair tokeniser with word ends: cleaning and word splitting in SQL, merges by rank in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import context, tokens

#: Marks the last symbol of a word: fixed value.
END = "</w>"
WORDS = 200_000


class Merges:
    """Ranks of symbol pairs and ids of symbols, with a bounded memory of words."""

    def __init__(self, ranks: dict[tuple[str, str], int], ids: dict[str, int]):
        self.ranks, self.ids = ranks, ids
        self.symbols = {i: s for s, i in ids.items()}
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            parts = [*word[:-1], word[-1:] + END]
            while len(parts) > 1:
                rank, pair = min((self.ranks.get(p, 1 << 60), p) for p in zip(parts, parts[1:], strict=False))
                if rank == 1 << 60:
                    break
                out, i = [], 0
                while i < len(parts):
                    if tuple(parts[i : i + 2]) == pair:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            found = self.known[word] = [self.ids[p] for p in parts if p in self.ids]
        return found

    def decode(self, ids: list[int]) -> str:
        return "".join(self.symbols.get(i, "") for i in ids).replace(END, " ").strip()


def encoded(rows: DataFrame, key: str, text: str, merges: Merges) -> DataFrame:
    """key, ids of each text; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[i for w in (ws or []) for i in merges.word(w)] for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = dict(rows.select(F.col(key)).dtypes)[key]
    return rows.select(key, tokens(F.col(text)).alias("w")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def contexts(rows: DataFrame, start: int, end: int, length: int = 77) -> DataFrame:
    """ids between start and end ids, padded or cut to length."""
    return rows.withColumn("ids", context(F.col("ids"), start, end, length))
