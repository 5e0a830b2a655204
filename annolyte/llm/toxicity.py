"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings is fitted to labelled texts. Each labelled text that
names groups of people is taken again with its identity terms swapped, once for another group of
the same kind and once for a neutral word; the squared change of the model's logit is part of
the loss. So a group's name can't carry toxicity by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mapped, parts_of

#: Labelled rows that the model is fitted to at most, those of least hash; rows with a word at least to keep it.
SAMPLE, MIN_ROWS = 6000, 2
THRESHOLD = 0.7
#: A word's log ratio counts half when it is in as many labelled rows.
TRUST = 10.0

#: Identity terms by kind and language: fixed values.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("mexican", "american", "chinese", "indian", "turkish", "russian", "german", "french", "spanish"),
    ("deaf", "blind", "disabled", "autistic"),
    ("muslime", "christen", "juden", "hindus"),
    ("frauen", "männer"),
    ("ausländer", "flüchtlinge", "einwanderer"),
    ("musulmans", "chrétiens", "juifs"),
    ("femmes", "hommes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("musulmanes", "cristianos", "judíos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
NEUTRAL = "people"
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """Words, and how they begin: stems are shared by many word forms."""
    return found | {"^" + x[:4] for x in found} | {"^" + x[:5] for x in found if len(x) > 4}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def logit(self, found: set[str]) -> float:
        get = self.weights.get
        return self.bias + sum([w for x in sorted(found & self.weights.keys()) if (w := get(x))])

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.logit(features(words(text))), -35, 35))))


class _Rows:
    """Rows of features as index arrays."""

    def __init__(self, rows: list[np.ndarray], scale: np.ndarray):
        self.n = len(rows)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.x = scale[self.flat]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat] * self.x, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, g[self.row] * self.x, size)


def loss(base: _Rows, y: np.ndarray, weight: np.ndarray, left: _Rows, right: _Rows, w: np.ndarray, b: float, penalty: float, l2: float) -> tuple[float, np.ndarray, float]:
    """The weighted log loss, the mean squared change of the logit between swapped rows and the size of weights; their gradient by w and b."""
    z = np.clip(base.dot(w) + b, -35, 35)
    ridge = l2 / max(1, len(y)) ** 0.5
    value = float((weight * (np.log1p(np.exp(z)) - y * z)).sum()) + ridge * float(w @ w) / 2
    g = weight * (1 / (1 + np.exp(-z)) - y)
    grad = base.back(g, len(w)) + ridge * w
    if left.n:
        change = left.dot(w) - right.dot(w)
        value += penalty * float((change**2).mean())
        d = 2 * penalty * change / left.n
        grad += left.back(d, len(w)) - right.back(d, len(w))
    return value, grad, float(g.sum())


def fit(labelled: Iterable[tuple[set[str], int]], penalty: float = 1.0, l2: float = 0.02, steps: int = 250, rate: float = 0.05) -> Model:
    """The model for (words, label) rows, which are read once. Without both labels it gives every text the share of label 1."""
    ids: dict[str, int] = {}
    rows, truth, named = [], [], []
    for found, t in labelled:
        truth.append(t)
        rows.append(np.fromiter((ids.setdefault(x, len(ids)) for x in sorted(features(found))), np.int32))
        if found & SWAP.keys():
            named.append(found)
    y = np.array(truth, np.float64)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), {})
    for x in sorted(features({*SWAP, NEUTRAL})):
        ids.setdefault(x, len(ids))
    flat = np.concatenate(rows)
    toxic = np.repeat(y, [len(r) for r in rows])
    all_c, toxic_c = np.bincount(flat, minlength=len(ids)).astype(np.float64), np.bincount(flat, toxic, len(ids))
    needed = {*features({*SWAP, NEUTRAL})}
    keep = np.array([n >= MIN_ROWS or x in needed for x, n in zip(ids, all_c.tolist(), strict=True)])
    # The naive Bayes log ratio scales each feature, so that words of even or rare use count little.
    p, q = (toxic_c + 0.5) / (y.sum() + 1), (all_c - toxic_c + 0.5) / (len(y) - y.sum() + 1)
    ratio = np.maximum(np.log(p / q), 0.0) * all_c / (all_c + TRUST)
    keep &= (ratio > 0) | np.array([x in needed for x in ids])
    place = np.where(keep, np.cumsum(keep) - 1, -1)
    vocab = {x: int(place[i]) for x, i in ids.items() if keep[i]}
    scale = ratio[keep]
    ids.clear()
    row = lambda found: np.array(sorted(vocab[x] for x in features(found) if x in vocab), np.int64)
    base = _Rows([place[r][place[r] >= 0] for r in rows], scale)
    rows.clear()
    pairs = [(f, {SWAP.get(x, x) for x in f}) for f in named] + [(f, {NEUTRAL if x in SWAP else x for x in f}) for f in named]
    left, right = _Rows([row(a) for a, _ in pairs], scale), _Rows([row(b) for _, b in pairs], scale)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels count alike
    size, w, b = len(vocab), np.zeros(len(vocab)), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        _, grad, gb = loss(base, y, weight, left, right, w, b, penalty, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        k, kv = 1 - 0.9**step, 1 - 0.999**step
        # Words only ever add to toxicity: harmless ones, of which long texts have many, don't make up for it.
        w = np.maximum(w - rate * (m / k) / (np.sqrt(v / kv) + 1e-8), 0.0)
        b -= rate * (mb / k) / ((vb / kv) ** 0.5 + 1e-8)
    final = w * scale
    return Model(b, {x: float(final[i]) for x, i in vocab.items() if abs(final[i]) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits to the `sample` labelled rows of least hash; whoever calls leaves held-out rows out of labels."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
        .limit(sample)
    )
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(ids), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 512):
            found = [sorted(words(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(found, pa.list_(pa.string()))], ["id", "label", "words"])

    rows = mapped(chosen.select(F.col(id_col).cast("string"), F.col("_label").cast("bigint"), "_text"), run, "id string, label bigint, words array<string>").toArrow()
    order = sorted(zip(rows["id"].to_pylist(), rows["label"].to_pylist(), range(rows.num_rows), strict=True))
    lists = rows["words"]
    model = fit((set(lists[i].as_py()), int(label > 0)) for _, label, i in order)
    del rows, lists, order
    give_back()  # later steps run beside this process, within one limit
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of each whole text. Null texts count as empty and get the model's base score."""
    weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([weights.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def keep_nontoxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 512):
            keep = pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return mapped(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: every third by CRC-32 of the id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
