"""Document fingerprints by consistent weighted sampling.

For each sample k and term x the draws r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ Uniform(0,1) come
from a hash of x alone. A term of weight w gets t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1);
a document keeps, for each k, the least ln a. Two documents keep the same one with a chance equal
to the generalised Jaccard similarity of their term weights, sum of minima over sum of maxima.
The kept ln a identifies its pair (term, t), so 16 hashed bits of it are the sample.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import mapped, parts_of

#: Samples of a fingerprint; words longer than this many characters count as their runs of 8.
SAMPLES, LONG_WORD = 64, 40
#: Pairs of term and weight whose draws are made at once; terms that a worker remembers.
PAIRS, TERMS = 60_000, 100_000


def terms(text: str) -> Counter:
    """Weighted terms: words between white space, lower-cased, by count."""
    found = Counter(text.lower().split())
    for w in [w for w in found if len(w) > LONG_WORD]:
        n = found.pop(w)
        for i in range(len(w) - 7):
            found[w[i : i + 8]] += n
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Gamma(2,1) at the middles of n equal shares, by halving 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


#: Draws by 16 bits of a hash: r, 1 / r and ln c.
_R = _gamma_quantiles()
_ONE_OVER_R, _LN_C, _R = (1 / _R).astype(np.float32), np.log(_R).astype(np.float32), _R.astype(np.float32)


def log_a(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """ln a of each (term, weight) in each sample, float32."""
    with np.errstate(over="ignore"):
        x = _mix(hashes[:, None] + (np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
    parts = x.view(np.uint16).reshape(*x.shape, 4)
    b = x.view(np.uint32).reshape(*x.shape, 2)[..., 1].astype(np.float32) * np.float32(2.0**-32)
    at_r = parts[..., 0]
    t = np.log(weights).astype(np.float32)[:, None] * _ONE_OVER_R[at_r]
    t += b
    np.floor(t, out=t)
    t -= b
    t += np.float32(1)
    t *= _R[at_r]
    return np.subtract(_LN_C[parts[..., 1]], t, out=t)


class _Hashes(dict):
    def __missing__(self, term: str) -> int:
        import xxhash

        h = self[term] = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
        return h


class Sampler:
    """Fingerprints of term counters, many at once."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.hashes = _Hashes()

    def sign(self, docs: list[Counter]) -> np.ndarray:
        """uint16 samples, a row for each document; those without terms get the row of the empty term."""
        out = np.empty((len(docs), self.samples), np.uint16)
        at = 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and (end == at or size + len(docs[end]) <= PAIRS):
                size += len(docs[end])
                end += 1
            out[at:end] = self._sign(docs[at:end])
            at = end
        return out

    def _sign(self, docs: list[Counter]) -> np.ndarray:
        if len(self.hashes) > TERMS:
            self.hashes.clear()
        hashed = self.hashes.__getitem__
        docs = [d or {"": 1} for d in docs]
        sizes = [len(d) for d in docs]
        keys = np.concatenate([np.fromiter(map(hashed, d), np.uint64, n) for d, n in zip(docs, sizes, strict=True)])
        weights = np.concatenate([np.fromiter(d.values(), np.int64, n) for d, n in zip(docs, sizes, strict=True)])
        # Documents share terms of one weight, whose draws are made once.
        with np.errstate(over="ignore"):
            pairs = keys ^ _mix(weights.astype(np.uint64))
        _, first, rows_at = np.unique(pairs, return_index=True, return_inverse=True)
        keys, weights = keys[first], weights[first].astype(np.float64)
        table = np.empty((len(keys), self.samples), np.float32)
        for i in range(0, len(keys), 2048):
            table[i : i + 2048] = log_a(keys[i : i + 2048], weights[i : i + 2048], self.samples)
        least = np.empty((len(docs), self.samples), np.float32)
        ends = np.cumsum(sizes)
        for i, (s, e) in enumerate(zip(ends - sizes, ends, strict=True)):
            table.take(rows_at[s:e], axis=0).min(axis=0, out=least[i])
        with np.errstate(over="ignore"):
            return (_mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, fingerprint (hex, 4 digits a sample) of each whole text.

    Null and empty texts, and those of white space alone, share one fingerprint. Equal texts have
    equal fingerprints. Repeated rows and null ids stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for part in parts_of(batches, 256):
            signs = sampler.sign([terms(t or "") for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(">u2").tobytes().hex() for s in signs])], [id_col, "fingerprint"])

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fingerprint string")


#: What null ids count as in the order: they come first.
LEAST_ID = -(1 << 63)


class _Ranges:
    """Ranges of (id, hash of the text) between quantiles of the ids; an id on several quantiles is split among them by hash."""

    def __init__(self, borders: list[int]):
        self.borders = np.array(borders, np.int64)

    def __call__(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.borders, ids, "left"), np.searchsorted(self.borders, ids, "right")
        # An id on k borders fills the k - 1 ranges between them; otherwise it lies in the range above its border.
        share = ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return np.where(high - low > 1, low + 1 + np.floor(share * (high - low - 1)).astype(np.int64), high).astype(np.int32)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt into ranges of ids, in order within each; each range ends with the first row of the next.

    _range, _tail (that extra row), id, text, in order of ids, then of the text's hash. The last range ends with the very first
    row. Null ids come first. There is a range for each shuffle partition. Borders and first rows are known to the
    workers as plain arrays of two numbers a range, so plans don't grow with the partitions. Rows that repeat an id are
    neighbours, and split among ranges where they are many; only rows with equal id and equal text always share a range.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key, mark = F.coalesce("_id", F.lit(LEAST_ID)), F.xxhash64("_text")
    borders = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    ranges = _Ranges(borders or [])

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(ranges(ids.to_numpy(), hashes.to_numpy()))

    placed = rows.select(key.alias("k"), mark.alias("h")).select(range_of("k", "h").alias("r"), "k", "h")
    heads = sorted((x["r"], x["least"]["k"], x["least"]["h"]) for x in placed.groupBy("r").agg(F.min(F.struct("k", "h")).alias("least")).collect())  # a row for each range
    at, first_k, first_h = (np.array([x[i] for x in heads], np.int64) for i in range(3))

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The range of a row, and for the first of a range also the one before."""
        k, h = ids.to_numpy(), hashes.to_numpy()
        own = ranges(k, h)
        i = np.searchsorted(at, own)
        first = (first_k[i] == k) & (first_h[i] == h)
        both = np.stack((own, at[i - 1].astype(np.int32)), 1)
        keep = np.stack((np.ones(len(own), bool), first), 1)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)), pa.array(both[keep]))

    if not heads:
        return rows.select(F.lit(0).alias("_range"), F.lit(False).alias("_tail"), "_id", "_text", F.lit(0).cast("bigint").alias("_mark"))
    return (
        rows.withColumn("_mark", mark)
        .withColumn("_to", ranges_of(key, F.col("_mark")))
        .select(F.posexplode("_to").alias("_nth", "_range"), "_id", "_text", "_mark")
        .select("_range", (F.col("_nth") > 0).alias("_tail"), "_id", "_text", "_mark")
        .repartitionById(n, F.col("_range"))
        .sortWithinPartitions("_range", "_tail", F.col("_id").asc_nulls_first(), "_mark")
    )


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each whole text, of its edit, and how alike these and the next document's are.

    The edit replaces the last quarter by as many first characters of the next document (ascending
    ids; the first follows the last). Null texts are empty. Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are integers; others raise an error. Rows that repeat an id, null ids among them, stand together in the order of a hash of
    their texts, null ids first; each row has the next row as its next document, whatever that one's id.
    A single row is its own next. An empty table gives no rows. Other columns are not read.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids of type {kind}: integers are needed for their order")

    def flush(rows, sampler):
        """rows: (id, text) in order; the last row just ends the others."""
        counts, edits, out = [], [], []
        for i, (key, text) in enumerate(rows):
            counts.append(terms(text))
            if i + 1 < len(rows):
                n = len(text) // 4
                edit = text[: len(text) - n] + rows[i + 1][1][:n]
                edits.append(terms(edit))
                out.append((key, len(text), hashlib.sha256(edit.encode()).hexdigest()))
        m = len(out)
        signs = sampler.sign(counts + edits)
        own, new, nxt = signs[:m], signs[len(counts) :], signs[1 : m + 1]
        hexed = lambda x: pa.array([s.astype(">u2").tobytes().hex() for s in x], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.string()),
                hexed(own),
                hexed(new),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, nxt)),
            ],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        rows, size, at, ended = [], 0, None, False
        for part in parts_of(batches, 64):
            for where, tail, key, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if where != at:
                    rows, size, at, ended = [], 0, where, False
                if ended:  # repeated rows of the next range's first one
                    continue
                rows.append((key, text))
                size += len(text)
                ended = tail
                if tail or len(rows) > 128 or size > 1_000_000:
                    if len(rows) > 1:
                        yield flush(rows, sampler)
                    rows, size = [rows[-1]], len(text)

    made = with_next(docs, id_col, text_col).select("_range", "_tail", "_id", "_text")
    return mapped(made, run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
