"""Best-fit packing under conflicts.

Documents are packed into bins of a fixed capacity, longest first. Bins are kept in order of
what they have left; each carries a bitmap of the sources and one of the duplicate clusters in
it. A document goes to the tightest bin that has room and shares neither with it: the search
starts at the tightest bin that fits and goes on to the next until one is compatible, and opens a
new bin if none is. Documents longer than a bin are cut into full pieces and a rest. Hashing
documents into shards of bounded size packs them side by side; each shard is packed whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped

#: Units (words) in a bin; documents in a shard on average.
CAPACITY, SHARD = 4096, 4096
#: A shard of more than this many times its average size, which only repeated ids make, is packed in parts.
MOST = 8
#: Bits of the bitmaps. Two sources or clusters that share a bit just never share a bin.
SOURCE_BITS, CLUSTER_BITS = 256, 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item. sources, clusters: bit numbers, -1 for one that conflicts with nothing."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left: list[tuple[int, int]] = []  # (what is left, bin), ascending
    source_map: list[int] = []
    cluster_map: list[int] = []
    bins = [0] * len(sizes)
    for i in order:
        need = sizes[i]
        s = 1 << sources[i] if sources[i] >= 0 else 0
        c = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(left, (need, -1))
        while at < len(left) and (source_map[left[at][1]] & s or cluster_map[left[at][1]] & c):
            at += 1
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= s
        cluster_map[b] |= c
        if room > need:
            insort(left, (room - need, b))
        bins[i] = b
    return bins


def pack(docs: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """A row per piece: id, piece (0 on), start, length, shard, bin, fill (units in the bin).

    No bin holds two documents of one source or one cluster, nor two pieces of one document.
    Null sources and clusters conflict with nothing; null and zero sizes are pieces of length 0,
    which take no room. Repeated rows are packed as often as they occur. Pieces that fill a bin
    have one to themselves.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0)).alias("_size"),
        F.when(F.col(source_col).isNotNull(), F.pmod(F.xxhash64(F.col(source_col)), F.lit(SOURCE_BITS))).cast("int").alias("_source"),
        F.when(F.col(cluster_col).isNotNull(), F.pmod(F.xxhash64(F.col(cluster_col), F.lit(1)), F.lit(CLUSTER_BITS))).cast("int").alias("_cluster"),
    )
    shards = max(1, math.ceil(docs.count() / shard))
    # Null ids are dealt out by their place in the input.
    key = F.when(F.col("_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col("_id"), F.lit(7)))
    dealt = narrow.withColumn("_shard", F.pmod(key, F.lit(shards)).cast("int"))
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    kind, arrow = dict(narrow.dtypes)["_id"], to_arrow_type(narrow.schema["_id"].dataType)

    def one(at: int, rows: dict[str, list], full: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a shard, or of a part of it, in bins numbered from `full`; and the next free number."""
        ids, rests, sources, clusters = rows["_id"], [], [], []
        base = full
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "bin")}
        owner = []
        for i, size in enumerate(rows["_size"]):
            n, rest = divmod(size, capacity)
            for p in range(n):
                out["id"].append(ids[i])
                out["piece"].append(p)
                out["start"].append(p * capacity)
                out["length"].append(capacity)
                out["bin"].append(full)
                full += 1
            if rest or not n:
                owner.append((i, n))
                rests.append(rest)
                sources.append(-1 if rows["_source"][i] is None else rows["_source"][i])
                clusters.append(-1 if rows["_cluster"][i] is None else rows["_cluster"][i])
        for (i, n), size, b in zip(owner, rests, best_fit(rests, sources, clusters, capacity), strict=True):
            out["id"].append(ids[i])
            out["piece"].append(n)
            out["start"].append(n * capacity)
            out["length"].append(size)
            out["bin"].append(full + b)
        bins = np.array(out["bin"], np.int64)
        fill = np.bincount(bins - base, np.array(out["length"], np.float64)).astype(np.int64)
        n = len(bins)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out["id"], arrow),
                pa.array(out["piece"], pa.int64()),
                pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int64()),
                pa.array([at] * n, pa.int64()),
                pa.array(bins),
                pa.array(fill[bins - base]),
            ],
            [id_col, "piece", "start", "length", "shard", "bin", "fill"],
        ), int(bins.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, full = None, {}, 0
        names = ("_id", "_size", "_source", "_cluster")
        for batch in batches:
            for shard_of, *values in zip(batch.column(4).to_pylist(), *(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard_of != at:
                    if rows and rows["_id"]:
                        yield one(at, rows, full)[0]
                    at, rows, full = shard_of, {n: [] for n in names}, 0
                elif len(rows["_id"]) >= MOST * shard:  # rows that repeat an id very often: packed in parts
                    made, full = one(at, rows, full)
                    yield made
                    rows = {n: [] for n in names}
                for n, v in zip(names, values, strict=True):
                    rows[n].append(v)
        if rows and rows["_id"]:
            yield one(at, rows, full)[0]

    ready = dealt.repartition(parts, "_shard").sortWithinPartitions("_shard", F.desc("_size"), F.col("_id").asc_nulls_first(), "_source", "_cluster")
    return mapped(ready, run, f"`{id_col}` {kind}, piece bigint, start bigint, length bigint, shard bigint, bin bigint, fill bigint")
