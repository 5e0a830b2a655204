"""N-gram Jaccard join: all documents linked by like shingle sets, exactly, with signature trees.

1. Tokens on many documents are found in each task's own documents and their counts added up.
2. Each document lists half the pairs of neighbours in its sorted shingle set, rare ones first, as its
   tokens: two like sets must share one, and have near sizes. Documents of near size classes that share a token
   are tied to the least of them, their hub. Where many documents of one task share a token,
   they are tied within the task, which then sends the token once. Equal sets are tied as copies.
3. A hub and all documents tied to it form a stand. A signature tree over the bitmaps of a stand,
   traversed against itself, leaves the pairs whose overlap may be large enough. What these
   pairs connect is a forest: no link leaves one.
4. Each forest is read again as a block of whole sets, and a signature tree over it, traversed
   likewise with an exact check at its leaves, finds the links (`signature_tree`).
5. Forests of more than `BLOCK` sets are dealt by size class and hash into several blocks, each with
   a few documents that most others are tied to. Sets that these blocks leave outside the
   forest's main group are then joined, as blocks too, with all blocks of near size.
6. The connected components of links and copies are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, mapped, materialize, may_be_in, parts_of
from .components import components
from .shingles import Shingler, set_key
from .signature_tree import folded, link, one_bitmap, traverse

#: Words in a shingle.
SIZE = 5
#: A token on more than this share of the documents, and on LEAST at least, is common: it comes last in the order.
#: Their number is at most the mean set size / COMMON, however many documents there are.
COMMON, LEAST = 1 / 2000, 8
#: Sets in a block; documents that a large forest shares among its blocks. A stand above STAND is a forest unpruned.
BLOCK, CENTRES, STAND = 2048, 4, 8192
#: Shingles of a block for each set that it may hold; bytes of bitmaps in a stand that is pruned.
SHINGLES, STAND_BYTES = 1024, 1 << 25
#: Documents of one task with one token that are tied within the task.
CROWD = 64
#: Documents, and their shingles, that a task gathers before it sends their tokens; buckets of tokens for each shuffle partition.
GATHER, GATHERED, BUCKETS = 4096, 1_000_000, 8
#: Tokens of a bucket that are held before those of crowded ones are tied; bytes and documents in a sent row; bytes in a batch.
HELD, ROW_BYTES, ROW_DOCS, BATCH_BYTES = 1_000_000, 1 << 18, 256, 1 << 21

_PAYLOAD = "bucket int, kind int, payload binary"
DOC, COPY, TOKEN, EDGE, LOCAL, MAP, LATE = 0, 1, 2, 3, 4, 5, 6
#: The low bits of a sent token hold its set's size class: classes of like sets differ by 1 at most.
CLASS_BITS = np.uint64(63)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, `GATHER` documents or `GATHERED` shingles at once."""
    make = Shingler(size)
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = make(text)
                ids.append(key)
                sets.append(s)
                held += len(s)
                if len(ids) >= GATHER or held >= GATHERED:
                    yield ids, sets
                    ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _distinct_sets(sets: list[np.ndarray]) -> tuple[list[bytes], dict[bytes, list[int]]]:
    keys = [set_key(s) for s in sets]
    groups: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    return keys, groups


def common_tokens(docs: DataFrame, n_docs: int, size: int = SIZE) -> np.ndarray:
    """Sorted tokens that are on many documents, by the counts of the tasks where they are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _chunks(batches, size):
            firsts = [sets[g[0]] for g in _distinct_sets(sets)[1].values()]
            tokens, counts = np.unique(np.concatenate(firsts), return_counts=True)
            keep = counts >= max(3, int(COMMON * len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "n"])

    found = mapped(docs.select("_id", "_text"), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= max(LEAST, int(COMMON * n_docs))).select("token").toArrow()
    tokens = np.sort(rows["token"].to_numpy().astype(np.int64).view(np.uint64))
    del rows
    give_back()
    return tokens


def heads(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Hashes of neighbours among a set's sorted tokens, of which any other set with a Jaccard similarity of 0.75 or more has one in its own.

    A token that the other set lacks parts two pairs of neighbours, one that it has besides parts one: of n - 1 pairs n // 2 at most are lost, so
    the first n // 2 + 1 in any order that all sets share have one in common. Unlike texts that share a token by chance, which grow
    with the square of the documents, seldom share its neighbour. Pairs of common tokens come last. Sets of fewer than 3 tokens are only like their equals.
    """
    n = len(tokens)
    if n < 3:
        return tokens[:0]
    p = n // 2 + 1
    if not len(common):
        at = np.arange(p)
    else:
        place = np.searchsorted(common, tokens)
        place[place == len(common)] = 0
        known = common[place] == tokens
        both = known[1:] & known[:-1]
        at = np.flatnonzero(~both)[:p]
        at = at if len(at) == p else np.concatenate((at, np.flatnonzero(both)[: p - len(at)]))
    h = tokens[at] * np.uint64(0x9E3779B97F4A7C15) + tokens[at + 1]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def size_class(n: int) -> int:
    return min(63, int(math.log(max(n, 1)) / math.log(4 / 3) + 1e-9))


_COPIES = np.dtype([("k", "<u8"), ("l", "<u8"), ("d", "<i8")])


def _in_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of bucket, kind and payload in batches of about `BATCH_BYTES`."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "payload"])

    for row in rows:
        held.append(row)
        size += len(row[2]) + 16
        if size >= BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _maps(ids: list[int], sets: list[np.ndarray]) -> Iterator[bytes]:
    """Ids, set sizes and bitmaps, in rows of `ROW_BYTES` at most, or of one document."""
    head, blobs, size = [], [], 0
    for key, s in zip(ids, sets, strict=True):
        blob = one_bitmap(s)
        if blobs and (size + len(blob) > ROW_BYTES or len(blobs) >= ROW_DOCS):
            yield np.array([len(blobs), *head], np.int64).tobytes() + b"".join(blobs)
            head, blobs, size = [], [], 0
        head += [key, len(s), len(blob)]
        blobs.append(blob)
        size += len(blob)
    if blobs:
        yield np.array([len(blobs), *head], np.int64).tobytes() + b"".join(blobs)


def _unmapped(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    ends = np.cumsum(head[:, 2]) + 8 + 24 * n
    return head[:, 0].copy(), head[:, 1].copy(), [raw[e - k : e] for e, k in zip(ends.tolist(), head[:, 2].tolist(), strict=True)]


def _sent(ids: list, sets: list[np.ndarray], common: np.ndarray, buckets: int, turn: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of one gathering. Those that need not meet others are dealt out in turn."""
    keys, groups = _distinct_sets(sets)
    first = {k: min((ids[i] for i in g if ids[i] is not None), default=None) for k, g in groups.items()}
    at = hash((ids[0], len(ids), turn))

    def anywhere() -> int:
        nonlocal at
        at += 1
        return at % buckets

    named = [i for i in range(len(ids)) if ids[i] is not None]
    rows = np.array([(ids[i], len(sets[i]), first[keys[i]] if len(sets[i]) else ids[i]) for i in named], np.int64).reshape(-1, 3)
    for i in range(0, len(rows), ROW_DOCS):
        yield anywhere(), DOC, rows[i : i + ROW_DOCS].tobytes()
    nameless = [len(sets[i]) for i in range(len(ids)) if ids[i] is None]
    if nameless:
        yield anywhere(), -1, np.array(nameless, np.int64).tobytes()
    live = [(k, g[0], first[k]) for k, g in groups.items() if len(sets[g[0]]) and first[k] is not None]
    if not live:
        return
    by: dict[int, list] = {}
    for k, _, doc in live:
        by.setdefault(int.from_bytes(k[:6], "little") % buckets, []).append(k + int(doc).to_bytes(8, "little", signed=True))
    for b, x in by.items():
        yield b, COPY, b"".join(x)
    for raw in _maps([doc for _, _, doc in live], [sets[i] for _, i, _ in live]):
        yield anywhere(), MAP, raw
    docs_of = np.array([doc for _, _, doc in live], np.int64)
    keys_of = [heads(sets[i], common) & ~CLASS_BITS | np.uint64(size_class(len(sets[i]))) for _, i, _ in live]
    tokens = np.concatenate(keys_of)
    if not len(tokens):
        return
    owner = np.repeat(np.arange(len(live), dtype=np.int32), [len(h) for h in keys_of])
    del keys_of, by, rows
    order = np.argsort(tokens, kind="stable")  # owners ascend within a token
    tokens, owner = tokens[order], owner[order]
    start = np.ones(len(tokens), bool)
    start[1:] = tokens[1:] != tokens[:-1]
    first_at = np.flatnonzero(start)
    group = np.cumsum(start, dtype=np.int32) - 1
    crowded = (np.diff(np.r_[first_at, len(tokens)]) >= CROWD)[group]
    tied = crowded & ~start
    pairs = np.unique(owner[tied].astype(np.int64) << 32 | owner[first_at][group[tied]])
    pairs = docs_of[np.stack((pairs >> 32, pairs & 0xFFFFFFFF), 1)]
    for i in range(0, len(pairs), ROW_BYTES // 16):
        yield anywhere(), LOCAL, pairs[i : i + ROW_BYTES // 16].tobytes()
    tokens, owner = tokens[~tied], owner[~tied]
    bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for s, e in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        yield int(bucket[s]), TOKEN, np.stack((tokens[s:e].view(np.int64), docs_of[owner[s:e]]), 1).tobytes()


def _hubs(both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (token with size class, id) rows, where a run of documents that may be alike begins, and each row's hub."""
    both = both[np.argsort(both[:, 0].view(np.uint64), kind="stable")]
    token = both[:, 0].view(np.uint64)
    size = (token & CLASS_BITS).astype(np.int8)
    # A gap in the size classes of a token's documents parts them.
    start = np.r_[True, ((token[1:] ^ token[:-1]) > CLASS_BITS) | (np.diff(size) > 1)]
    hub = np.minimum.reduceat(both[:, 1], np.flatnonzero(start))[np.cumsum(start) - 1]
    return both, start, hub


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


class _Bucket:
    """What meets in one bucket. Of a token that very many share, a part is tied to a hub of its own, which stays for it."""

    def __init__(self):
        self.copies: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.stay: list[np.ndarray] = []
        self.held, self.most = 0, HELD

    def add(self, raw: bytes) -> Iterator[tuple]:
        self.tokens.append(np.frombuffer(raw, np.int64).reshape(-1, 2))
        self.held += len(self.tokens[-1])
        if self.held > self.most:
            both, start, hub = _hubs(np.concatenate(self.tokens))
            self.tokens.clear()
            crowded = np.diff(np.r_[np.flatnonzero(start), len(both)])[np.cumsum(start) - 1] > CROWD
            tied = crowded & (both[:, 1] != hub)
            yield LATE, *_pairs(both[tied, 1], hub[tied])
            # A hub stays once for each size class of its run.
            self.stay.append(np.stack(_pairs(both[crowded, 0], hub[crowded]), 1))
            self.tokens.append(both[~crowded])
            self.held = len(self.tokens[-1])
            self.most = max(HELD, 2 * self.held)

    def close(self) -> Iterator[tuple]:
        if self.copies:
            found = np.concatenate(self.copies)
            found = found[np.lexsort((found["d"], found["l"], found["k"]))]
            start = np.r_[True, (found["k"][1:] != found["k"][:-1]) | (found["l"][1:] != found["l"][:-1])]
            first = found["d"][np.flatnonzero(start)][np.cumsum(start) - 1]
            other = first != found["d"]
            yield COPY, found["d"][other], first[other]
        if self.tokens or self.stay:
            both, _, hub = _hubs(np.concatenate(self.tokens + self.stay))
            tied = both[:, 1] != hub
            yield EDGE, *_pairs(both[tied, 1], hub[tied])
        self.__init__()


def _tie_rows(kind: int, x, y, z=None, map=None) -> pa.RecordBatch:
    n = len(x)
    columns = [np.full(n, kind, np.int32), x, y, np.zeros(n, np.int64) if z is None else z]
    return pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], pa.nulls(n, pa.binary()) if map is None else pa.array(map, pa.binary())], ["kind", "x", "y", "z", "map"])


def _ties(docs: DataFrame, common: np.ndarray, size: int) -> DataFrame:
    """kind, x, y, z, map: what ties documents, and what is known of each.

    DOC (id, set size, first copy in its task), COPY (id, first copy), EDGE (id, hub), LOCAL (id, hub within its task), LATE (id, hub
    within a part of a bucket), MAP (id, set size, bitmap in map). Buckets are met one at a time, so a task holds one bucket's tokens.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS
    shared = spark.sparkContext.broadcast(common)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(row for turn, (ids, sets) in enumerate(_chunks(batches, size)) for row in _sent(ids, sets, shared.value, buckets, turn))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, _Bucket()
        for part in parts_of(batches, 32):
            for bucket, kind, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    for made in now.close():
                        yield _tie_rows(*made)
                    at = bucket
                if kind == COPY:
                    now.copies.append(np.frombuffer(raw, _COPIES))
                elif kind == TOKEN:
                    for made in now.add(raw):
                        yield _tie_rows(*made)
                elif kind == MAP:
                    ids, sizes, maps = _unmapped(raw)
                    yield _tie_rows(MAP, ids, sizes, None, maps)
                elif kind == LOCAL:
                    yield _tie_rows(LOCAL, *np.frombuffer(raw, np.int64).reshape(-1, 2).T.copy())
                elif kind == DOC:
                    yield _tie_rows(DOC, *np.frombuffer(raw, np.int64).reshape(-1, 3).T.copy())
                else:
                    sizes = np.frombuffer(raw, np.int64).copy()
                    yield _tie_rows(DOC, pa.nulls(len(sizes), pa.int64()), sizes, pa.nulls(len(sizes), pa.int64()))
        for made in now.close():
            yield _tie_rows(*made)

    sent = mapped(docs.select("_id", "_text"), send, _PAYLOAD)
    return mapped(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"), meet, "kind int, x bigint, y bigint, z bigint, map binary")


def _pruned(stands: DataFrame, maps: DataFrame, parts: int) -> DataFrame:
    """u, v: pairs enough to connect, in each stand, all whose overlap its signature tree can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sizes, maps, held = None, [], [], [], 0
        pairs: list[tuple[int, int]] = []

        def close() -> None:
            # Like sets have bitmaps of one length, or of two that differ by a factor of 2.
            lengths = np.array([len(m) for m in maps])
            for length in np.unique(lengths):
                at_it = np.flatnonzero((lengths == length) | (lengths == 2 * length))
                if len(at_it) < 2:
                    continue
                both = folded([maps[i] for i in at_it])
                n = np.array(sizes, np.int64)[at_it]
                probe = lengths[at_it] == length
                name = [ids[i] for i in at_it]
                pair = lambda i, j, name=name: pairs.append((max(name[i], name[j]), min(name[i], name[j])))
                traverse(both, n, -np.arange(len(name), dtype=float), both[:, 0], lambda i, j: True, pair, None if probe.all() else probe)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])
            pairs.clear()
            return out

        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                for hub, key, size, raw in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if hub != at:
                        close()
                        at, ids, sizes, maps, held = hub, [], [], [], 0
                    if len(pairs) > 10_000:
                        yield flush()
                    held += len(raw)
                    if held > STAND_BYTES:  # as a stand above STAND: unpruned
                        pairs += [(k, hub) for k in [*ids, key] if k != hub]
                        ids, sizes, maps = [], [], []
                        continue
                    ids.append(key)
                    sizes.append(size)
                    maps.append(raw)
        close()
        yield flush()

    n = stands.groupBy("hub").agg(F.count("*").alias("n"))
    large = n.where(F.col("n") > STAND).select("hub")
    rows = stands.join(n.where((F.col("n") > 1) & (F.col("n") <= STAND)).select("hub"), "hub").join(maps, "node")
    rows = rows.select("hub", "node", "_size", "_map").repartition(parts, "hub").sortWithinPartitions("hub", "node")
    whole = stands.join(large, "hub").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    return materialize(mapped(rows, run, "u bigint, v bigint").unionByName(whole), "near")


def _joined(rows: DataFrame, size: int, by: list[str], rejoin: bool) -> DataFrame:
    """rows: the columns of by, _id, _text, _probe, _group, dealt and sorted by `by`. Gives u, v of the links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        at, ids, sets, probes, groups = None, [], [], [], []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                link(
                    sets,
                    np.array(probes) if rejoin else None,
                    np.array(groups) if rejoin else None,
                    lambda i, j: links.append((ids[i], ids[j])),
                )

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])
            links.clear()
            return out

        k = len(by)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for *block, key, text, probe, group in zip(*(part.column(i).to_pylist() for i in range(k + 4)), strict=True):
                    if block != at:
                        close()
                        at, ids, sets, probes, groups = block, [], [], [], []
                        if len(links) > 10_000:
                            yield flush()
                    ids.append(key)
                    sets.append(make(text))
                    probes.append(bool(probe))
                    groups.append(group or 0)
        close()
        yield flush()

    return mapped(rows.select(*by, "_id", "_text", "_probe", "_group"), run, "u bigint, v bigint")


def _one_text_each(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """base, where each id in repeated has one row, with its least text. Texts of other ids take no shuffle, but for few."""
    suspect = F.col("_id").isNotNull() & may_be_in(repeated, "_id", F.col("_id"))
    # Least texts are found within each task first, so a frequent id costs no task much.
    least = base.where(suspect).groupBy("_id").agg(F.min("_text").alias("_text"))
    return materialize(base.where(~suspect).unionByName(least), "one-text-each")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """A row per input row: id, n_shingles, component_id (least id reachable by links, itself included).

    Texts without words, null ones among them, have no shingles and link with nothing. Rows
    that repeat an id are one document, with the least of their texts (nulls last); each of them gets
    its row. Null ids link with nothing and get a null component. Ids are integers; others raise an
    error. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids of type {kind}: integers are needed, as the least names a component")
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    repeated = materialize(base.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "repeated")
    if not repeated.take(1):
        return _components_of(base, id_col, size, block)
    found = materialize(_components_of(_one_text_each(base, repeated), id_col, size, block), "of-ids")
    named = base.where("_id IS NOT NULL").select(F.col("_id").alias(id_col)).join(found, id_col)
    return named.unionByName(found.where(F.col(id_col).isNull()))


def _components_of(base: DataFrame, id_col: str, size: int, block: int) -> DataFrame:
    """jaccard_components of _id, _text, where no id but null is repeated."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = common_tokens(base, base.count(), size)
    ties = materialize(_ties(base, common, size), "ties")
    rows = ties.where(F.col("kind") == DOC)
    copies = ties.where(F.col("kind") == COPY).select(F.col("x").alias("u"), F.col("y").alias("v"))
    tied = ties.where(F.col("kind") == EDGE).select(F.col("x").alias("node"), F.col("y").alias("hub"))
    crowds = ties.where(F.col("kind") == LOCAL).select(F.col("x").alias("node"), F.col("y").alias("hub"))
    # Whoever is tied to a hub of a task, or of a part of a bucket, belongs to each stand of that hub.
    late = ties.where(F.col("kind") == LATE).select(F.col("x").alias("node"), F.col("y").alias("hub"))
    if late.take(1):
        crowds = materialize(crowds.unionByName(late).unionByName(crowds.withColumnRenamed("hub", "_via").join(late.withColumnRenamed("node", "_via"), "_via").select("node", "hub")).distinct(), "crowds")
    through = crowds.withColumnRenamed("hub", "_via").join(tied.withColumnRenamed("node", "_via"), "_via").select("node", "hub")
    hubs = tied.unionByName(crowds).select(F.col("hub").alias("node"), "hub")
    # Of copies, which have equal sets, the least stands for all.
    others = copies.select(F.col("u").alias("node")).distinct()
    stands = materialize(tied.unionByName(crowds).unionByName(through).unionByName(hubs).distinct().join(others, "node", "left_anti"), "stands")
    near = _pruned(stands, ties.where(F.col("kind") == MAP).select(F.col("x").alias("node"), F.col("y").alias("_size"), F.col("map").alias("_map")), parts)
    sizes = rows.where("x IS NOT NULL").groupBy("x").agg(F.max("y").alias("size"))
    members = components(near).join(sizes, F.col("node") == F.col("x")).drop("x")
    members = materialize(members, "members")
    counts = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where("n > 1")
    counts = materialize(counts.select("component", F.greatest(F.col("n"), F.col("m") / SHINGLES).alias("load")), "forests")
    # Sets of a large forest, by their number or their shingles, are dealt by size class, as like sets have near sizes, then by hash.
    big = counts.where(F.col("load") > block)
    some_big = bool(big.take(1))
    small = members.join(counts.where(F.col("load") <= block), "component").select(F.col("node").alias("_id"), "component", F.lit(0).alias("_class"), F.lit(0).alias("_part"))
    where = small
    if some_big:
        dealt = members.join(big, "component")
        dealt = dealt.withColumn("_class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(4 / 3))).cast("int"))
        classes = dealt.groupBy("component", "_class").agg(F.ceil(F.greatest(F.count("*"), F.sum("size") / SHINGLES) / F.lit(block)).alias("_parts"))
        dealt = materialize(
            dealt.join(classes, ["component", "_class"]).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).select(F.col("node").alias("_id"), "component", "_class", "_part"),
            "dealt",
        )
        degree = near.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("d"))
        ranked = members.join(big, "component").join(degree, "node", "left").select("component", F.coalesce("d", F.lit(0)).alias("d"), F.col("node").alias("v"))
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("d"), "v"))).where(F.col("r") <= CENTRES)
        ranked = ranked.groupBy("component").agg(F.collect_list("v").alias("c"))
        blocks = dealt.select("component", "_class", "_part").distinct()
        centres = blocks.join(ranked, "component").select(F.explode("c").alias("_id"), "component", "_class", "_part")
        where = small.unionByName(dealt.unionByName(centres).distinct())
    none = {"_probe": F.lit(False), "_group": F.lit(None).cast("bigint")}
    # Texts of documents in no forest are left out before the shuffle.
    texts = base.where(F.col("_id").isNotNull() & may_be_in(members.select("node"), "node", F.col("_id")))
    by = ["component", "_class", "_part"]
    rows1 = texts.join(where, "_id").withColumns(none).repartition(parts, *by).sortWithinPartitions(*by, "_id")
    links = materialize(_joined(rows1, size, by, False), "links")
    if some_big:
        links = links.unionByName(_rest(texts, dealt, links, size, parts))
    ended = components(links.unionByName(copies))
    by_doc = rows.join(ended, F.col("z") == F.col("node"), "left")
    return by_doc.select(F.col("x").alias(id_col), F.col("y").alias("n_shingles"), F.coalesce("component", "z").alias("component_id"))


def _rest(texts: DataFrame, dealt: DataFrame, links: DataFrame, size: int, parts: int) -> DataFrame:
    """Links of large forests across blocks: sets outside the main group against all blocks of near size."""
    groups = components(links)
    known = materialize(dealt.join(groups.select(F.col("node").alias("_id"), F.col("component").alias("_g")), "_id", "left").withColumn("_group", F.coalesce("_g", "_id")).drop("_g"), "groups")
    main = known.groupBy("component", "_group").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "_group"))["_group"].alias("_main"))
    rest = known.join(main, "component").where(F.col("_group") != F.col("_main")).drop("_main")
    rest = materialize(rest, "rest")
    if not rest.take(1):
        return links.limit(0)
    mine = rest.select("component", F.col("_class").alias("_rc"), F.col("_part").alias("_rp")).distinct()
    theirs = known.select("component", "_class", "_part").distinct()
    near = (F.abs(F.col("_rc") - F.col("_class")) <= 1) & ~((F.col("_rc") == F.col("_class")) & (F.col("_rp") == F.col("_part")))
    pairs = materialize(mine.join(theirs, "component").where(near), "pairs")
    probe = rest.withColumnsRenamed({"_class": "_rc", "_part": "_rp"}).join(pairs, ["component", "_rc", "_rp"]).withColumn("_probe", F.lit(True))
    other = known.join(pairs, ["component", "_class", "_part"]).withColumn("_probe", F.lit(False))
    by = ["component", "_rc", "_rp", "_class", "_part"]
    cols = [*by, "_id", "_group", "_probe"]
    rows = texts.join(probe.select(*cols).unionByName(other.select(*cols)), "_id").repartition(parts, *by).sortWithinPartitions(*by, "_id")
    return materialize(_joined(rows, size, by, True), "rest-links")
