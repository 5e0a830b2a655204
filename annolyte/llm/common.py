"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..stored import materialize, shared_folder  # noqa: F401  (operators take them from here)

#: ASCII white space, [\x20\x09-\x0D]: fixed value.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Returns freed memory to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function for mapInArrow that gives freed memory back at its end: workers are reused, and share an executor with the JVM."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaner


#: Bits of an id filter: 2 MB, whatever the number of ids.
FILTER_BITS = 1 << 24


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits)) for salt in (11, 23)]


def may_be_in(ids: DataFrame, name: str, key: Column, bits: int = FILTER_BITS) -> Column:
    """A condition on key (bigint) that is true for all ids in the table and for few others: a Bloom filter of fixed size.

    It spares rows a shuffle before an exact join. With many more ids than bits / 8 it lets most rows through, and the join does the
    work. Its bits / 8 bytes go by way of the driver to the workers, which get just two numbers for each row.
    """
    hit = ids.select(F.explode(F.array(*_places(F.col(name), bits))).alias("h"))
    rows = hit.groupBy(F.floor(F.col("h") / 8).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("h", F.lit(8)).cast("int"))).alias("v")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[rows["at"].to_numpy()] = rows["v"].to_numpy()
    del rows
    give_back()  # the driver's limit is for its JVM and Python together

    @F.arrow_udf("boolean")
    def held(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_numpy(), b.to_numpy()
        return pa.array((table[x >> 3] >> (x & 7) & (table[y >> 3] >> (y & 7)) & 1).astype(bool))

    return held(*_places(key, bits))


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow, lean, with this package shipped to workers that lack it."""
    ship(rows.sparkSession)
    return rows.mapInArrow(lean(run), schema)


def parts_of(batches, rows: int):
    """Arrow batches in smaller parts, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts_by_size(batches, column: int, size: int):
    """Arrow batches in parts of about size bytes of a column of strings, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def without_spaces(text: Column) -> Column:
    """text without ASCII white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Holds a whole input row while an operator works, so that no column of its own meets one of the input's.
ROW = "_input_row"


def wrapped(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(ROW)[name]


def unwrapped(rows: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """The input's columns and those in made; one of the input by the name of a made one is replaced."""
    # In two steps, so that no expression meets an input's column by the name of a column it reads.
    rows = rows.select(ROW, *[c.alias(f"_made_{i}") for i, c in enumerate(made.values())])
    return rows.select(*[field(c).alias(c) for c in columns if c not in made], *[F.col(f"_made_{i}").alias(n) for i, n in enumerate(made)])


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column's name begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
