"""Runs a numpy kernel over many small groups in one pass of each partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..shipping import ship


def by_group(rows: DataFrame, by: list[str], order: list, kernel: Callable[[tuple, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """kernel(key, columns) gets a group's rows in order, as lists, and returns rows of schema.

    One shuffle deals the groups out, a sort within partitions puts each together, and batches are
    cut where the key changes; a group may span batches. A task holds one group at a time.
    """
    names = rows.columns
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out_names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        at, held, done = None, [], []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds.field(i).type) for i in range(len(out_names))], schema=kinds)
            done.clear()
            return made

        def close() -> None:
            if held:
                done.extend(kernel(at, {n: [r[i] for r in held] for i, n in enumerate(names)}))
                held.clear()

        where = [names.index(c) for c in by]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                key = tuple(row[i] for i in where)
                if key != at:
                    close()
                    at = key
                    if len(done) > 8192:
                        yield flush()
                held.append(row)
        close()
        if done:
            yield flush()

    ship(rows.sparkSession)
    # A stated number of partitions: kernels are slow for the bytes they read, by which Spark would put many groups in one task.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
