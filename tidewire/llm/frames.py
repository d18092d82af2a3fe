"""Helpers for operators that add columns to the rows they get."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


# What a Python worker is handed at once, unless the session says otherwise: texts are long rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches where the session leaves them at Spark's defaults."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def released(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """``batches``; after the last one what Arrow's allocator keeps goes back, as workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def regrouped(
    batches: Iterable[pa.RecordBatch], rows: int = 1 << 30, size: int = 1 << 30
) -> Iterable[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes; the last may have fewer."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n >= rows or held_bytes >= size:
            yield pa.concat_batches(held)
            held, n, held_bytes = [], 0, 0
    if n:
        yield pa.concat_batches(held)


def with_columns(docs: DataFrame, fields: Sequence[T.StructField], run) -> DataFrame:
    """``docs`` through ``run`` (batches in, batches out), which appends ``fields`` to each batch.

    Columns of ``docs`` with the name of a field (in any case) are dropped first.
    """
    new = {f.name.lower() for f in fields}
    small_batches(docs.sparkSession)
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    return kept.mapInArrow(lambda batches: released(run(batches)), T.StructType([*kept.schema.fields, *fields]))


def appended(
    batch: pa.RecordBatch, fields: Sequence[T.StructField], columns: Iterable
) -> pa.RecordBatch:
    """The batch with the new columns at its end."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, to_arrow_type(f.dataType))
        for f, c in zip(fields, columns, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *arrays], names=[*batch.schema.names, *[f.name for f in fields]]
    )


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as decimal text; the folds are made of it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
