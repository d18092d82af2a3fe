"""Whitening of embeddings by weighted multiplicity covariance.

Each entry c of a vector becomes the whole number x = floor(64 * c) + 1000000. Vectors with the same x are one
class; its weight is how many vectors it stands for, one for a vector without an equal. The covariance is a
weighted, centred product of the distinct vectors: each task adds up its own, centred with the exact means
before multiplying, and the matrices of all tasks are added row by row. Each distinct vector is projected
once on the eigenvectors and scaled to unit variance; then the rows get their class's values by a join.

Sums are exact in 64 bits, deviations too; a deviation beyond a long is null. The driver sees one number and
one row of the matrix for each dimension, whatever the number of vectors.

Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are vectors that
have another length than most (of equally frequent lengths the larger counts) or an entry beyond 2^40 in
size, which has no place in a sum of 64 bits. Rows without an id and repeated rows are vectors like others.
Components without variance have null ``whitened``, and null ``explained`` if there is no variance at all. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.settings import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000  # fixed values: of the whole numbers made of the entries
LARGEST = float(1 << 40)
ROWS_AT_ONCE = 4096
FLAT = 1e-13  # a component with a smaller share of the variance has none


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; null unless the vector has entries and all can be taken."""
    usable = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)
    ) & (F.size(vector) > 0)
    return F.when(usable, F.transform(vector, lambda v: F.floor(v * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array, dimension: int, kind=np.int64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, dimension)


def _by_part(classes: DataFrame, dimension: int, column: str, run) -> dict[int, np.ndarray]:
    """The sums over all tasks of the rows of the matrix that ``run`` adds up from pieces of the vectors in
    ``column`` and their weights."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(begin, ROWS_AT_ONCE)
                vectors = _matrix(piece.column(0), dimension, kind)
                found = run(vectors, np.asarray(piece.column(1)))
                total = found if total is None else total + found
        if total is not None:
            rows = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total])]
            yield pa.RecordBatch.from_arrays(rows, names=["part", "total"])

    def added(key, table):
        total = sum(np.frombuffer(t.as_buffer(), out) for t in table["total"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()])})

    kind = np.int64 if column == "x" else np.float64
    out = np.int64 if run is _sums else np.float64
    parts = classes.select(column, "weight").mapInArrow(partial, "part int, total binary")
    sums = parts.groupBy("part").applyInArrow(added, "part int, total binary")
    return {r["part"]: np.frombuffer(bytes(r["total"]), out) for r in sums.collect()}


def _sums(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (vectors * weights[:, None]).sum(axis=0)[None, :]


def covariance(classes: DataFrame, dimension: int, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance of the vectors ``x`` with their ``weight``; divisor ``n``."""

    def product(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        centred = (n * vectors - sums) / n
        return (centred * weights[:, None]).T @ centred

    rows = _by_part(classes, dimension, "x", product)
    found = np.array([rows[i] for i in range(dimension)]) / n
    return (found + found.T) / 2


def _identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """The largest entry of the covariance of ``z`` minus the identity."""

    def total(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (vectors * weights[:, None]).sum(axis=0)[None, :]

    mean = _by_part(whitened, components, "z", total)[0] / n

    def product(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        centred = vectors - mean
        return (centred * weights[:, None]).T @ centred

    rows = _by_part(whitened, components, "z", product)
    found = np.array([rows[i] for i in range(components)]) / n
    return float(np.abs(found - np.eye(components)).max())


def _deviations(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of whole numbers; null beyond 64 bits."""
    dimension = exact.shape[1]
    if float(np.abs(exact.astype(float)).max(initial=0.0)) ** 2 * dimension < 2.0**62:
        return (exact * exact).sum(axis=1).tolist()
    sums = [sum(v * v for v in row) for row in exact.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whiten(
    embeddings: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Per row and component the id, ``component`` from 1, ``n`` (vectors in all), ``deviation`` (the sum over
    the dimensions of (n * x - S)^2, S being the sums of x), ``whitened``, ``explained`` (the component's share
    of the variance) and ``identity_error`` (the largest entry of the covariance of all components with
    variance minus the identity)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(f"`{id_column}`").alias("id"),
        whole_numbers(F.col(f"`{vector_column}`").cast("array<double>")).alias("x"),
    ).filter("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    kinds = (
        f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if most is None:
        return spark.createDataFrame([], kinds).withColumnRenamed("id", id_column)
    dimension, n = most["d"], most["count"]
    rows = rows.filter(F.size("x") == dimension)
    classes = materialize(rows.groupBy("x").agg(F.count("*").alias("weight")), "vector-multiplicities")
    sums = _by_part(classes, dimension, "x", _sums)[0]
    values, vectors = np.linalg.eigh(covariance(classes, dimension, n, sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(values.sum())
    shown = min(components, dimension)
    useful = int(np.count_nonzero(values[:shown] > FLAT * trace)) if trace > 0 else 0
    scaled = vectors[:, :useful] / np.sqrt(values[:useful])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(begin, ROWS_AT_ONCE)
                exact = n * _matrix(piece.column(0), dimension) - sums
                z = (exact / n) @ scaled
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(z) + 1, dtype=np.int32) * useful), pa.array(z.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(_deviations(exact), pa.int64()), lists],
                    names=["x", "weight", "deviation", "z"],
                )

    whitened = classes.select("x", "weight").mapInArrow(
        project, "x array<long>, weight long, deviation long, z array<double>"
    )
    whitened = materialize(whitened, "whitened")
    error = _identity_error(whitened, useful, n) if useful else None
    shares = [float(v) / trace if trace > 0 else None for v in np.maximum(values[:shown], 0.0)]
    facts = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                (F.col("z")[k] if k < useful else F.lit(None).cast("double")).alias("whitened"),
                F.lit(share).cast("double").alias("explained"),
            )
            for k, share in enumerate(shares)
        ]
    )
    # a class of very many rows meets one row, so this side can be split
    found = rows.join(whitened.select("x", "deviation", "z"), "x")
    found = found.select("id", "deviation", F.inline(facts))
    return found.select(
        F.col("id").alias(id_column), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.lit(error).cast("double").alias("identity_error"),
    )
