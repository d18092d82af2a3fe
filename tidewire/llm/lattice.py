"""Near-duplicate vectors by lattice hashing, verified by cosine.

Equal vectors of a label are one class. In each of ``TABLES`` tables a class's unit vector is projected at
random to ``BLOCKS`` blocks of eight dimensions and each block is decoded to the nearest point of the E8
lattice; the points together name the class's cell. A class is stored under its own cell and asks in the
cells that take, in any of the blocks, the neighbouring lattice point the vector leans to most. Pairs that meet are
verified by cosine in double precision, within a label and a dimension.

Every valid vector is indexed; buckets have no cap. A pair at the threshold of 0.93 is met with a
probability of about 0.99 (closer pairs more often); ``tests/llm`` measures recall against brute force. Links
are counted over vectors, so copies count, without being paired.

Vectors that are null, empty, zero, or hold a null or non-finite component, and vectors without a label,
link with nothing: 0 links, a component of their own, kept. A row without an id never names a component;
alone, its component is null and it is not kept. Of repeated ids each row is a vector of its own. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.flat import mixed, signed
from tidewire.llm.graph import components
from tidewire.settings import materialize

TABLES = 12
BLOCKS = 2
SCALE = 0.5  # of a unit vector's projection, in units of the lattice
THRESHOLD = 0.93


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of the E8 lattice."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = itertools.product((0.5, -0.5), repeat=8)
    found += [np.array(h) for h in halves if sum(x < 0 for x in h) % 2 == 0]
    return np.array(found)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_points(x: np.ndarray) -> np.ndarray:
    """The nearest points of the E8 lattice: even integer points, and the same moved by a half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


@functools.cache
def _projections(dimension: int, tables: int, blocks: int) -> np.ndarray:
    rng = np.random.default_rng([dimension, tables, blocks])
    return rng.standard_normal((tables, blocks, dimension, 8))


@functools.cache
def _offsets(tables: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([tables, blocks]).uniform(0, 2, (tables, blocks, 8))


def _point_hash(points: np.ndarray, seed: int) -> np.ndarray:
    total = np.full(len(points), seed, np.uint64)
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    for k in range(8):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + doubled[:, k])
    return total


def scaled(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Vectors (flat, each with its start) times a power of two that brings the largest component of each
    between a half and one: exact, and no norm overflows or vanishes."""
    sizes = np.diff(np.append(starts, len(flat)))
    _, power = np.frexp(np.maximum.reduceat(np.abs(flat), starts))
    return np.ldexp(flat, np.repeat(-power, sizes))


def cells(
    vectors: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE
) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per table the vectors' own cells, and the cells they ask in (their own first)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    projections, offsets = _projections(vectors.shape[1], tables, blocks), _offsets(tables, blocks)
    for t in range(tables):
        options = []
        for b in range(blocks):
            y = scale * (unit @ projections[t, b]) + offsets[t, b]
            home = nearest_points(y)
            lean = roots()[np.argmax((y - home) @ roots().T, axis=1)]
            seed = t * blocks + b + 1
            options.append((_point_hash(home, seed), _point_hash(home + lean, seed)))
        asked = [
            functools.reduce(lambda x, y: mixed(x * np.uint64(31) + y), choice)
            for choice in itertools.product(*options)
        ]
        yield asked[0], asked


def _cells_of(classes: DataFrame, tables: int, blocks: int, scale: float) -> DataFrame:
    """``class``, ``key`` and ``own`` (else the cell is only asked in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column(0))
            salts = np.asarray(batch.column(1)).view(np.uint64)
            column = batch.column(2)
            sizes = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten(), np.float64)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                for some in np.array_split(rows, 1 + len(rows) // 2000):
                    vectors = flat[starts[some][:, None] + np.arange(d)]
                    vectors = scaled(vectors.ravel(), np.arange(len(some)) * d).reshape(-1, d)
                    for own, asked in cells(vectors, tables, blocks, scale):
                        for k, key in enumerate(asked):
                            key = signed(mixed(key ^ salts[some]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(numbers[some]), pa.array(key), pa.array(np.full(len(some), k == 0))],
                                names=["class", "key", "own"],
                            )

    salted = classes.select("class", F.xxhash64("label", F.size("embedding")).alias("salt"), "embedding")
    return salted.mapInArrow(run, "class long, key long, own boolean")


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = np.diff(np.asarray(batch.column(2).offsets))
                starts = np.cumsum(sizes) - sizes
                x, y = (
                    scaled(np.asarray(batch.column(c).flatten(), np.float64), starts) for c in (2, 3)
                )
                dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
                keep = pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)) >= threshold)
                yield batch.filter(keep).select(["a", "b"])

    left = classes.select(F.col("class").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("y"))
    both = pairs.join(left, "a").join(right, "b").filter("la = lb and size(x) = size(y)")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_vectors(
    embeddings: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label", threshold: float = THRESHOLD, tables: int = TABLES,
    blocks: int = BLOCKS, scale: float = SCALE,
) -> DataFrame:
    """Per row the id, ``n_links``, ``component_id`` (the smallest id that links lead to) and ``kept``."""
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), vector.alias("embedding")
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    number = F.when(valid, F.xxhash64("label", "embedding"))
    rows = materialize(rows.withColumn("class", number), "vectors")
    copies = rows.filter("class is not null").groupBy("class")
    classes = copies.agg(
        F.count("*").alias("n"), F.min("id").alias("id"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding"),
    )
    classes = materialize(classes, "vector-classes")

    found = materialize(_cells_of(classes, tables, blocks, scale), "cells")
    stored = found.filter("own").select(F.col("class").alias("there"), "key")
    asking = found.select(F.col("class").alias("here"), "key")
    met = asking.join(stored, "key").filter("here <> there")
    pairs = met.select(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b"))
    links = materialize(_verified(pairs.distinct(), classes, threshold), "vector-links")

    sizes = classes.select(F.col("class").alias("b"), "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("others"))
    reached = components(links).withColumnRenamed("node", "class").join(classes.select("class", "id"), "class")
    lowest = materialize(reached.groupBy("root").agg(F.min("id").alias("component")), "lowest")
    reached = reached.join(lowest, "root").select("class", "component")
    facts = classes.select("class", "id", "n").join(reached, "class", "left")
    facts = facts.join(others.withColumnRenamed("a", "class"), "class", "left").select(
        "class",
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    facts = materialize(facts, "vector-facts")
    out = rows.select("id", "class").join(facts, "class", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
