"""Whitening against numpy."""

import math

import brute
import numpy as np
import pytest

from tidewire.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>"


def result(df, **options):
    return whiten(df, **options).collect()


def test_copies_count_as_often_as_they_occur(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((120, 5)) * [1, 2, 3, 4, 5]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(60)]  # a third of all rows
    got = {(r["vec_id"], r["component"]): r for r in result(spark.createDataFrame(rows, SCHEMA))}
    brute.compare_whitened(got, brute.whitened(rows))
    assert {k for _, k in got} == {1, 2, 3, 4, 5}
    few = result(spark.createDataFrame(rows, SCHEMA), components=2)
    assert {r["component"] for r in few} == {1, 2} and len(few) == 2 * len(rows)


def test_rows_that_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.5]), (9, [0.0, 7.0])]
    bad = [(2, [1.0, None]), (3, None), (4, []), (5, [1.0, 2.0, 3.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], SCHEMA + ", component int, `a.b` string")
    got = result(df)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), *[(1, 1)] * 2, *[(1, 2)] * 2, (9, 1), (9, 2)]
    assert {r["n"] for r in got} == {4} and all(r["identity_error"] < 1e-9 for r in got)


def test_no_variance_and_empty(spark):
    got = result(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], SCHEMA))
    assert [r["whitened"] is None for r in sorted(got, key=lambda r: r["component"])] == [False, False, True, True]
    one = result(spark.createDataFrame([(1, [1.0])], SCHEMA))
    assert [tuple(r) for r in one] == [(1, 1, 1, 0, None, None, None)]
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_deviations_are_exact(spark):
    big = float(1 << 20)
    rows = [(i, [big * i, -big * i]) for i in range(4)]
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(v[k] for v in x) for k in range(2)]
    exact = {i: sum((4 * x[i][k] - sums[k]) ** 2 for k in range(2)) for i in range(4)}
    assert {r["vec_id"]: r["deviation"] for r in result(spark.createDataFrame(rows, SCHEMA))} == exact
    assert max(exact.values()) > 2**53


@pytest.mark.parametrize("parts", [1, 7])
def test_any_partitioning(spark, parts):
    rows = [(i, [float(i % 5), float(i % 3), float(i)]) for i in range(50)]
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    brute.compare_whitened({(r["vec_id"], r["component"]): r for r in got}, brute.whitened(rows))
