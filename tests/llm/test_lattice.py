import itertools
import math

import brute
import numpy as np
import pytest

from tidewire.llm.lattice import cells, near_vectors, nearest_points, roots


def test_lattice_points():
    assert roots().shape == (240, 8) and np.allclose((roots() ** 2).sum(axis=1), 2)
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (300, 8))
    near = nearest_points(x)
    doubled = np.rint(2 * near)
    assert np.all((doubled % 2 == doubled[:, :1] % 2)) and np.all(near.sum(axis=1) % 2 == 0)
    distance = ((x - near) ** 2).sum(axis=1)
    assert distance.max() <= 1 + 1e-9  # the covering radius
    for step in roots():  # no neighbour is closer
        assert np.all(((x - near - step) ** 2).sum(axis=1) >= distance - 1e-9)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for cosine, least in ((0.93, 0.98), (0.96, 0.999)):
        y = cosine * x + math.sqrt(1 - cosine**2) * z
        met = np.zeros(len(x), bool)
        for (own_x, asked_x), (own_y, asked_y) in zip(cells(x), cells(y), strict=True):
            met |= np.any([a == own_y for a in asked_x], axis=0) | np.any([a == own_x for a in asked_y], axis=0)
        assert met.mean() >= least


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            noise = rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.35])
            rows.append((len(rows), [float(np.float32(v)) for v in base + noise], int(k % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(20)]  # copies
    rows += [(500, [2 * v for v in rows[0][1]], rows[0][2]), (501, rows[0][1], 99), (502, rows[0][1], None)]
    rows += [(503, None, 1), (504, [], 1), (505, [0.0] * 16, 1), (506, [1.0, None] * 8, 1)]
    rows += [(507, [float("nan")] * 16, 1), (508, [float("inf")] * 16, 1), (509, rows[0][1][:8], 0), (510, rows[0][1][:8], 0)]
    return rows


def expected(rows):
    def valid(e, label):
        return label is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)

    links = []
    for (i, x, a), (j, y, b) in itertools.combinations([r for r in rows if valid(r[1], r[2])], 2):
        if a == b and len(x) == len(y):
            x, y = np.array(x), np.array(y)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((i, j))
    component = brute.smallest_reachable([r[0] for r in rows], links)
    return {i: (sum(i in k for k in links), component[i], component[i] == i) for i, _, _ in rows}


def test_equals_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table.repartition(3)).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1)], [(1, [1.0], 1), (1, [1.0], 1)], [(None, [1.0], 1)]])
def test_few_rows(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_vectors(table).collect()))
    links = len(rows) - 1
    assert got == [(i, links, i, i is not None) for i, _, _ in rows]


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200] * 4), (2, [2e200] * 4), (3, [1e-200] * 4), (4, [2e-200] * 4), (5, [1.0] * 4), (6, [5e-324, 0.0, 0.0, 0.0])]
    rows += [(7, [-1e300, 1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (0, 6), 7: (0, 7)}
